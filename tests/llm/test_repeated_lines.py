import random
import re

from earshot.llm import repeated_lines

SCHEMA = "company string, call_id bigint, sentence_id int, sentence_text string, n_source int"


def brute(rows):
    norm = lambda t: re.sub(r"[^a-zé]", "", (t or "").lower())
    calls, at = {}, {}
    for c, k, _, t, _ in rows:
        if c is not None and k is not None:
            calls.setdefault(c, set()).add(k)
            if norm(t):
                at.setdefault((c, norm(t)), set()).add(k)
    bad = {x for x, k in at.items() if len(k) >= 4 and len(k) >= len(calls[x[0]]) / 4}
    return {(k, s) for c, k, s, t, _ in rows if (c, norm(t)) in bad and k is not None}


def test_against_sets(spark):
    rng = random.Random(2)
    lines = ["Thank you.", "THANK  YOU", "• Welcome é", "welcome é!", "12 34", "", None, "One more thing"]
    rows = []
    for call in range(120):
        company = rng.choice([None, "A", "a", "B, Inc.", "Hot", "Hot", "Hot"])
        for s in range(rng.randrange(1, 8)):
            rows.append((company, call, s, rng.choice([*lines, f"own line {call} {s} {'abcdefgh'[s]}{chr(97 + call % 26)}"]), 1))
    rows += rows[::5] + [("A", None, 1, "Thank you", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.call_id, r.sentence_id) for r in repeated_lines.repeated_lines(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_rebuilt(spark):
    rows = [("A", k, s, t, 0) for k in range(4) for s, t in ((1, "Hello!"), (2, f"line {'abcd'[k]}"), (3, "hello"))] + [(None, 9, 2, "Hello!", 0), (None, 9, 1, None, 0)]
    out = {r.call_id: (r.n_lines, r.n_removed, r.text) for r in repeated_lines.without_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {k: (3, 2, f"line {'abcd'[k]}") for k in range(4)} | {9: (2, 0, "Hello!")}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeated_lines.repeated_lines(df).count() == 0 and repeated_lines.without_repeated_lines(df).count() == 0
