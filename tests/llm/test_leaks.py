import random

from earshot.llm import leaks

WHO = ["trustee", "landlord", "receiver", "insurer", "rating desk", "grain buyer"]
DID = ["seized", "pledged", "auctioned", "counted", "swapped"]
WHAT = ["foundry", "dry dock", "patent pool", "rail spur", "ferry"]
WHY = ["after the auditors left town", "because the harbour froze over", "while a storm cut the power"]


def name(rng):
    return rng.choice(["Vos", "Zel", "Jor", "Kes", "Nor", "Ulf"]) + rng.choice(["lund", "gith", "mar", "sax", "vath"])


def sentence(rng):
    return rng.choice(
        [
            lambda: f"When {name(rng)} of {name(rng)} {rng.choice(DID)} the idle {rng.choice(WHAT)}, the local {rng.choice(WHO)} in Tarrow paid {rng.randrange(1000, 99999):,} crowns to {name(rng)} {rng.choice(WHY)}.",
            lambda: f"Of {rng.randrange(1000, 99999):,} shares in {name(rng)}, the careful {rng.choice(WHO)} {rng.choice(DID)} {rng.randrange(1000, 99999):,} by 3 March for the rented {rng.choice(WHAT)} {rng.choice(WHY)}.",
        ]
    )()


def build(seed=5):
    rng = random.Random(seed)
    passages = [" ".join(sentence(rng) for _ in range(3)) for _ in range(12)]
    head, tail = ["Read the passage and answer the question that follows in one short line please.\n", "Passage: ", ""], [" Question: what did Vosmar do first?", "\nWho paid for it and for how many crowns did they do so?", ""]
    items = [(i, head[i % 3] + passages[i % 12] + tail[i % 2], "t") for i in range(14)]
    filler = "We shipped many units to the north and closed two depots in the last quarter of the year. "
    docs = []
    for d in range(60):
        p = passages[d % 12]
        w = p.split()
        text = {
            0: filler + p,
            1: p.lower().replace(",", "").replace(".", ""),
            2: "<p>" + p.replace(". ", ".</p>\n[00:12:33] <p>").replace(" the ", "&nbsp;the ") + "</p>",
            3: " ".join(w[5:17]),
            4: " ".join(w[5:16]) + " and so on",
            5: " ".join(sentence(rng) for _ in range(2)),
            6: "Read the passage and answer the question that follows in one short line please. Who paid for it and for how many crowns did they do so?",
            7: " ".join(x if k % 16 else "reportedly" for k, x in enumerate(w, 1)),
        }[d % 8]
        docs.append((d, text, "x"))
    return items, docs + [(100, None, "x"), (101, "", "x"), (0, docs[0][1], "x")]


def brute(docs, seed=5, run=12):
    """Documents that repeat ``run`` words in a row of a passage, compared word by word."""
    rng = random.Random(seed)
    passages = [" ".join(sentence(rng) for _ in range(3)) for _ in range(12)]
    grams = {}
    for i in range(14):
        seq = leaks.words(passages[i % 12])
        for k in range(len(seq) - run + 1):
            grams.setdefault(tuple(seq[k : k + run]), set()).add(i)
    out = set()
    for d, t, _ in docs:
        w = leaks.words(t or "")
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


def test_against_brute_force(spark):
    items, docs = build()
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, task string")
    want = brute(docs)
    assert {d % 8 for d, _ in want} - {5} == {0, 1, 2, 3, 7} and {i for _, i in want} == set(range(14))
    for parts in (1, 5):  # the same rows for any partitioning of both sides
        got = [(r.doc_id, r.item_id) for r in leaks.leaked(leaks.window_matches(df.repartition(parts), it.repartition(parts, "text"))).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_full_bit_set_loses_nothing(spark):
    items, docs = build()
    got = leaks.leaked(leaks.window_matches(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, task string"), bits=1 << 8))
    assert {tuple(r) for r in got.collect()} == brute(docs)


def test_reparameterised_questions_are_told_from_leaks_and_from_mixed_values(spark):
    rng = random.Random(9)
    template = "When {a} of {b} {v} the frozen {o}, the reluctant {w} in {c} paid {n} crowns to {a} and {m} crowns to {b} {y}."
    who = [x + y for x in ("Vos", "Zel", "Jor", "Kes", "Nor", "Ulf") for y in ("lund", "gith", "mar", "sax", "vath")]
    items, docs, want = [], [], set()
    for i in range(40):
        a, b, c, a2, b2, c2 = rng.sample(who, 6)
        words = {"v": rng.choice(DID), "o": WHAT[i % 5], "w": WHO[i % 6], "y": WHY[i % 3]}
        n, m = rng.sample(range(100, 9000), 2)
        fill = lambda **x: template.format(**words, **x)  # noqa: B023, E731
        items.append((i, fill(a=a, b=b, c=c, n=n, m=m), ""))
        docs.append((4 * i, fill(a=a, b=b, c=c, n=n, m=m), ""))  # leaked
        docs.append((4 * i + 1, "So it was. " + fill(a=a2, b=b2, c=c2, n=n + 1, m=m + 7), ""))  # other values throughout
        docs.append((4 * i + 2, template.replace("crowns to {a}", "crowns to {x}").format(**words, a=a2, b=b2, c=c2, n=n + 1, m=m + 7, x=c2), ""))  # one name for two
        want.add((4 * i + 1, i))
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, x string"), spark.createDataFrame(items, "item_id bigint, text string, task string")
    matches = leaks.window_matches(df, it, run=22, positions=True)
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(matches).collect()} == {(4 * i, i) for i in range(40)}
    got = {(r.doc_id, r.item_id) for r in leaks.reparameterised(matches).collect()}
    # items that differ in nothing but their values ask for each other
    right = {(d, i) for d, i in got if d % 4 == 1 or d % 4 == 0}
    assert want <= got and got == right


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.window_matches(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert leaks.window_matches(some, items).count() == 0
    few = spark.createDataFrame([(1, None), (None, "x"), (2, "short")], "item_id bigint, text string")
    assert leaks.window_matches(some, few, positions=True).transform(leaks.reparameterised).count() == 0
