import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import terms

SCHEMA = "term string, rec_id bigint, call_id bigint, mark string"


def brute(rows):
    occ, calls = {}, {}
    for t, r, c, _ in rows:
        if (n := terms.normal_term(t)) is not None:
            occ.setdefault(n, set()).add(r)
            calls.setdefault(n, set()).add(c)
    total = len({c for _, _, c, _ in rows} - {None})
    out = set()
    for t in occ:
        o, k = len(occ[t] - {None}), len(calls[t] - {None})
        out.add((t, o, k, "rare" if k < 3 else "common" if k > total / 10 else "useful"))
    return out


def test_against_sets(spark):
    rng = random.Random(1)
    names = ["Debt", "ｄｅｂｔ", " cash  flow", "cash\xa0ﬂow", "", "  ", None, "hot"] + [f"t{i}" for i in range(30)]
    rows = [(rng.choice([*names, "hot"]), rng.choice([None, i, i * 70001, -i]), rng.choice([None, rng.randrange(40), rng.randrange(300000)]), "x") for i in range(3000)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.term, r.n_occ, r.n_calls, r.mark) for r in terms.term_frequency(df).collect()}
    assert got == brute(rows)


def test_empty_and_all_null(spark):
    assert terms.term_frequency(spark.createDataFrame([], SCHEMA)).count() == 0
    assert terms.term_frequency(spark.createDataFrame([(None, 1, 1, "a")], SCHEMA)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 65535), min_size=1), min_size=1, max_size=5), st.booleans())
def test_containers(sets, dense):
    if dense:
        sets = [s | set(range(len(s) * 100, len(s) * 100 + 5000)) for s in sets]
    blobs = [terms.pack(np.array(sorted(s), np.uint16)) for s in sets]
    assert [set(terms.unpack(b).tolist()) for b in blobs] == sets
    assert terms.cardinality(terms.union(blobs)) == len(set().union(*sets))
    assert set(terms.unpack(terms.union(blobs)).tolist()) == set().union(*sets)
