import random
import re

from earshot.llm import splits

SCHEMA = "rec_no bigint, company_id string, issuer_no string, extra int"


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for rec, company, issuer, _ in rows:
        if rec is None:
            continue
        find(("r", rec))
        c = re.sub(r"[^a-z0-9]", "", company.lower().split(",")[0]) if company else ""
        m = re.search(r"\d+", issuer or "")
        i = m[0].lstrip("0") if m else ""
        if c:
            parent[find(("r", rec))] = find(("c", c))
        if i and set(i) != {"9"}:
            parent[find(("r", rec))] = find(("i", i))
    groups = {}
    for r in {r for r, *_ in rows if r is not None}:
        groups.setdefault(find(("r", r)), []).append(r)
    return {(r, min(g), len(g) > 1) for g in groups.values() for r in g}


def got(df):
    return {(r.rec_no, r.group_no, r.shared) for r in df.collect()}


def test_random_records(spark):
    rng = random.Random(4)
    rows = []
    for n in range(400):
        company = rng.choice([None, "", " ", "..", f"Firm {rng.randrange(150)}, Inc.", f"FIRM-{rng.randrange(150)}"])
        issuer = rng.choice([None, "", "0", "999", "pending", f"000{rng.randrange(1, 150)}", f"is-{rng.randrange(1, 150)}", " 7 " if n % 3 == 0 else None])
        rows.append((n, company, issuer, n))
    rows += rows[:20] + [(None, "Firm 1", "3", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = splits.linked_groups(df)
    assert found.count() == 400
    assert got(found) == brute(rows)


def test_long_chain_and_hot_star(spark):
    # a chain through both fields, and one company with a third of the rows
    rows = [(n, f"c{n // 2}", str(1000 + (n + 1) // 2), 0) for n in range(120)]
    rows += [(1000 + n, "Hot, Ltd.", None, 0) for n in range(60)]
    assert got(splits.linked_groups(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_and_nothing_linked(spark):
    assert splits.linked_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, None, "N/A", 0), (2, "", "000", 0)], SCHEMA)
    assert got(splits.linked_groups(df)) == {(1, 1, False), (2, 2, False)}


def test_split_keeps_groups_and_shares(spark):
    df = spark.createDataFrame([(n, n // 2) for n in range(20000)], "rec_no bigint, group_no bigint")
    out = splits.grouped_split(df)
    assert out.groupBy("group_no").agg({"split": "count"}).count() == 10000
    assert out.select("group_no", "split").distinct().count() == 10000
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(n["train"] / 20000 - 0.8) < 0.02 and abs(n["test"] / 20000 - 0.1) < 0.02 and abs(n["validation"] / 20000 - 0.1) < 0.02
