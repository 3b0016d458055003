import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from earshot.operators import attribution, cubes, entities, match, metrics, skew, speakers, tone

# y_true, then the probabilities of the three classes of 38 held-out predictions
HELD_OUT = """1 .162356 .318179 .519464;1 .050593 .838776 .110632;1 .673954 .274402 .051644;1 .451997 .432683 .115320;1 .361342 .097660 .540998;1 .504130 .418060 .077810;1 .743242 .202340 .054418;1 .037031 .917672 .045297
1 .492806 .440299 .066896;1 .329294 .560223 .110483;1 .270351 .599061 .130588;1 .615732 .296381 .087887;1 .713037 .243048 .043916;1 .645722 .212146 .142132;1 .540177 .412749 .047074;1 .620278 .318615 .061108
2 .352514 .467964 .179522;2 .202624 .645347 .152029;2 .053195 .848714 .098091;2 .058502 .828017 .113481;2 .475705 .226402 .297893;2 .660184 .259517 .080300;2 .055966 .865959 .078075;2 .572879 .194419 .232702
2 .065346 .801083 .133572;2 .760745 .201997 .037259;2 .659812 .255323 .084866;2 .490814 .353393 .155793;2 .648248 .157688 .194064;2 .075769 .870544 .053688;2 .049695 .869220 .081085;2 .589977 .250052 .159971
2 .240966 .536289 .222744;2 .393915 .426183 .179902;2 .058403 .861082 .080515;3 .612305 .254791 .132904;3 .704082 .171764 .124154;3 .477448 .427907 .094645""".replace("\n", ";")


@pytest.fixture(scope="module")
def preds(spark):
    rows = [tuple([int(x.split()[0]), *map(float, x.split()[1:])]) for x in HELD_OUT.split(";")]
    df = spark.createDataFrame(rows, "y_true int, prob_z1 double, prob_z2 double, prob_z3 double")
    p = [F.col(f"prob_z{z}") for z in (1, 2, 3)]
    return df.withColumn("y_top", metrics.argmax_class(p)).withColumn("y_thresh", metrics.threshold_class(p, [F.lit(0.25), F.lit(0.6), F.lit(0.55)])).cache()


def test_published_quality(spark, preds):
    assert preds.count() == 38
    r = metrics.report(metrics.confusion(preds, "y_true", "y_top")).first()
    assert r.accuracy == pytest.approx(0.552632, abs=1e-6) and r.macro_f1 == pytest.approx(0.395866, abs=1e-6)
    s = metrics.by_class(preds)
    assert [r.brier for r in metrics.brier(s).orderBy("z").collect()] == pytest.approx([0.266403, 0.250947, 0.090924], abs=1e-5)
    assert [r.auc for r in metrics.auc(s).orderBy("z").collect()] == pytest.approx([0.573864, 0.606648, 0.561905], abs=1e-6)
    assert [r.ap for r in metrics.average_precision(s).orderBy("z").collect()] == pytest.approx([0.500473, 0.634032, 0.110931], abs=1e-6)
    m = {(r.y_true, r.y_pred): r.n for r in metrics.confusion(preds, "y_true", "y_thresh").collect()}
    assert m == {(1, 1): 13, (1, 2): 2, (1, 3): 1, (2, 1): 10, (2, 2): 9, (3, 1): 3}
    recall = {r.z: r.recall for r in metrics.class_report(metrics.confusion(preds, "y_true", "y_thresh")).collect()}
    assert recall[3] == 0.0


def test_published_thresholds(preds):
    best = metrics.threshold_search(preds).first()
    assert best.macro_f1 == pytest.approx(0.406349, abs=1e-6)
    brute = max(
        (round(_macro([(r.y_true, _rule(r, t)) for r in rows]), 9), tuple(-x for x in t))
        for rows in [preds.collect()]
        for t in [(a / 20, b / 20, c / 20) for a in range(4, 17) for b in range(4, 17) for c in range(4, 17)]
    )
    assert best.macro_f1 == brute[0] and (best.t1, best.t2, best.t3) == tuple(-x for x in brute[1])


def _rule(r, t):
    p = (r.prob_z1, r.prob_z2, r.prob_z3)
    return next((z for z in (3, 2, 1) if p[z - 1] >= t[z - 1]), p.index(max(p)) + 1)


def _macro(pairs):
    total = 0
    for z in (1, 2, 3):
        tp, a, b = sum(y == p == z for y, p in pairs), sum(y == z for y, _ in pairs), sum(p == z for _, p in pairs)
        total += 2 * tp / (a + b) if a + b else 0
    return total / 3


def test_threshold_rule_prefers_the_highest_class(spark):
    df = spark.createDataFrame([(0.6, 0.4, 0.2)], "a double, b double, c double")
    assert df.select(metrics.threshold_class([F.col(c) for c in "abc"], [F.lit(0.5), F.lit(0.3), F.lit(0.5)]).alias("z")).first().z == 2


def test_salted_lookup_and_two_level(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "gone"]), k) for k in range(2000)]
    left = spark.createDataFrame(rows, "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3)], "k string, x int")
    assert sorted(map(tuple, skew.salted_lookup(left, right, ["k"]).collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert skew.salted_lookup(left, right, ["k"], "left").count() == 2000
    out = skew.two_level(left, ["k"], [F.count("*").alias("n"), F.collect_set("v").alias("s")], [F.sum("n").alias("n"), F.flatten(F.collect_list("s")).alias("s")], ["v"])
    assert {r.k: (r.n, len(set(r.s))) for r in out.collect()} == {k: (n, n) for k, n in Counter(k for k, _ in rows).items()}


@pytest.mark.parametrize("n,want", [(1, ["early"]), (2, ["early", "mid"]), (3, ["early", "mid", "late"]), (6, ["early"] * 2 + ["mid"] * 2 + ["late"] * 2)])
def test_stages(spark, n, want):
    df = spark.sql(f"select 'a' company, date_add(date'2020-01-01', cast(id as int)) file_date from range({n})")
    assert [r.stage for r in tone.company_stages(df.union(df)).orderBy("file_date").collect()] == want


def test_proximity(spark):
    tokens = lambda k: ["debt", *["x"] * (k - 1), "demand"]
    df = spark.createDataFrame([(1, tokens(10)), (2, tokens(11)), (3, [])], "id int, tokens array<string>")
    assert [r.near_count for r in match.proximity(df, ["debt"], ["demand"], 10, ["id"]).orderBy("id").collect()] == [1, 0, 0]


def test_longest_phrase_wins(spark):
    df = spark.createDataFrame([(1, "net debt and debt".split())], "id int, tokens array<string>")
    got = match.longest_phrases(df, ["net debt", "debt", "net"], ["id"]).orderBy("start_idx").collect()
    assert [(r.start_idx, r.term) for r in got] == [(1, "net debt"), (2, "debt"), (4, "debt")]


def test_shares_and_prior(spark):
    rows = [("a", "CEO", 0.1, 0.3, 0.0, 0.6, 1), ("a", "CEO", 0.2, 0.2, 0.2, 0.4, 1), ("b", "IR", 0.0, 0.0, 0.0, 0.0, 2)]
    df = spark.createDataFrame(rows, "company string, role string, prob_risk_uncertainty double, prob_risk_legal double, prob_risk_constraint double, prob_risk_external double, z_label int")
    got = defaultdict(float)
    for r in cubes.shares(df, ["company", "role"]).collect():
        got[r.company] += r.a_mij
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0.0
    f = {(r.role, r.risk_bucket): r.f_ijz for r in cubes.log_ratio(cubes.pool(df, ["role", "z_label"])).collect()}
    a = 1 + min(5 / 2, 10)
    assert f[("CEO", "risk_legal")] == pytest.approx(math.log((0.5 + a) / a))


def test_split_cap_quartiles(spark):
    rows = [(str(k), 1 if k % 3 else 2, (k * 37 % 101) / 100) for k in range(203)] + [("x", 3, 0.5)]
    df = spark.createDataFrame(rows, "key string, y int, v double")
    n = Counter((r.y, r.split) for r in cubes.stratified_split(df, "y", "key").collect())
    assert n[(1, "validation")] == 27 and n[(2, "validation")] == 14 and n[(3, "validation")] == 1
    assert Counter(r.y for r in cubes.stratified_cap(df, "y", "key", 10).collect()) == {1: 10, 2: 10, 3: 1}
    number = lambda k: 9999 if k == "x" else int(k)
    order = [k for _, k in sorted((v, number(k)) for k, _, v in rows)]
    size, more = divmod(len(order), 4)
    want, at = {}, 0
    for q in range(4):
        for k in order[at : at + size + (q < more)]:
            want[k] = q + 1
        at += size + (q < more)
    numbered = df.withColumn("key", F.when(F.col("key") == "x", "9999").otherwise(F.col("key")).cast("int"))
    assert {r.key: r.quartile for r in cubes.quartiles(numbered, "v", "key").collect()} == want


def test_name_levels(spark):
    left = entities.named(spark.createDataFrame([("GTT Communications, Inc.",), ("Acme (R) Holdings",), ("Alpha Beta Gamma Corp",), ("Nothing",), (None,)], "n string"), "n")
    right = entities.named(spark.createDataFrame([("GTT COMM INC",), ("ACME HOLDINGS",), ("BETA ALPHA GAMMA DELTA",), ("",)], "n string"), "n")
    got = {r.name: (r.level, r.matched) for r in entities.match_levels(left, right).collect()}
    assert got == {"GTT Communications, Inc.": (2, "GTT COMM INC"), "Acme (R) Holdings": (1, "ACME HOLDINGS"), "Alpha Beta Gamma Corp": (3, "BETA ALPHA GAMMA DELTA")}


def test_wilson(spark):
    df = spark.createDataFrame([(38, 192), (0, 0)], "k int, n int")
    r = df.select(*[c.alias(n) for n, c in attribution.wilson(F.col("k"), F.col("n")).items()]).collect()
    assert r[0].low == pytest.approx(0.1478, abs=1e-3) and r[0].high == pytest.approx(0.2600, abs=1e-3) and tuple(r[1]) == (0.0, 0.0, 0.0)


def test_rebalance(spark):
    text = lambda k: "is this a question?" if k % 2 else "strategy and vision"
    rows = [(1, k, "IR", text(k)) for k in range(10)] + [(2, k, "CEO", text(k)) for k in range(10)] + [(3, k, "Treasurer" if k < 3 else "CFO", text(k)) for k in range(4)]
    df = spark.createDataFrame(rows, "call int, i int, role string, text string")
    got = {}
    for r in speakers.rebalance(df, "call", "i", "role", "text").orderBy("call", "i").collect():
        got.setdefault(r.call, []).append(r.role)
    # 1 Operator, 4 Analyst, 2 CEO, 2 CFO, 1 IR: the first sentence, the questions, the best of the rest
    assert got[1] == ["Operator", "Analyst", "CEO", "Analyst", "CEO", "Analyst", "CFO", "Analyst", "CFO", "IR"]
    assert got[2] == ["CEO"] * 10  # only IR and roles of no share are taken from
    assert got[3] == ["Operator", "Analyst", "CEO", "CFO"]


def test_role_targets_sum_to_the_sentences():
    from earshot.functions.fixed import ROLE_PRIORS

    assert speakers.role_targets(10, ROLE_PRIORS) == {"Operator": 1, "Analyst": 4, "CEO": 2, "CFO": 2, "IR": 1}
    assert all(sum(speakers.role_targets(n, ROLE_PRIORS).values()) == max(n, 5) for n in range(1, 400))


def test_participants_and_roles_of_a_transcript(spark):
    text = """Corporate Participants
Ana Bell - Chief Executive Officer
Carl Dent — CFO [2]
Eva Falk , Head of nothing known
Analysts
Max Moor - Oak Capital
Zed Young - Morgan Stanley
Nobody here
Presentation
Late Comer - Chief Operating Officer
"""
    df = spark.createDataFrame([(1, text + """Operator
Welcome to the call.
ANA BEL - Chief Executive Officer
We won.
======
We won again.
Q: And then?
Zed Young:
How so?
Lone Wolf - UBS
Fine.
"""), (2, None), (3, "No block - CEO")], "id int, text string")
    who = {r.id: {p["name"]: p["role"] for p in r.p} for r in df.where("id <> 2").select("id", speakers.participants(F.col("text")).alias("p")).collect()}
    assert who == {1: {"ana bell": "CEO", "carl dent": "CFO", "eva falk": "Head", "max moor": "Analyst", "zed young": "Analyst"}, 3: {}}
    parts = [(r.role, r.part) for r in speakers.transcript_roles(df.where("id = 1"), "id", "text").orderBy("part_no").collect()]
    assert parts[-5:] == [("CEO", "We won."), ("CEO", "We won again."), ("Analyst", "How so?"), ("Analyst", "Fine.")][-5:] or parts[-4:] == [("CEO", "We won."), ("CEO", "We won again."), ("Analyst", "How so?"), ("Analyst", "Fine.")]
    assert ("Operator", "Welcome to the call.") in parts
    assert speakers.transcript_roles(df.where("id = 2"), "id", "text").count() == 0
    old = spark.createDataFrame([(1, "Before.\nStranger Here:\nHello.\nUBS Person:\nOne.\nOperator\nNext.")], "id int, text string")
    roles = lambda **kw: [r.role for r in speakers.transcript_roles(old, "id", "text", **kw).orderBy("part_no").collect()]
    assert roles() == ["IR", "IR", "Analyst", "Operator"] and roles(start="Unknown", miss="Unknown", brokers=False) == ["Unknown", "Unknown", "Unknown", "Operator"]


def test_quantiles_and_quartiles_with_hot_values(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0.0, 0.0, 0.0, -3.5, 1e6, rng.random()])) for k in range(501)]
    df = spark.createDataFrame(rows, "k int, v double")
    ordered = sorted(v for _, v in rows)
    for q in (0.0, 0.25, 0.5, 0.8, 1.0):
        p = (len(ordered) - 1) * q
        lo, hi = ordered[math.floor(p)], ordered[math.ceil(p)]
        assert skew.exact_quantile(df, "v", q).first().edge == pytest.approx(lo + (hi - lo) * (p - math.floor(p)))
    assert skew.exact_quantile(df.limit(0), "v", 0.5).first().edge is None
    assert cubes.quartiles(df.limit(0), "v", "k").count() == 0


def test_fallback_labels(spark):
    df = spark.createDataFrame([(k, None, "x" * k) for k in range(8)], "k int, d double, t string")
    assert [r.risk_bucket for r in cubes.fallback_labels(df, "d", "t", "k").orderBy("k").collect()] == ["len_q1", "len_q1", "len_q2", "len_q2", "len_q3", "len_q3", "len_q4", "len_q4"]
    assert cubes.fallback_labels(df.withColumn("d", F.col("k") / 10), "d", "t", "k").orderBy("k").first().risk_bucket == "risk_q1"
    assert {r.risk_bucket for r in cubes.fallback_labels(df.withColumn("t", F.lit("same")), "d", "t", "k").collect()} == {"bin_a"}


def test_names_by_jaccard_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["alphas", "betass", "gammas", "deltas", "epsilo", "zetass", "etasss", "thetas"]
    make = lambda n: sorted({" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(n)})
    left, right = make(60), make(40)
    sets = lambda ns: {n: set(x.upper() for x in n.split()) for n in ns}
    got = {r.name: (r.matched, round(r.score, 9)) for r in entities.match_levels(entities.named(spark.createDataFrame([(n,) for n in left], "n string"), "n"), entities.named(spark.createDataFrame([(n,) for n in right], "n string"), "n")).where("level = 3").collect()}
    a, b = sets(left), sets(right)
    want = {}
    for n, s in a.items():
        if any(s == t for t in b.values()):
            continue
        best = min(((-len(s & t) / len(s | t), m) for m, t in b.items()), default=None)
        if best and -best[0] >= 0.6:
            want[n] = (best[1], round(-best[0], 9))
    assert got == want


def test_positional_zip(spark):
    df = spark.createDataFrame([(1, k, "CEO") for k in range(10)], "call int, i int, role string")
    zipped = speakers.positional_zip(df.select("call", "i"), df.where("i < 4").select("call", "i", "role"), "call", "i", "role").orderBy("i").collect()
    assert [r.role for r in zipped] == ["CEO"] * 4 + ["IR"] * 6


def test_score_of_one_row_is_defined(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    assert tone.z_scores(one, ["x"]).first().x_z == 0.0


def test_terms_of_any_signs(spark, monkeypatch):
    text = [(1, "A one-time refinancing, and net debt to  equity ratio."), (2, "One-time refinancings; 10-K filed. ｄｅｂｔ at 5 %"), (3, "a 110-k note, ｄｅｂｔｓ, the cash\xa0flow of a café loan"), (4, None)]
    df = spark.createDataFrame(text, "i int, s string")
    plain = spark.createDataFrame([("net debt to equity ratio",), ("note",)], "term string")
    others = spark.createDataFrame([("one-time refinancing",), ("10-k",), ("ｄｅｂｔ",), ("%",), ("cash\xa0flow",), ("café loan",)], "term string")
    got = sorted((r.i, r.term) for r in match.term_occurrences(df, plain, others, ["i"], "s").collect())
    monkeypatch.setattr(match, "BROADCAST_TERMS", 0)  # the way of a large dictionary
    assert sorted((r.i, r.term) for r in match.term_occurrences(df, plain, others, ["i"], "s").collect()) == got
    assert got == sorted([(1, "net debt to equity ratio"), (1, "one-time refinancing"), (2, "10-k"), (2, "ｄｅｂｔ"), (2, "%"), (3, "note"), (3, "cash\xa0flow"), (3, "café loan")])


def test_spread_join_equals_the_plain_join(spark):
    rng = random.Random(3)
    left = [("hot" if k % 3 else None if k % 7 == 0 else f"k{rng.randrange(9)}", k) for k in range(400)]
    right = [(rng.choice(["hot", None, *(f"k{j}" for j in range(9))]), k) for k in range(40)]
    a, b = spark.createDataFrame(left, "key string, x int"), spark.createDataFrame(right, "key string, y int")
    want = sorted((x, y) for k, x in left for j, y in right if k is not None and k == j)
    for most in (5, 10_000):
        assert sorted((r.x, r.y) for r in skew.spread_join(a, b, "key", "x", most).collect()) == want
    assert skew.spread_join(a.limit(0), b, "key", "x").count() == 0


def test_importance_summary_takes_modes_and_outer_peaks(spark):
    from datetime import date

    from earshot.operators import importance

    row = lambda r, c, te, tl, e, n: ("a", "cash", 2, r, r, c, c, 1.0, e, 0.5, e - 0.5, date(2009, 1, te), date(2010, 1, tl), None if n else date(2011, 1, 1), 5, 6)
    rows = [row("IR", "risk_legal", 3, 1, 0.0, True), row("CEO", "risk_external", 2, 9, 1.0, False), row("IR", "risk_external", 5, 4, 0.5, False), row(None, None, 7, 7, 0.5, True)]
    df = spark.createDataFrame(rows, "company string, term string, z_label int, role_early string, role_late string, cause_early string, cause_late string, term_score double, imp_early double, imp_late double, imp_delta double, time_early date, time_late date, event_date date, early_n_sent int, late_n_sent int")
    s = importance.summary(df)
    r = s.first()
    # the mode, not the least: CEO and risk_external come first in the alphabet
    assert (r.mode_role_early, r.mode_cause_late, r.n_rows, r.time_early, r.time_late, r.early_n_sent, r.imp_early) == ("IR", "risk_external", 4, date(2009, 1, 2), date(2010, 1, 9), 20, 0.5)
    assert importance.clean(s).count() == 1 and importance.clean(s, strict=True).count() == 0
