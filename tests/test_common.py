from pyspark.sql import functions as F

from earshot.operators import common, importance, lexicon, terms


def test_distance_and_weight(spark):
    df = spark.createDataFrame([(0.0, 3.0, 0.9), (None, 2.0, 0.9), (None, None, 0.9), (None, None, None)], "near1 double, near2 double, sim double")
    dist = common.risk_distance(None, [F.col("near1"), F.col("near2")], [F.col("sim")])
    got = [(round(r.d, 6), round(r.w, 6)) for r in df.select(dist.alias("d"), common.sample_weight(dist).alias("w")).collect()]
    assert got == [(0.0, 1.0), (2.0, 0.05), (0.1, 0.9), (1.0, 0.05)]


def test_collapse_and_split(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, None)], "a double, b double, c double, d double")
    out = common.collapse_labels({"Q2": F.col("a"), "legal_x": F.col("b"), "zzz": F.col("c"), "macro": F.col("d")})
    row = df.select(*[c.alias(n) for n, c in out.items()]).first()
    assert round(row.risk_legal, 6) == 0.3 and row.risk_uncertainty == 0.3 and row.risk_external == 0.0
    coefs = spark.createDataFrame([(1, "CEO|risk_legal", 0.5), (1, "prior_z2", 0.2), (1, "Intercept", 9.0)], "z_label int, feature string, coef double")
    beta, gamma = common.split_coefficients(coefs)
    assert [tuple(r) for r in beta.collect()] == [("CEO", "risk_legal", 1, 0.5)] and [tuple(r) for r in gamma.collect()] == [(1, 2, 0.2)]


def test_lookup_reindex_union_type(spark):
    rows = spark.createDataFrame([("Ab Inc",), ("Cd Ltd",), ("Zz",), (None,)], "company string").where("company is not null")
    docs = spark.createDataFrame([(5, "Ab Inc"), (3, "Cd Corp"), (4, "Cd AG"), (1, None)], "doc_id int, company string")
    first = F.substring_index("company", " ", 1)
    got = {r.company: (r.doc_id, r.how) for r in common.lookup_with_fallback(rows, docs, "company", "doc_id", first, first).collect()}
    assert got == {"Ab Inc": (5, "exact"), "Cd Ltd": (3, "prefix"), "Zz": (None, "none")}
    domain = spark.createDataFrame([("x",), ("y",)], "k string")
    assert {(r.k, r.v) for r in common.reindex(spark.createDataFrame([("x", 2.0)], "k string, v double"), domain, ["k"], ["v"]).collect()} == {("x", 2.0), ("y", 0.0)}
    a, b = spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int"), spark.createDataFrame([("y", 2)], "k string, v int")
    assert {(r.k, r.v) for r in common.union_last_wins(a, b, "k", "v").collect()} == {("x", 1), ("y", 2)}
    typed = spark.createDataFrame([("d1", None, "/a/Type_2/x"), ("d2", None, "/a/x"), ("d3", "Type_1", "/a/Type_2/x")], "doc string, source_type string, path string")
    known = spark.createDataFrame([("d2", "Type_3")], "doc string, source_type string")
    assert {r.doc: r.source_type for r in common.with_type(typed, "source_type", "path", known, "doc").collect()} == {"d1": "Type_2", "d2": "Type_3", "d3": "Type_1"}


def test_terms_fall_back_to_all(spark):
    feats = spark.createDataFrame([("cash flow", 3, 2, 0.7, 0, 1, 0, 0), ("cash breach", 3, 2, 0.7, 0, 1, 1, 0), ("cash default", 3, 2, 0.7, 0, 1, 0, 1), ("the year", 2, 1, 0.0, 0, 0, 0, 0)], "term string, freq_total int, n_docs int, doc_entropy double, in_lexicon int, core_hits int, in_risk int, risk_hits int")
    assert terms.filter_and_score(feats, 30, 5).count() == 4
    assert [r.term for r in terms.filter_and_score(feats, 2, 1).collect()] == ["cash flow"]


def test_boring(spark):
    df = spark.createDataFrame([("last year", 0), ("cash year", 0), ("the cash", 0), ("odd words", 0), ("odd words", 1), ("million", 1)], "t string, f int")
    assert [r.b for r in df.select(terms.boring(F.col("t"), F.col("f")).alias("b")).collect()] == [True, False, True, True, False, True]


def test_core_tokens_and_clean(spark):
    fin = spark.createDataFrame([(f"cash t{k}",) for k in range(6)], "term string")
    risk = spark.createDataFrame([(f"cash u{k}",) for k in range(2)] + [(f"loss v{k}",) for k in range(5)], "term string")
    assert {(r.token, r.core) for r in lexicon.core_tokens(fin, risk).collect()} == {("cash", "financial"), ("loss", "risk")}
    rows = spark.createDataFrame([(0.0, 1.0, 1.0, "d"), (1.0, 2.0, 1.0, "d"), (1e-9, 0.0, 0.0, "d"), (1.0, 2.0, 1.0, None)], "imp_early double, imp_late double, imp_delta double, event_date string")
    assert importance.clean(rows).count() == 2 and importance.clean(rows, strict=True).count() == 1
