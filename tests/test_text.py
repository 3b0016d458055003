import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.functions import roles
from earshot.functions import text as T
from earshot.plans import text_queries


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_sentence_spans(spark):
    text = 'He said "hi." Then left!  Q4 up 3.5%. tail no end'
    got = one(spark, text, T.sentence_spans)
    assert got == ['He said "hi." ', "Then left!  ", "Q4 up 3.", "5%. ", "tail no end"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .!?\n。”"), max_size=40), min_size=1, max_size=20))
def test_spans_and_merge_keep_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = df.select("x", F.array_join(T.sentence_spans(F.col("x")), "").alias("a"), F.array_join(T.merge_short(T.sentence_spans(F.col("x"))), "").alias("b")).collect()
    assert all(r.a == r.x and r.b == r.x for r in rows)


def test_merge_short(spark):
    got = one(spark, "Ok. This is a longer sentence here. Yes. Another longer sentence follows here. No.", lambda c: T.merge_short(T.sentence_spans(c)))
    assert got == ["Ok. This is a longer sentence here. Yes. ", "Another longer sentence follows here. No."]


def test_headers(spark):
    text = "PARTICIPANTS\n\nWe grew.\r\n\r\n00:12:30\n\nBIG TITLE\n\n(Operator Instructions) Thanks.\n\nA copyright note"
    assert one(spark, text, T.drop_headers) == "We grew.\n\n  Thanks."


def test_protected(spark):
    assert one(spark, "It was ~5% e.g. ~e~g~ this \ue000 year.", T.protected_sentences) == ["It was ~5% e.g. ~e~g~ this \ue000 year."]
    assert one(spark, "Mr. X of the U.S. won, e.g. twice. Fine! a", T.protected_sentences) == ["Mr. X of the U.S. won, e.g. twice.", "Fine!"]


def test_tokens_and_grams(spark):
    assert one(spark, "Net-Debt rose 3.5% in Q4", T.metric_tokens) == ["net-debt", "rose", "3", "5", "in", "q4"]
    assert one(spark, "a b c", lambda c: T.ngrams(F.split(c, " "), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: T.ngrams(F.split(c, " "), 2)) == []
    assert one(spark, "the million cash", T.content_gram) == "cash"


@pytest.mark.parametrize("label,want", [("Q1", "risk_uncertainty"), ("prob_risk_legal", "risk_legal"), ("Macro!", "risk_external"), ("sc_near_risk_ratio", None), (None, None)])
def test_canonical_risk(spark, label, want):
    assert one(spark, label, T.canonical_risk) == want


@pytest.mark.parametrize("text,want", [("Vice President, Sales", "President"), ("Director", "CTO"), ("C.F.O.", ""), ("Chief Financial Officer", "CFO"), ("", ""), (None, "")])
def test_roles(spark, text, want):
    assert one(spark, text, roles.canonical_role) == want


def test_dates_and_parts(spark):
    for text, want in [("x 2011-11-10 y", "2011-11-10"), ("id20200304.pdf", "2020-03-04"), ("3-mar-2014", "2014-03-03"), ("4/5/2010", "2010-04-05"), ("2011-13-40", None), (None, None)]:
        assert one(spark, text, lambda c: T.parse_date(c).cast("string")) == want
    df = spark.createDataFrame([("Luby's, Inc._2011-11-10_Q4 2011",), ("odd name",)], "d string")
    rows = df.select(*[c.alias(n) for n, c in T.document_parts(F.col("d")).items()]).collect()
    assert (rows[0].company, rows[0].company_id, str(rows[0].file_date), rows[0].quarter, rows[0].fiscal_year) == ("Luby's, Inc.", "Luby's", "2011-11-10", 4, 2011)
    assert rows[1].file_date is None and rows[1].quarter is None


def test_top_labels(spark):
    row = spark.createDataFrame([(0.2, 0.5, 0.2)], "a double, b double, c double").select(T.top_labels({"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, 2).alias("t"), T.first_max({"a": F.col("a"), "c": F.col("c")}).alias("m")).first()
    assert row.t == "b:0.500; a:0.200" and row.m == "a"


def test_headers_of_every_script(spark):
    text = "ÉTATS FINANCIERS\n \nOur café “grew”.\n\nQ & A\n\nSTRAßE\n\n 00:12:30\n\n業績は好調。\n\nNº 5"
    assert one(spark, text, T.drop_headers) == "Our café “grew”.\n\nSTRAßE\n\n業績は好調。\n\nNº 5"


def test_header_query_has_every_text(spark, tmp_path):
    texts = ["PARTICIPANTS\n\nWe grew.", "PARTICIPANTS\n\nIt’s café time.", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in text_queries.header_paragraph_filter(spark, str(tmp_path)).collect()}
    assert got == {0: "We grew.", 1: "It’s café time.", 2: ""}
