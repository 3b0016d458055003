import pytest
from oracle import FOLDER, compare, connect

from earshot.plans import queries as plans
from earshot.plans.base import sentences

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, plans.queries()[name], SQL[name])


@pytest.mark.parametrize("name", ["role_rebalance", "speaker_name_match", "participants_header", "transcript_roles", "risk_classifier", "outcome_report", "surrogate_logit", "fitted_prob_contrib"])
def test_query_runs(spark, name):
    connect()
    assert plans.queries()[name](spark, FOLDER).count() > 0


def test_every_speaker_has_a_role(spark, tmp_path):
    spark.createDataFrame([("C.E.O.",), ("C.E.O.",), ("cfo",), (None,)], "speaker string").write.parquet(f"{tmp_path}/term_occ.parquet")
    got = {(r.speaker, r.role): r.n for r in plans.queries()["role_normal"](spark, str(tmp_path)).collect()}
    assert got == {("C.E.O.", "C.e.o."): 2, ("cfo", "CFO"): 1, (None, "Unknown"): 1}


def test_names_of_labels_in_every_style(spark, tmp_path):
    full = ["Ines Delvaforn (Chief Financial Officer)", "[00:15] Yara Voszeråde, Oakhaven Capital, Analyst", "00:48:58.406 --> 00:48:59.000 <Q - Edward Quen - Oakhaven Capital>", "Oskar Fen – Head of Investor Relations"]
    names = ["Ines Delvaforn", "Yara Voszeråde", "Edward Quen", "Oskar Fen"]
    styles = [(" ines  delvaforn ", 0), ("Yara Voszerade:", 1), ("Y. Voszeråde", 1), ("Quen, Edward", 2), ("OSKAR FEN -", 3), ("(52:24) Oskar B. Fen", 3), ("<A - Ines Delvafron>", 0), ("Operator", None), ("", None)]
    rows = [(1, x) for x in full] + [(1, x) for x, _ in styles] + [(1, None), (2, "Oskar Fen")]
    spark.createDataFrame(rows, "call_id int, speaker string").write.parquet(f"{tmp_path}/call_lines.parquet")
    got = {(r.call_id, r.speaker): r.matched for r in plans.queries()["speaker_name_match"](spark, str(tmp_path)).collect()}
    assert got == {(1, x): n for x, n in zip(full, names)} | {(1, x): None if k is None else names[k] for x, k in styles} | {(2, "Oskar Fen"): None}


def test_every_known_role_is_zipped(spark):
    connect()
    s = sentences(spark, FOLDER).select("call_id", "role", "sentence_id").toPandas().sort_values(["call_id", "sentence_id"])
    got = {(r.call_id, r.sentence_id): r.role for r in plans.queries()["role_positional_zip"](spark, FOLDER).collect()}
    want = {}
    for call, rows in s.groupby("call_id"):
        known = [r for r in rows.role if r != "Unknown"]
        want |= {(call, k): r for k, r in zip(rows.sentence_id, known + ["IR"] * len(rows))}
    assert got == want
