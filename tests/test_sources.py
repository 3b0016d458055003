import pytest
from pyspark.sql import functions as F

from earshot.sources import lexicons, sinks, tabular, transcripts
from earshot.streaming.sentences import run_available, sentence_stream


def test_transcripts(spark, tmp_path):
    for z, name, text in [(1, "A+B, Inc._2010-08-12_Q2 2010", "One.\nTwo."), (3, "Uni S (R)_2011-01-02_Q4 2010", "Document Viewer")]:
        (tmp_path / f"Type_{z}").mkdir()
        (tmp_path / f"Type_{z}" / f"{name}.txt").write_text(text)
    rows = {r.z_label: r for r in transcripts.quality(transcripts.read_transcripts(spark, str(tmp_path)), 20).collect()}
    assert rows[1].company == "A+B, Inc." and rows[1].company_id == "A+B" and rows[1].text == "One.\nTwo." and rows[1].quarter == 2
    assert rows[3].company == "Uni S (R)" and rows[3].source_type == "Type_3" and rows[3].is_stub
    ranked = spark.createDataFrame([("k", "raw", 1), ("k", "Indexed", 2), ("k", None, 3)], "key string, kind string, id int")
    assert transcripts.best_variant(ranked, ["key"], "kind").first().id == 2


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Sentence Text;Speaker\nHi; CEO\n".encode())
    (tmp_path / "b.csv").write_bytes("text,role\nné,CFO\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"x")
    (tmp_path / "d.csv").write_bytes('text|role|x\n"a|b\nc"|IR|1\nshort|row\n你好|分析师|2\n'.encode("gb18030"))
    paths = [str(tmp_path / f"{n}.csv") for n in "abcd"]
    got = tabular.read_all(spark, paths, ["text", "role"])
    assert sorted((r.text, r.role) for r in got.collect()) == [("Hi", "CEO"), ("a|b\nc", "IR"), ("né", "CFO"), ("你好", "分析师")]
    assert [r.path[-5:] for r in tabular.skipped_files(spark, paths).collect()] == ["c.csv"]
    assert tabular.read_delimited(spark, paths[3]).columns == ["text", "role", "x"] and tabular.read_delimited(spark, paths[2]) is None
    with pytest.raises(ValueError, match="missing columns: y"):
        tabular.require(spark.range(1), ["y"])
    df = spark.createDataFrame([("1.5", "Yes"), ("x", None)], "a string, b string")
    assert [tuple(r) for r in df.select(tabular.number("a"), tabular.truth("b")).collect()] == [(1.5, True), (0.0, False)]


def test_lexicons(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"b": ["x", "y", "x"], "a": ["z"]}')
    (tmp_path / "l.json").write_text('["p", "q"]')
    m = lexicons.read_lexicon_json(spark, str(tmp_path / "m.json"))
    assert sorted(map(tuple, m.collect())) == [("a", "z"), ("b", "x"), ("b", "y")]
    assert sorted(r.term for r in lexicons.read_lexicon_json(spark, str(tmp_path / "l.json")).collect()) == ["p", "q"]
    assert sinks.lexicon_json(m).first().value == '{"a":["z"],"b":["x","y"]}'
    (tmp_path / "p.txt").write_text("mail a@b won@positive\nno label\n")
    assert [tuple(r) for r in lexicons.read_phrases(spark, str(tmp_path / "p.txt")).collect()] == [("mail a@b won", "positive")]
    (tmp_path / "s.csv").write_text("bucket,term\nx, a \nx,a\n,b\n")
    assert [(r.bucket, r.term) for r in lexicons.read_standardized(spark, str(tmp_path / "s.csv")).collect()] == [("x", "a")]


def test_sinks(spark, tmp_path):
    df = spark.range(6).withColumn("g", F.col("id") % 2)
    sinks.write_table(df, str(tmp_path / "t"), ["g"])
    assert spark.read.parquet(str(tmp_path / "t")).where("g = 1").count() == 3
    sinks.write_delimited(df, str(tmp_path / "c"))
    sinks.write_json_rows(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 6 == spark.read.json(str(tmp_path / "j")).count()
    old = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "stage string, key string, value int")
    new = spark.createDataFrame([("s", "b", 3)], "stage string, key string, value int")
    assert {(r.key, r.value) for r in sinks.merged_statistics(old, new).collect()} == {("a", 1), ("b", 3)}
    assert [r.id for r in sinks.preview(df, ["id"], 2).collect()] == [0, 1] and sinks.skipped(df, df.where("id < 4"), "id").count() == 2


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame([(1, "One. Two."), (2, None)], "doc_id bigint, text string")
    df.write.parquet(src)
    run_available(sentence_stream(spark, src, df.schema), out, state)
    spark.createDataFrame([(3, "Three.")], df.schema).write.mode("append").parquet(src)
    run_available(sentence_stream(spark, src, df.schema), out, state)
    assert sorted((r.doc_id, r.sent_idx, r.sentence) for r in spark.read.parquet(out).collect()) == [(1, 1, "One. "), (1, 2, "Two."), (3, 1, "Three.")]


def test_loaders_and_registry(spark, tmp_path):
    (tmp_path / "a_mij__sentence_ctx.csv").write_text("Company,Speaker,Bucket,Share\nAcme,chief financial officer,q2 legal,0.5\nAcme,ceo,nothing,0.1\n,ceo,legal,0.2\nAcme,IR,macro,x\n")
    (tmp_path / "bankrupt  all.csv").write_text("CONM;DLDTE\nAcme;3/14/2009\n;2009-01-01\nBell;never\n")
    (tmp_path / "recurring_terms.csv").write_text("company,term,main_speaker_role,term_score,time_early,is_significant\nAcme,cash,CFO,1.5,2009-01-02,True\nAcme,,CFO,1,,0\n")
    a = tabular.load_artefact(spark, str(tmp_path), "a_mij")
    assert sorted((r.role, r.risk_bucket, r.a_mij) for r in a.collect()) == [("CFO", "risk_legal", 0.5), ("IR", "risk_external", 0.0)]
    e = tabular.load_artefact(spark, str(tmp_path), "events")
    assert sorted((r.conm, str(r.event_date)) for r in e.collect()) == [("Acme", "2009-03-14"), ("Bell", "None")]
    t = tabular.load_artefact(spark, str(tmp_path), "terms").collect()
    assert [(r.term, r.main_role, r.term_score, str(r.time_early), r.time_late, r.is_significant) for r in t] == [("cash", "CFO", 1.5, "2009-01-02", None, True)]
    with pytest.raises(KeyError):
        tabular.load_artefact(spark, str(tmp_path), "nothing")
