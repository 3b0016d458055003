import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import FOLDER, compare, connect  # noqa: E402

from earshot.llm import queries as llm  # noqa: E402

COLUMNS = {
    "p1_found": ["rec_no", "group_no"],
    "p2_found": ["block_id", "start_pos", "end_pos"],
    "p3_found": ["call_id", "sentence_id"],
    "p4_found": ["term", "n_occ", "n_calls", "mark"],
    "p5_found": ["call_id", "first_sentence_id", "speaker", "n_words"],
    "p6_found": ["name_a", "name_b"],
    "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, llm.queries()[name], llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query_runs_with_its_columns(spark, name):
    connect()
    df = llm.queries()[name](spark, FOLDER)
    assert df.columns == COLUMNS.get(name, df.columns)
    df.write.format("noop").mode("overwrite").save()
