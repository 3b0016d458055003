"""The streaming query: stages that are local to a document, run over what has arrived."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from earshot.session import ensure_checkpoint_dir
from earshot.plans.text_queries import METRIC, SENT
from earshot.sources.tables import table
from earshot.streaming.sentences import run_available, sentence_stream

Q, O = {}, {}


def streaming_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by a file stream; output and stream state go to the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/streams/{uuid.uuid4().hex}"
    schema = table(spark, d, "documents", "doc_id", "text").schema
    path = f"{d}/documents.parquet"
    # a table of one file is streamed through its folder
    folder = f"{d}/documents.parque[t]" if os.path.isfile(path) else path
    run_available(sentence_stream(spark, folder, schema), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


Q["streaming_sentences"] = streaming_sentences
_TOKENS = METRIC.replace("text", "s[i]")
# a stream that has read everything holds what the batch holds
O["streaming_sentences"] = f"SELECT doc_id, CAST(i AS INT) AS sent_idx, s[i] AS sentence, CAST(len({_TOKENS}) AS INT) AS token_len FROM (SELECT doc_id, regexp_extract_all(text, '{SENT}') AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)"
