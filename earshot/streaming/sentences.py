"""A file stream of documents to sentences: stateless and document-local."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earshot.functions.text import metric_tokens, sentence_spans


def sentence_stream(spark: SparkSession, folder: str, schema: StructType, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Streaming ``key, sent_idx, sentence, token_len`` of the Parquet files that arrive in a folder."""
    documents = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)
    s = documents.select(key, F.posexplode(sentence_spans(F.col(text))).alias("i", "sentence"))
    return s.select(key, (F.col("i") + 1).alias("sent_idx"), "sentence", F.size(metric_tokens(F.col("sentence"))).alias("token_len"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work through what is there and stop; a restart goes on from the checkpoint, each file once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
