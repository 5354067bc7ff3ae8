"""Keeps the lexical index up to date as contents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewake.operators.ingest import new_contents
from tracewake.operators.lexical import content_tokens


def arriving(contents: DataFrame, watermark: str = "1 hour", time: str = "arrived_at") -> DataFrame:
    """A stream of contents without repeats inside the watermark; state is bounded by it."""
    return contents.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["sha256"])


def maintain(contents: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Adds new contents to ``store/content``, their tokens to ``store/content_token`` and marks to ``store/indexed``.

    Each batch goes to a folder of its own, named by its number and written over if it is repeated, so a batch that
    is tried again after a failure leaves no second copy; marks come last.
    """
    spark = contents.sparkSession

    def known(batch: int) -> DataFrame:
        try:
            rows = spark.read.parquet(f"{store}/indexed")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return spark.createDataFrame([], "sha256 string, batch long")
            raise
        return rows.filter(F.col("batch") != batch)

    def run(frame: DataFrame, batch: int) -> None:
        fresh = new_contents(frame.select("sha256", "text"), known(batch).select("sha256")).persist()
        fresh.write.mode("overwrite").parquet(f"{store}/content/batch={batch}")
        content_tokens(fresh).write.mode("overwrite").parquet(f"{store}/content_token/batch={batch}")
        fresh.select("sha256").write.mode("overwrite").parquet(f"{store}/indexed/batch={batch}")
        fresh.unpersist()

    return contents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_counts(contents: DataFrame, watermark: str = "1 hour", window: str = "10 minutes", time: str = "arrived_at") -> DataFrame:
    """Occurrences of tokens in windows of time; late rows count until the watermark passes."""
    from tracewake.functions.text import tokenize

    tokens = contents.withWatermark(time, watermark).select(time, F.explode(tokenize(F.col("text"))).alias("token"))
    return tokens.groupBy(F.window(time, window), "token").agg(F.count("*").alias("n"))
