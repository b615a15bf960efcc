"""Extensions for data that keeps coming: an incremental manifest and running votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noria.operators import manifest
from noria.schemas import RAW_METADATA


def manifest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, limits: manifest.Limits = manifest.Limits()) -> StreamingQuery:
    """Classify each new JSON-lines file below ``source`` once; kept and dropped rows go to folders of their own.

    A batch that is run again after a failure replaces its own output.
    """
    rows = spark.readStream.schema(RAW_METADATA + ", split string").json(source).withColumnRenamed("text", "raw_text")

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = manifest.classify(batch, limits)
        manifest.kept(seen).write.mode("overwrite").parquet(f"{target}/kept/batch={batch_id}")
        manifest.reasons(seen).write.mode("overwrite").parquet(f"{target}/reasons/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_votes(votes: DataFrame) -> DataFrame:
    """Tallies of a stream of (word, v), for update mode."""
    return votes.groupBy("word").agg(F.count_if(F.col("v") > 0).alias("votes_ta"), F.count_if(F.col("v") < 0).alias("votes_ha"), F.count_if(F.col("v") == 0).alias("abstain"))


def stop_on_file(query: StreamingQuery, flag: str, every: float = 1.0) -> bool:
    """Wait for a stream; stop it once the file ``flag`` is there. Whether it was stopped so; a new start resumes from its checkpoint."""
    spark = SparkSession.getActiveSession()
    there = spark._jvm.org.apache.hadoop.fs.Path(flag)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    while query.isActive:
        if fs.exists(there):
            query.stop()
            return True
        query.awaitTermination(every)
    return False
