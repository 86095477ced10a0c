"""Resolve model generations as they arrive: ``readStream`` -> cleaning / matching columns ->
``writeStream``.  No state is kept, so no watermark is needed; the sink's checkpoint location
gives exactly-once output files across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oddone.functions.text import clean_generation, match_first, resolve_choice

GENERATION_SCHEMA = ("id long, head string, y string, z string, text string, raw string")


def resolve_generations(df: DataFrame, strip_prompt_echo: bool = True) -> DataFrame:
    """``(id, head, y, z, text, raw)`` -> ``id, head, winner, loser, raw_generation`` (batch or stream)."""
    cleaned = clean_generation(F.col("text"), F.col("raw"), strip_prompt_echo)
    out = df.withColumn("raw_generation", cleaned)
    w, l_ = resolve_choice(match_first(F.col("raw_generation"), F.col("y"), F.col("z")), F.col("y"), F.col("z"))
    return out.select("id", "head", w.alias("winner"), l_.alias("loser"), "raw_generation")


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, fmt: str = "parquet",
          trigger_once: bool = False) -> StreamingQuery:
    """Stream generation files from ``source`` into resolved answers at ``sink``."""
    stream = spark.readStream.schema(GENERATION_SCHEMA).format(fmt).load(source)
    writer = (resolve_generations(stream).writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
