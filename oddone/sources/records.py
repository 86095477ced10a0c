"""CSV whose quoted cells may hold line ends, read by many tasks a file.

A line end belongs to a cell if the quotes before it are odd in number. So the lines of each byte range are counted
first (one number per range: its quotes), running sums tell every range whether it begins inside a cell, and then
each range cuts its own lines into records. Only the pieces of a record that a range boundary cuts, at most two per
range, are put together in a shuffle; all other records stay where they were read.

Cells are parsed by Spark's own CSV parser. Quotes inside cells are doubled, as CSV writers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddone.operators.joins import broadcast_limit, checked_broadcast
from oddone.session import ensure_checkpoint_dir, ship_package

#: Estimate for the row that a byte range has in a broadcast.
RANGE_BYTES = 512


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order with their range and whether it begins in a cell -> ``file, block, seq, part, text``: whole
    records (``part`` 0), the end of a record of an earlier range (1: it ends here, 2: it goes on) and the start of one
    that this range does not finish (3). ``seq`` numbers the records that begin in the range."""
    out: list[list] = [[], [], [], [], []]
    at, lines, seq, head, odd = None, [], 0, False, False

    def emit(part: int, text: str) -> None:
        for column, value in zip(out, (*at, seq, part, text), strict=True):
            column.append(value)

    def flush() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["file", "block", "seq", "part", "text"])
        for c in out:
            c.clear()
        return done

    def close() -> None:
        if lines:  # the range ends inside a record
            emit(2 if head else 3, "\n".join(lines))

    for b in batches:
        for file, block, inside, line in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if (file, block) != at:
                close()
                at, lines, seq, head, odd = (file, block), [], 0, inside, inside
            lines.append(line)
            odd ^= line.count('"') % 2 == 1
            if not odd:
                text = "\n".join(lines)
                if head or text.strip():  # blank records are none
                    emit(1 if head else 0, text)
                    seq += not head
                lines, head = [], False
        yield flush()
    close()
    yield flush()


def read_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """``file, block, seq, record`` of the records of all files of ``path``: their text, the byte range in which they begin
    and their place (from 0) among the records that begin there. Blank lines between records are none."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    lines = spark.read.option("lineSep", "\n").options(**options).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q"))  # one row per byte range
    before = F.coalesce(F.sum("q").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("file", "block", (F.pmod(before, F.lit(2)) == 1).alias("inside")).checkpoint(eager=True)
    if ranges.count() * RANGE_BYTES <= broadcast_limit(spark):
        lines = lines.join(F.broadcast(ranges), ["file", "block"])  # leaves the lines in their order
    else:
        lines = lines.withColumn("at", F.monotonically_increasing_id()).join(ranges, ["file", "block"]).sortWithinPartitions("file", "block", "at")
    pieces = lines.select("file", "block", "inside", "value").mapInArrow(_cut, "file string, block long, seq long, part int, text string")
    whole = pieces.filter("part = 0").select("file", "block", "seq", F.col("text").alias("record"))
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.last(F.when(F.col("part") == 3, F.struct("block", "seq")), ignorenulls=True).over(order)
    torn = pieces.filter("part > 0").withColumn("home", begins).groupBy("file", "home").agg(
        F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("t"))
    torn = torn.select("file", "home.block", "home.seq", F.array_join("t.text", "\n").alias("record"))
    return whole.unionByName(torn).withColumn("record", F.regexp_replace("record", "\r$", ""))


def numbered(records: DataFrame, name: str) -> DataFrame:
    """``records`` (without their header rows) with a dense 0-based number in file order (path, byte range, place): each
    range's count moves, no record does."""
    counts = records.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per byte range
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    place = F.col("seq") - (F.col("block") == 0).cast("long")  # after the header
    offsets = checked_broadcast(offsets, counts.count(), RANGE_BYTES)
    return records.join(offsets, ["file", "block"]).withColumn(name, F.col("off") + place).drop("off")


def parse(records: DataFrame, header: list[str]) -> DataFrame:
    """``records`` with ``cells``, a struct of strings ``c0, c1, …`` in the order of ``header``; header rows go. A file whose
    first record is another header raises."""
    schema = ", ".join(f"c{k} string" for k in range(len(header)))
    cells = F.from_csv("record", schema, {"escape": '"', "multiLine": "true"})
    first = (F.col("block") == 0) & (F.col("seq") == 0)
    names = F.array(*[F.col(f"cells.c{k}") for k in range(len(header))])
    same = names == F.array(*[F.lit(h) for h in header])
    parsed = records.withColumn("cells", cells)
    fault = F.raise_error(F.concat(F.col("file"), F.lit(": its header is not "), F.lit(", ".join(header))))
    return parsed.filter(F.when(first, F.when(same, F.lit(False)).otherwise(fault.cast("boolean"))).otherwise(F.lit(True)))
