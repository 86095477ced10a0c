"""Exact deduplication against a persistent digest index.

The index is a table with one row per distinct normalised text (digest, the id that stays, rows seen),
bucketed and sorted by digest. New data is reduced to one row per digest with partial aggregation, so a
group of copies leaves each task as one row; a sort-merge anti-join on the bucketed digest finds the new
digests, and these are appended. The index side of that join is not shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from oddone.llm.common import staged

BUCKETS = 64
#: A digest with at least 1/HOT of all rows is joined by broadcast: there are at most HOT of them.
HOT = 1000
#: Repeats of a row that one array spells out.
COPIES = 4096


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text, null as empty, with each run of ASCII blanks replaced by one space."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), "UTF-8"), 256)


class DigestIndex:
    """The table ``name`` (columns ``digest``, ``keep_id``, ``batch``), made on the first append."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add those of ``groups`` (one row per ``digest``, with ``keep_id``) that the index lacks. A batch that
        was appended before, in whole or in part, changes nothing: its digests are there already."""
        new = groups.select("digest", "keep_id")
        if self.exists():
            new = new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))  # as the writer has it: a bucket is one task and one file a batch
        (new.withColumn("batch", F.lit(batch)).repartitionById(self.buckets, bucket).sortWithinPartitions("digest")
            .write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``digest, doc_id, times``: equal rows are counted before anything else, from here on a row is a distinct (digest, id)."""
    rows = docs.select(docs[id_col].alias("doc_id"), digest(docs[text_col]).alias("digest"))
    return staged(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times")), "digests")


def _judged(rows: DataFrame, groups: DataFrame, index: DigestIndex, own: Column) -> DataFrame:
    """The result for ``rows`` whose groups (``digest, group_size``) are in ``index``; ``own``: the entry is of these rows."""
    known = groups.join(index.read(), "digest")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = known.filter(F.col("group_size") * HOT >= F.lit(total)) if total >= HOT else known.limit(0)
    rest = known.filter(F.col("group_size") * HOT < F.lit(total)) if total >= HOT else known
    marked = rows.join(F.broadcast(hot.select("digest").withColumn("is_hot", F.lit(True))), "digest", "left")
    joined = (marked.filter("is_hot").drop("is_hot").join(F.broadcast(hot), "digest")
              .unionByName(marked.filter("is_hot is null").drop("is_hot").join(rest, "digest")))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & own
    # a row for each repeat, in two steps: no array grows with the number of repeats
    copies = joined.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES).cast("long"))))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("lot") * COPIES))))
    first = (F.col("lot") == 0) & (F.col("copy") == 1)
    return copies.select("doc_id", "keep_id", "group_size", (stays & first).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of the rows of ``docs`` with equal text the one with the smallest id stays, unless an earlier batch of
    ``index`` holds the text: then that batch's ``keep_id`` is given and none is kept. ``group_size`` counts
    the rows of ``docs``. A null text counts as empty. A null id loses to any other; if a group has only null
    ids, ``keep_id`` is null and one of its rows is kept. Of repeated rows (same id, same text) one is kept.
    An empty table gives an empty result. Other columns of ``docs`` are not read. Without ``index`` the rows are
    judged among themselves, by an index that goes when the result is written.
    """
    if index is None:
        return dedup_in_batches(docs, id_col=id_col, text_col=text_col)
    rows, batch = _digests(docs, id_col, text_col), batch or uuid.uuid4().hex
    groups = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size")), "groups")
    index.append(groups, batch)
    return _judged(rows, groups.select("digest", "group_size"), index, F.col("batch") == batch)


def dedup_in_batches(docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`dedup` of ``docs`` among themselves, fed to one index in ``batches`` of ascending ids, as they would come in: each
    is anti-joined with the digests of those before it and appended. So the first batch with a text holds its smallest
    id. Null ids come last; ids that are no numbers are one batch. The index is dropped once the result is written (below
    the shared folder)."""
    index, rows = DigestIndex(docs.sparkSession), _digests(docs, id_col, text_col)
    ids = rows.filter("doc_id is not null")
    batches = batches if isinstance(rows.schema["doc_id"].dataType, NumericType) else 1
    cuts = sorted(set(ids.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or [])) if batches > 1 else []
    place = F.lit(len(cuts)).cast("int")
    for k, cut in reversed(list(enumerate(cuts))):
        place = F.when(F.col("doc_id") <= F.lit(cut), F.lit(k)).otherwise(place)
    placed = rows.withColumn("batch", place)  # a null id is in the last one
    groups = staged(placed.groupBy("digest", "batch").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("n")), "groups")
    for k in range(len(cuts) + 1):
        index.append(groups.filter(F.col("batch") == k).drop("batch"), str(k))
    sizes = groups.groupBy("digest").agg(F.sum("n").alias("group_size"))
    result = staged(_judged(rows, staged(sizes, "sizes"), index, F.lit(True)), "dedup")
    index.drop()
    return result


def keep_first(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay under :func:`dedup`, with all their columns. Texts are shuffled once more only if a
    row that stays is repeated with the same id and text."""
    found = staged(dedup(docs, index, batch, id_col, text_col), "judged")
    keys = found.filter("kept").select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_digest"))
    name = next(f"__digest{k}" for k in range(len(docs.columns) + 1) if f"__digest{k}" not in docs.columns)
    marked = docs.withColumn(name, digest(docs[text_col]))
    kept = marked.join(keys, (F.col(name) == F.col("__keep_digest")) & F.col(id_col).eqNullSafe(F.col("__keep_id")), "left_semi")
    repeated = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("kept and n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([name])
    return kept.drop(name)
