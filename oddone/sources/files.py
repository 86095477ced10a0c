"""File sources of the reference's inputs.

Row position is data for the concept table and the vector matrix (matrix row i belongs to
concept row i), so both readers attach a dense ``row_idx`` in file order once, at ingest:
order = (file path, start of the byte range, position inside it).  The ranges are counted and
their offsets joined back, one row per range; the rows themselves are not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddone.operators.indexing import dense_index
from oddone.operators.joins import checked_broadcast
from oddone.session import ensure_checkpoint_dir
from oddone.sources.records import RANGE_BYTES, numbered, parse, read_records

ANSWER_TOKENS_SCHEMA = T.StructType([
    T.StructField("head", T.StringType()), T.StructField("winner", T.StringType()),
    T.StructField("loser", T.StringType()), T.StructField("raw_generation", T.StringType())])

LINE_BYTES = 512  # estimate per manifest line for the broadcast check

ANSWER_LOGITS_SCHEMA = T.StructType([
    T.StructField("head", T.StringType()), T.StructField("winner", T.StringType()),
    T.StructField("loser", T.StringType()), T.StructField("lp_y1", T.DoubleType()),
    T.StructField("lp_z1", T.DoubleType()), T.StructField("y_tok", T.IntegerType()),
    T.StructField("z_tok", T.IntegerType())])


def with_file_order(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Dense 0-based row number in file order (path, range start, position in the range) for the rows of a text file
    reader, also after a filter. Only the count of each byte range moves: no row is shuffled."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    tagged = tagged.withColumn("_m", F.monotonically_increasing_id())  # rises by one from row to row of a range
    ensure_checkpoint_dir(df.sparkSession)
    ranges = tagged.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first")).checkpoint(eager=True)
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per byte range
    offsets = ranges.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    offsets = checked_broadcast(offsets, ranges.count(), RANGE_BYTES)
    return tagged.join(offsets, ["_f", "_b"]).withColumn(name, F.col("_m") + F.col("_off")).drop("_f", "_b", "_m", "_off")


def _csv(spark: SparkSession, path: str, columns: list[str], **options) -> DataFrame:
    """CSV with a header (quoted cells may hold newlines and doubled quotes), all strings, columns found by name:
    their order in the files doesn't matter, a column that is not there raises, and files of one folder whose
    headers differ fail to read instead of being taken by position."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    df = reader.options(**options).csv(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df


def read_concepts(spark: SparkSession, path: str, columns: list[str], key_col: str) -> DataFrame:
    """Concept table (CSV with header), the named columns as strings, plus ``row_idx`` and ``key``. A file is read by many
    tasks, and its rows are numbered without being moved."""
    header = _csv(spark, path, [*columns, key_col]).columns
    df = numbered(parse(read_records(spark, path), header), "row_idx")
    return df.select(*[F.col(f"cells.c{header.index(c)}").alias(c) for c in columns], "row_idx",
                     F.col(f"cells.c{header.index(key_col)}").alias("key"))


def _bodies(lines: DataFrame, value_col: str) -> DataFrame:
    """The lines that are neither blank nor all comment, as ``_t`` (``numpy.loadtxt`` defaults)."""
    body = F.regexp_replace(F.regexp_replace(F.col(value_col), "#.*$", ""), "^\\s+|\\s+$", "")
    return lines.withColumn("_t", body).filter(F.col("_t") != "")


def _floats() -> Column:
    return F.transform(F.split(F.col("_t"), "\\s+"), lambda x: x.cast("double")).alias("vec")


def parse_matrix_lines(lines: DataFrame, order: str | list = "line_no", value_col: str = "value") -> DataFrame:
    """Whitespace float rows of a table of lines -> ``(row_idx, vec)``; ``#`` comments and blank lines skipped.  Only the
    kept lines are numbered, in the order given."""
    order = [order] if isinstance(order, str) else order
    kept = _bodies(lines.select(*order, F.col(value_col).alias("_v")), "_v")
    return dense_index(kept, order, "row_idx").select("row_idx", _floats())


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Reference-vector text file -> ``(row_idx, vec ARRAY<DOUBLE>)``; lines are numbered without being moved."""
    return with_file_order(_bodies(spark.read.text(path), "value")).select("row_idx", _floats())


def check_matrix(mat: DataFrame) -> None:
    """All rows must have the same dimension (``loadtxt`` raises otherwise)."""
    dims = mat.select(F.size("vec").alias("d")).distinct().limit(2).collect()
    if len(dims) > 1:
        raise ValueError("matrix rows have different numbers of columns")


def read_answers(spark: SparkSession, path: str, logits: bool = False, run_from_file: bool = False) -> DataFrame:
    """Answer CSVs (header; quoted cells may hold newlines and doubled quotes).
    With ``run_from_file`` each file is a run named by its base name (folder mode).
    A file of any size is read by many tasks (:mod:`oddone.sources.records`)."""
    schema = ANSWER_LOGITS_SCHEMA if logits else ANSWER_TOKENS_SCHEMA
    only = {"pathGlobFilter": "*.csv", "recursiveFileLookup": "false"}
    header = _csv(spark, path, schema.names, **only).columns
    df = parse(read_records(spark, path, **only), header)
    run = [run_name(F.url_decode(F.replace(F.regexp_extract("file", "[^/]*$", 0), F.lit("+"), F.lit("%2B")))).alias("run")] if run_from_file else []
    return df.select(*[F.col(f"cells.c{header.index(f.name)}").cast(f.dataType).alias(f.name) for f in schema], *run)


def read_results(spark: SparkSession, path: str, lines: DataFrame, keys: tuple = ("version", "model", "stimulus"), fmt: str = "parquet", **options) -> DataFrame:
    """The rows of a table written by ``keys`` that belong to manifest ``lines``.  The lines are broadcast after a count, and
    the scan is pruned to their partitions at run time."""
    table = spark.read.format(fmt).options(**options).load(path)
    wanted = lines.select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()
    return table.withColumns({k: F.col(k).cast("string") for k in keys if dict(table.dtypes)[k] != "string"}).join(
        checked_broadcast(wanted, wanted.count(), LINE_BYTES), list(keys))


def run_name(file_name: Column) -> Column:
    """Base name of an answer file (``x.csv`` -> ``x``)."""
    return F.regexp_replace(file_name, "\\.csv$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 1-based line number in file order (unterminated last line kept)."""
    return with_file_order(spark.read.text(path), "line_no").select((F.col("line_no") + 1).alias("line_no"), "value")


def read_config(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Config JSON (object of objects) -> one row per entry ``(name, <struct fields>)``."""
    doc = spark.read.text(path, wholetext=True)
    return explode_config(doc, "value", value_schema)


def explode_config(df: DataFrame, json_col: str, value_schema: str) -> DataFrame:
    m = F.from_json(F.col(json_col), f"map<string,{value_schema}>")
    return df.select(F.explode(m).alias("name", "cfg")).select("name", "cfg.*")


MODEL_SCHEMA = ("struct<model_name:string,tokenizer_name:string,do_chat_template:boolean,model_load:string,"
                "answer_format:string,choose_mode:string,params:string>")
STIM_SCHEMA = "struct<items_tsv:string,human_embeddings:string,src_key:string>"
EXP_SCHEMA = ("struct<instruct_prompt:string,n_items:int,euclid_min:double,euclid_max:double,batch_size:int,"
              "d:int,max_epochs:int,embeddings_name:string>")
