"""Experiment manifests as data: parse lines, key=value arguments, resolve against the
config batteries (broadcast equi-joins) and report dangling references before anything runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddone.operators.joins import checked_broadcast

# Fixed value: POSIX [[:space:]] as trimmed by the runner, and its field separators.
POSIX_SPACE = "[ \\t\\n\\x0B\\f\\r]"
VERSION_ARG = "version_dir="


def parse_manifest(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``(line_no, value)`` -> ``line_no, experiment, model, stimulus, version, log_name, args``;
    blank lines and lines starting with ``#`` (after trimming) are skipped."""
    t = F.regexp_replace(F.col(value_col), "^" + POSIX_SPACE + "+|" + POSIX_SPACE + "+$", "")
    kept = lines.withColumn("_t", t).filter((F.col("_t") != "") & ~F.startswith(F.col("_t"), F.lit("#")))
    tok = F.split(F.col("_t"), POSIX_SPACE + "+")
    last = F.element_at(tok, -1)
    version = F.regexp_replace(last, "^(.*?)" + VERSION_ARG, "$1")  # first occurrence only, like sed s///
    out = kept.select(
        "line_no", F.get(tok, 0).alias("experiment"), F.get(tok, 1).alias("model"), F.get(tok, 2).alias("stimulus"),
        version.alias("version"), F.slice(tok, 4, F.greatest(F.size(tok) - 3, F.lit(0))).alias("args"))
    return out.withColumn("log_name", F.concat_ws("_", "version", "model", "experiment"))\
        .withColumn("log_name", F.concat(F.col("log_name"), F.lit(".log")))


def args_map(args: Column) -> Column:
    """``key=value`` tokens -> map; split at the first ``=``; the last duplicate wins; tokens
    without ``=`` are ignored."""
    kv = F.filter(args, lambda a: F.contains(a, F.lit("=")))
    entries = F.transform(kv, lambda a: F.struct(F.substring_index(a, "=", 1).alias("key"),
                                                 F.substr(a, F.locate("=", a) + 1).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))),
                                                    lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)


def manifest_args(parsed: DataFrame) -> DataFrame:
    """One row per (line, argument key) with the winning value."""
    return parsed.select("line_no", F.explode(args_map(F.col("args"))).alias("key", "value"))


BATTERY_ROW_BYTES = 4096  # estimate per entry of a battery for the broadcast check


def _battery(battery: DataFrame, column: str) -> DataFrame:
    """A battery with its names as ``column``, broadcast while its counted size fits: the lines are never shuffled by the
    few names that most of them share."""
    return checked_broadcast(battery.withColumnRenamed("name", column), battery.count(), BATTERY_ROW_BYTES)


def resolve(parsed: DataFrame, models: DataFrame, experiments: DataFrame, stimuli: DataFrame | None = None) -> DataFrame:
    """Manifest lines joined to their model, experiment and (if given) stimulus configs; unknown names drop out."""
    out = parsed.join(_battery(experiments, "experiment"), "experiment").join(_battery(models, "model"), "model")
    return out if stimuli is None else out.join(_battery(stimuli, "stimulus"), "stimulus")


def dangling(parsed: DataFrame, models: DataFrame, experiments: DataFrame, stimuli: DataFrame | None = None) -> DataFrame:
    """Lines naming an unknown experiment, model or stimulus, with the first reason in this order: one pass over the lines."""
    out, reasons = parsed, []
    for column, battery in (("experiment", experiments), ("model", models), ("stimulus", stimuli)):
        if battery is not None:
            out = out.join(_battery(battery.select("name").distinct().withColumn(f"_{column}", F.lit(True)), column), column, "left")
            reasons.append(F.when(F.col(f"_{column}").isNull(), F.lit(f"unknown {column}")))
    return out.withColumn("reason", F.coalesce(*reasons)).filter("reason is not null").select("line_no", "experiment", "model", "reason")
