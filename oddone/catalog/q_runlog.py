"""Run-log queries: K5/X22 format, S8 parse, A7 summary (events read as a timing log)."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddone.catalog import query
from oddone.catalog.fixtures import read
from oddone.functions.runlog import format_line, parse_line
from oddone.plans.runlog import summarize

# events as timing records: name = event_type, secs = value, host = host<user_id % 16>,
# a failed call = an 'error' event, its message built from props.
def log_records(spark, d):
    ev = read(spark, d, "events")
    ok = F.col("event_type") != "error"
    return ev.select("event_id", F.col("ts"), F.col("event_type").alias("name"), ok.alias("ok"),
                     F.col("value").alias("secs"),
                     F.concat(F.lit("host"), F.pmod("user_id", F.lit(16)).cast("string")).alias("host"),
                     F.when(~ok, F.concat(F.lit("ValueError: "), F.col("props"))).alias("error"))


def log_lines(spark, d):
    r = log_records(spark, d)
    return r.select("event_id", format_line("ts", "name", "ok", "secs", "host", "error").alias("line"))


_LINE_SQL = """lines AS (
  SELECT event_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') || chr(9) || event_type || chr(9) || 'ok='
         || CASE WHEN event_type <> 'error' THEN 'True' ELSE 'False' END || chr(9) || 'secs=' || printf('%.3f', value)
         || chr(9) || 'host=host' || (user_id % 16)
         || CASE WHEN event_type = 'error' THEN chr(9) || 'error="ValueError: ' || props || '"' ELSE '' END AS line
  FROM events)"""

_PAT = r'^([^\t]*)\t([^\t]*)\tok=(True|False)\tsecs=([-0-9.]+)\thost=([^\t]*)(?:\terror="(.*)")?$'


@query("runlog_format", f"WITH {_LINE_SQL} SELECT event_id, line FROM lines")
def q_runlog_format(spark, d):
    return log_lines(spark, d)


def parsed_log(spark, d):
    lines = log_lines(spark, d)
    f = parse_line("line")
    return lines.select("event_id", *[v.alias(k) for k, v in f.items()])


@query("runlog_parse", f"""WITH {_LINE_SQL}
SELECT event_id, strftime(strptime(regexp_extract(line, '{_PAT}', 1), '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts_text,
       regexp_extract(line, '{_PAT}', 2) AS name, regexp_extract(line, '{_PAT}', 3) = 'True' AS ok,
       TRY_CAST(regexp_extract(line, '{_PAT}', 4) AS DOUBLE) AS secs, regexp_extract(line, '{_PAT}', 5) AS host,
       CASE WHEN regexp_extract(line, '{_PAT}', 3) = 'False' THEN regexp_extract(line, '{_PAT}', 6) END AS error
FROM lines""")
def q_runlog_parse(spark, d):
    p = parsed_log(spark, d)
    return p.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "name", "ok", "secs",
                    "host", "error")


@query("runlog_summary", """
SELECT event_type AS name, event_type <> 'error' AS ok, count(*) AS calls,
       round(sum(round(value, 3)), 3) AS total_secs, round(avg(round(value, 3)), 6) AS mean_secs,
       max(round(value, 3)) AS max_secs, round(quantile_cont(round(value, 3), 0.5), 6) AS p50,
       round(quantile_cont(round(value, 3), 0.95), 6) AS p95, round(quantile_cont(round(value, 3), 0.99), 6) AS p99
FROM events GROUP BY 1, 2""")
def q_runlog_summary(spark, d):
    return summarize(parsed_log(spark, d))
