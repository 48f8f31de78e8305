"""Site-relative line dedup: a line on too large a share of a host's pages is boilerplate there.

Pages are counted per host and line (a line repeated in a page counts once), divided by the host's
pages, and lines over ``ratio`` on ``least_pages`` pages or more are dropped from that host's
pages. Lines are compared without surrounding spaces; blank lines are neither counted nor dropped.
A page of nothing but such lines is left empty; with ``keep_copies`` it is taken for a copy rather than a
frame, and kept whole. Of a text of any length only line hashes and flags are made, inside Spark's own functions.

A null host is a host of its own; a null text has no lines and stays null. Repeated rows are pages
of their own. An empty table gives an empty table. All other columns pass through (columns named
like the outputs are replaced).

Only lines' 64-bit hashes are shuffled, merged by each task first; a text is never moved while the
boilerplate is small. Its size is bounded per host by (mean lines per page) / ratio, whatever the
pages; over all hosts it is measured, and beyond ``BROADCAST_LINES`` the tables are joined by host
instead, where adaptive execution splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

RATIO, LEAST_PAGES = 0.1, 5
BROADCAST_LINES = 1_000_000

#: DuckDB SQL over a relation {docs} with doc_id, text, source.
KEPT_SQL = f"""
SELECT d.* EXCLUDE (lines, host, bad),
       CASE WHEN d.text IS NULL THEN NULL
            WHEN n_drop = 0 THEN d.text
            ELSE array_to_string(list_filter(lines, lambda x: NOT list_contains(bad, trim(x))), chr(10)) END AS kept,
       coalesce(len(lines), 0) AS n_lines,
       n_drop AS n_dropped
FROM (SELECT *, len(list_filter(coalesce(lines, []), lambda x: list_contains(bad, trim(x)))) AS n_drop
      FROM (SELECT p.*, coalesce(b.bad, []) AS bad
            FROM (SELECT *, string_split(text, chr(10)) AS lines, coalesce(source, '') AS host FROM {{docs}}) p
            LEFT JOIN (
              SELECT l.host, list(l.line) AS bad
              FROM (SELECT host, line, count(*) AS n
                    FROM (SELECT coalesce(source, '') AS host,
                                 unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS line
                          FROM {{docs}})
                    GROUP BY host, line) l
              JOIN (SELECT coalesce(source, '') AS host, count(*) AS pages FROM {{docs}} GROUP BY 1) t ON t.host = l.host
              WHERE l.n >= {LEAST_PAGES} AND l.n > {RATIO} * t.pages
              GROUP BY l.host) b ON b.host = p.host)) d
"""
ORACLE_SQL = f"SELECT doc_id, source, kept AS text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped FROM ({KEPT_SQL.format(docs='documents')})"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, text_col: str, host_col: str, ratio: float, least_pages: int) -> DataFrame:
    """host and its boilerplate lines' hashes."""
    host = F.coalesce(F.col(host_col), F.lit("")).alias("host")
    distinct = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col(text_col)), F.trim), lambda x: x != ""), lambda x: F.xxhash64(x)))
    counts = pages.select(host, F.explode(distinct).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    totals = pages.groupBy(host).agg(F.count("*").alias("pages"))
    return counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("bad"))


def drop_boilerplate(pages: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, keep_copies: bool = False) -> DataFrame:
    """pages with ``text_col`` without boilerplate lines, and n_lines, n_dropped."""
    pages = pages.drop("n_lines", "n_dropped")
    bad = scratch(boilerplate(pages, text_col, host_col, ratio, least_pages), "boilerplate")
    held = bad.agg(F.coalesce(F.sum(F.size("bad")), F.lit(0))).head()[0]
    if held <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    names, key, listed = pages.columns, _free(pages, "host"), _free(pages, "bad")
    joined = pages.withColumn(key, F.coalesce(F.col(host_col), F.lit(""))).join(bad.select(F.col("host").alias(key), F.col("bad").alias(listed)), key, "left")
    text = F.col(text_col)
    is_bad = lambda x: F.array_contains(F.col(listed), F.xxhash64(F.trim(x)))
    touched = F.coalesce(F.size(listed), F.lit(0)) > 0
    flagged = F.when(touched, F.size(F.filter(_lines(text), lambda x: (F.trim(x) != "") & is_bad(x)))).otherwise(0)
    whole = F.size(F.filter(_lines(text), lambda x: (F.trim(x) != "") & ~is_bad(x))) == 0 if keep_copies else F.lit(False)
    cut = F.array_join(F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~is_bad(x)), "\n")
    dropped = F.when((flagged > 0) & ~whole, flagged).otherwise(0)
    out = joined.withColumn("n_dropped", F.coalesce(dropped, F.lit(0)).cast("long")).withColumn("n_lines", F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long"))
    kept = F.when(F.col("n_dropped") > 0, cut).otherwise(text).alias(text_col)
    return out.select(*(kept if n == text_col else n for n in names), "n_lines", "n_dropped")


def _free(df: DataFrame, name: str) -> str:
    while name in {c.lower() for c in df.columns}:  # Spark doesn't tell names by case
        name += "_"
    return name


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "text", "n_lines", "n_dropped")
