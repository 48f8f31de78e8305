"""Files in, files out: text folders, JSON manifests, delimited record logs, versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .commits import Conflict, Files

MANIFEST = "path string, sha256 string, mtime double, size bigint"
# Fields and marks of a record in a log.
RECORD = "record_id string, parent_id string, created_at_utc string, input_text string, output_text string, source string, input_hash string, output_hash string, active_retrieval_brief_title string, active_retrieval_brief string, active_retrieval_brief_contributor_ids array<string>"
START, END = "----- MEMORY RECORD START -----", "----- MEMORY RECORD END -----"
ACCEPTED = (".txt", ".md")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, text, sha256, mtime, size of all files below a folder: UTF-8, or Latin-1 where the bytes aren't. Spark lists and reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(
        "path",
        F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"),
        F.sha2("content", 256).alias("sha256"),
        F.unix_millis("modificationTime").cast("double").alias("mtime") / 1000,
        F.col("length").alias("size"),
    ).toDF("path", "text", "sha256", "mtime", "size")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def accepted(files: DataFrame) -> DataFrame:
    """With ``reason``: null for files of an accepted type."""
    ok = F.lit(False)
    for suffix in ACCEPTED:
        ok = ok | F.lower(F.col("path")).endswith(suffix)
    return files.withColumn("reason", F.when(~ok, "unsupported file type"))


def embedded_files(manifest: DataFrame) -> DataFrame:
    return manifest.select(base_name(F.col("path")).alias("name")).distinct().orderBy(F.lower("name"), "name")


def projects(*listings: DataFrame) -> DataFrame:
    """Names in any of the listings, each once, sorted."""
    out = listings[0].select("name")
    for x in listings[1:]:
        out = out.union(x.select("name"))
    return out.distinct().orderBy("name")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a JSON manifest; none where there is no manifest; a broken one is an error."""
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    top = spark.read.schema(f"version string, generated_at string, files array<struct<{MANIFEST.replace(' string', ':string').replace(' double', ':double').replace(' bigint', ':bigint')}>>").option("mode", "FAILFAST").json(path, multiLine=True)
    return top.select(F.explode(F.coalesce("files", F.array())).alias("f")).select("f.*")


def published(spark: SparkSession, root: str) -> list[str]:
    """Names of a table's version markers, their numbers, in the order of their publication."""
    return sorted(Files(spark, root).names("versions"))


def publish(df: DataFrame, root: str, after: int | None = None) -> str:
    """A new version of a table under root. It is current once a marker of its number, which holds its name, is there.

    Markers are only added, whole and only if their number is free, so a crash at any point leaves the version before
    current, readers never see half of one, and of two publishers at once each gets a number of its own. A version
    that was computed from another gives its number as ``after`` (-1: none): then a third one in between is a conflict.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    while True:
        before = published(spark, root)
        number = int(before[-1]) + 1 if before else 0
        if after is not None and number != after + 1:
            raise Conflict(root)
        if Files(spark, root).create(f"versions/{number:012d}", version):
            return version


def current(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The current version of a table; with a schema, an empty one where none was published."""
    if found := published(spark, root):
        return spark.read.parquet(f"{root}/{Files(spark, root).read(f'versions/{found[-1]}')}")
    if schema:
        return spark.createDataFrame([], schema)
    raise FileNotFoundError(f"nothing was published under {root}")


def remove_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all but the last versions, data before markers; names of what went. Snapshots are copies and stay."""
    files, gone = Files(spark, root), []
    for marker in published(spark, root)[: -max(keep, 1)]:
        gone.append(files.read(f"versions/{marker}"))
        files.delete(gone[-1])
        files.delete(f"versions/{marker}")
    return gone


def write_metainfo(info: DataFrame, path: str) -> None:
    """One JSON object per file, replacing what was there; Spark writes them, a part per task."""
    info.write.mode("overwrite").json(path)


def snapshot(spark: SparkSession, root: str, stamp: str) -> str:
    """The current version copied by Spark to a named snapshot."""
    target = f"{root}/snapshots/{stamp}"
    current(spark, root).write.parquet(target)
    return target


def parse_records(text: Column) -> Column:
    """Records of a delimited log; blocks that aren't JSON objects are left out."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s){START}\\n(.*?)\\n{END}"), 1)
    parsed = F.transform(blocks, lambda b: F.from_json(b, RECORD))
    return F.filter(parsed, lambda r: r["record_id"].isNotNull())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    logs = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return logs.select("file", F.explode(parse_records(F.col("value"))).alias("r")).select("file", "r.*")


def render_record(record: Column) -> Column:
    return F.concat(F.lit(f"{START}\n"), F.to_json(record), F.lit(f"\n{END}\n"))


def append_records(records: DataFrame, path: str) -> None:
    """Blocks appended as new part files of a log folder."""
    write_records(records, path, "append")


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Blocks of records in a log folder, replacing what it holds unless the mode says otherwise."""
    records.select(render_record(F.struct(*records.columns)).alias("value")).write.mode(mode).text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def routed(events: DataFrame, sinks: DataFrame) -> DataFrame:
    """Log events for each sink that takes their type and sensitivity; sinks are a short list."""
    takes = F.array_contains("types", F.col("type")) & F.array_contains("levels", F.col("level"))
    return events.join(F.broadcast(sinks), takes).select("sink", *events.columns)


def write_sinks(events: DataFrame, sinks: DataFrame, root: str) -> None:
    """Log events appended as JSON lines, a folder per sink that takes them."""
    routed(events, sinks).write.mode("append").partitionBy("sink").json(root)


def project_of(path: Column) -> Column:
    return strip(F.element_at(F.split(path, "/"), -2))
