"""Sources and sinks: elements, private values and regions of HTML, images, JSON reports, processes and checked artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.sources.pages import in_viewport, page_elements, page_regions, private_values

__all__ = [
    "checked_artifacts", "directory_bytes", "flat_reports", "fresh", "image_bytes", "in_viewport", "paced", "page_elements", "page_regions", "passes", "private_values", "process_tree", "processes", "read_reports", "screenshots", "write_report",
]


def image_bytes(data_url: Column) -> Column:
    """Bytes of a base64 PNG or JPEG data URL; null for any other text."""
    pattern = r"^data:image/(?:png|jpeg);base64,([A-Za-z0-9+/]+={0,2})$"
    return F.when(data_url.rlike(pattern), F.unbase64(F.regexp_extract(data_url, pattern, 1)))


def checked_artifacts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, found and intact of each artifact of a manifest (name, path, sha256) against binary files (path, content)."""
    own = files.select("path", F.sha2("content", 256).alias("actual"))
    return manifest.join(own, "path", "left").select("name", F.col("actual").isNotNull().alias("found"), F.col("actual").eqNullSafe(F.lower("sha256")).alias("intact"))


def directory_bytes(files: DataFrame) -> DataFrame:
    """Sum of the sizes of binary files (length)."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def processes(lines: DataFrame, line: str = "value") -> DataFrame:
    """pid, ppid, rss_bytes and cpu of the lines of a process list (pid ppid rss-in-KiB cpu command)."""
    p = r"^\s*(\d+)\s+(\d+)\s+(\d+)\s+([0-9.]+)\s+(.*)$"
    part = lambda i: F.regexp_extract(line, p, i)
    return lines.filter(F.col(line).rlike(p)).select(part(1).cast("long").alias("pid"), part(2).cast("long").alias("ppid"), (part(3).cast("long") * 1024).alias("rss_bytes"), part(4).cast("double").alias("cpu"), part(5).alias("command"))


def process_tree(found: DataFrame, root: int) -> DataFrame:
    """The processes at and below a root, by a recursive query."""
    return found.sparkSession.sql(
        f"WITH RECURSIVE tree(pid) AS (SELECT pid FROM {{found}} WHERE pid = {int(root)} UNION ALL SELECT p.pid FROM {{found}} p JOIN tree t ON p.ppid = t.pid) "
        "SELECT p.* FROM {found} p JOIN tree USING (pid)", found=found,
    )


def read_reports(spark, path: str, schema: str) -> DataFrame:
    """JSON evidence, one object a file, by a schema; keys that are missing are null, files that are no JSON are null throughout."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def flat_reports(reports: DataFrame, json: str, depth: int = 8) -> DataFrame:
    """report, suite (path of titles), title, status and duration of every test of nested reports: JSON {title, suites, specs: [{title, tests:
    [{status, results: [{duration}]}]}]}, suites in suites to any depth up to `depth`, beyond which it is an error. The last result counts."""
    level = "struct<title:string,suites:array<string>,specs:array<struct<title:string,tests:array<struct<status:string,results:array<struct<duration:double>>>>>>>"
    at = reports.select(F.monotonically_increasing_id().alias("report"), F.lit("").alias("suite"), F.from_json(json, level).alias("s"))
    out = None
    for _ in range(depth):
        tests = at.select("report", "suite", F.explode("s.specs").alias("spec")).select("report", "suite", F.col("spec.title").alias("title"), F.explode("spec.tests").alias("t"))
        rows = tests.select("report", "suite", "title", F.col("t.status").alias("status"), F.try_element_at("t.results", F.lit(-1))["duration"].alias("duration"))
        out = rows if out is None else out.unionByName(rows)
        at = at.select("report", F.col("suite").alias("above"), F.explode("s.suites").alias("j")).select("report", "above", F.from_json("j", level).alias("s"))
        at = at.select("report", F.concat_ws(" > ", F.nullif("above", F.lit("")), F.coalesce("s.title", F.lit(""))).alias("suite"), "s")
    deeper = at.select("report", "suite", F.lit(None).cast("string").alias("title"), F.raise_error("reports nested too deeply").alias("status"), F.lit(None).cast("double").alias("duration"))
    return out.unionByName(deeper)


def write_report(report: DataFrame, path: str) -> None:
    """A report or a ledger as JSON lines, nulls kept."""
    report.write.option("ignoreNullFields", "false").json(path)


def passes(report: DataFrame, ok: Column) -> bool:
    """The gate of a report: whether every row meets a condition (null does not)."""
    return report.filter(~F.coalesce(ok, F.lit(False))).isEmpty()


def screenshots(spark, path: str) -> DataFrame:
    """path, taken (modification time), bytes and content of image files, streamed or read by Spark's binary source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(path)
    return files.select("path", F.col("modificationTime").alias("taken"), F.col("length").alias("bytes"), "content")


def paced(shots: DataFrame, by: str, at: str, least_ms: int = 600) -> DataFrame:
    """Adds early: a shot less than `least_ms` after the one before of the same window."""
    from pyspark.sql import Window

    now = F.unix_millis(F.col(at).cast("timestamp"))
    return shots.withColumn("early", F.coalesce(now - F.lag(now).over(Window.partitionBy(by).orderBy(at)) < least_ms, F.lit(False)))


def fresh(reports: DataFrame, at: str, main: Column, hours: int = 24) -> DataFrame:
    """Reports made within `hours` of the main one."""
    return reports.filter(F.abs(F.unix_millis(F.col(at).cast("timestamp")) - F.unix_millis(main)) < hours * 3_600_000)
