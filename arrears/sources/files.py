"""Sources (§2.1): source trees, lines with context, commit tables, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears.functions import patterns as P
from arrears.functions.text import extension


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, root: str, *, extensions: list[str] = P.EXTENSIONS, skipped: list[str] = P.SKIPPED_FOLDERS) -> DataFrame:
    """File (relative), ext, text of all source files; dot entries and skipped folders are left out by name."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    base = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    inner = F.substring(base, F.length(F.lit(root.rstrip("/"))) + 2, F.length(base))
    rows = files.select(inner.alias("file"), F.col("value").alias("text")).withColumn("ext", extension(F.col("file")))
    parts = F.split("file", "/")
    hidden = F.exists(parts, lambda x: x.startswith(".") | x.isin(skipped))
    return rows.where(F.col("ext").isin(extensions) & ~hidden)


def lines(df: DataFrame, text: str, *keep: str, context: int | None = None) -> DataFrame:
    """Line (from 1) and content of each text; with its context lines joined, if asked for. No shuffle: the lines around one
    are taken from its own text."""
    rows = df.select(*keep, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("_l"))
    if context is None:
        return rows.select(*keep, F.posexplode("_l").alias("_p", "content")).select(*keep, (F.col("_p") + 1).alias("line"), "content")
    around = lambda x, i: F.struct(
        (i + 1).alias("line"), x.alias("content"),
        F.array_join(F.slice("_l", F.greatest(i + 1 - context, F.lit(1)), F.least(i, F.lit(context)) + 1 + context), "\n").alias("context"),
    )
    return rows.select(*keep, F.inline(F.transform("_l", around)))


def parse_grep(row: Column) -> Column:
    """File, line, content of `file:line:text` (drive letters allowed)."""
    pattern = r"^((?:[A-Za-z]:)?[^:]*):(\d{1,9}):(.*)$"
    part = lambda i: F.regexp_extract(row, pattern, i)
    return F.struct(part(1).alias("file"), F.nullif(part(2), F.lit("")).cast("int").alias("line"), part(3).alias("content"))


def with_blame(candidates: DataFrame, blame: DataFrame) -> DataFrame:
    """Commit hash and date by (file, line); `untracked` and now otherwise."""
    return candidates.join(blame, ["file", "line"], "left").withColumn("hash", F.coalesce("hash", F.lit("untracked"))).withColumn("ts", F.coalesce("ts", F.current_timestamp()))


COMMITS = T.StructType([T.StructField("hash", T.StringType()), T.StructField("author", T.StringType()), T.StructField("email", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("message", T.StringType()), T.StructField("files", T.ArrayType(T.StringType())), T.StructField("diff", T.StringType())])


def commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMITS).json(path)


def parse_log(log: DataFrame, value: str = "value", at: str = "n") -> DataFrame:
    """Commits and files of a log of `hash|author|email|ISO time|message` headers followed by file names; rows in order of `at` within `source`."""
    from pyspark.sql import Window as W

    header = F.col(value).rlike(r"^[0-9a-f]{7,64}\|")
    rows = log.withColumn("_c", F.sum(header.cast("int")).over(W.partitionBy("source").orderBy(at)))
    field = lambda i: F.get(F.split(F.col(value), r"\|"), F.lit(i))
    return rows.groupBy("source", "_c").agg(
        F.max(F.when(header, field(0))).alias("hash"), F.max(F.when(header, field(1))).alias("author"), F.max(F.when(header, field(2))).alias("email"),
        F.max(F.when(header, field(3))).cast("timestamp").alias("ts"), F.max(F.when(header, field(4))).alias("message"),
        F.array_sort(F.collect_list(F.when(~header & (F.trim(value) != ""), F.col(value)))).alias("files"),
    ).drop("_c")


def last_commits(df: DataFrame, n: int = P.WINDOW) -> DataFrame:
    """A top-k, kept by task before it is gathered."""
    return df.orderBy(F.desc("ts"), F.desc("hash")).limit(n)


def commit_files(df: DataFrame) -> DataFrame:
    return df.select("hash", "author", "ts", F.explode("files").alias("file"))


def commits_after(df: DataFrame, snapshot: Column, months: float) -> DataFrame:
    """Commits in (snapshot, snapshot + months of 30.44 days]."""
    end = F.unix_micros(snapshot.cast("timestamp")) + int(months * 30.44 * 86_400_000_000)
    return df.where((F.col("ts") > snapshot) & (F.unix_micros(F.col("ts").cast("timestamp")) <= end))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All strings; quotes doubled."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)


def json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S13."""
    return spark.read.schema(schema).json(path, multiLine=True)


def config(path: str) -> dict:
    """A JSON project or pattern file, read on the driver."""
    import json as j

    with open(path) as f:
        return j.load(f)
