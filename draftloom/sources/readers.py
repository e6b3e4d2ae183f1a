"""Readers for the file kinds draft data comes in, and writers that never leave half a result."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.operators.ranks import cumulative


def read_csv_union(spark: SparkSession, paths: list[str], required: list[str], schema: str | None = None) -> DataFrame:
    """CSV files (plain or gzip) with headers as one table by column name; a file without a required column is an error."""
    out = None
    for path in paths:
        reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
        df = reader.schema(schema).csv(path) if schema else reader.csv(path)
        lost = [c for c in required if c not in df.columns]
        if lost:
            raise ValueError(f"{path} lacks {', '.join(lost)}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_seasons(spark: SparkSession, pattern: str, schema: str, required: list[str], least: int = 5) -> DataFrame:
    """Season files of a glob as one table; too few files, or one without a required column, is an error.

    Headers are looked at file by file, so that a column may stand elsewhere or be missing in some.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    paths = sorted(f.getPath().toString() for f in found)
    if len(paths) < least:
        raise ValueError(f"{pattern} has {len(paths)} files, at least {least} are needed")
    x = read_csv_union(spark, paths, required)
    kinds = [f.strip().split(" ") for f in schema.split(",")]
    return x.select(*[(F.col(n).try_cast(k) if n in x.columns else F.lit(None).cast(k)).alias(n) for n, k in kinds])


def read_depth_charts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(player_id, team, rank, at): depth charts of two schemas, told apart by the columns a file has.

    The older one has gsis_id, club_code, depth_team and week, the newer gsis_id, team, pos_rank and dt. Anything else
    is an error.
    """
    c = F.col
    old, new = {"gsis_id", "week", "depth_team", "club_code"}, {"gsis_id", "dt", "pos_rank", "team"}
    parts: dict[str, list[str]] = {"old": [], "new": []}
    for path in paths:
        have = set(spark.read.option("header", True).csv(path).columns)
        kind = "new" if new <= have else "old" if old <= have else None
        if kind is None:
            raise ValueError(f"{path} is no depth chart of a known schema")
        parts[kind].append(path)
    out = spark.createDataFrame([], "player_id string, team string, rank int, at string")
    if parts["old"]:
        x = read_csv_union(spark, parts["old"], sorted(old))
        out = out.unionByName(x.select(c("gsis_id").alias("player_id"), c("club_code").alias("team"), c("depth_team").try_cast("int").alias("rank"), F.lpad("week", 2, "0").alias("at")))
    if parts["new"]:
        x = read_csv_union(spark, parts["new"], sorted(new))
        out = out.unionByName(x.select(c("gsis_id").alias("player_id"), "team", c("pos_rank").try_cast("int").alias("rank"), c("dt").alias("at")))
    return out


def write_manifest(df: DataFrame, path: str) -> tuple[str, int]:
    """A feed with what proves it whole: (digest, rows) to go into its manifest. The digest does not depend on row order."""
    df.write.parquet(path)
    return feed_digest(df.sparkSession.read.parquet(path))


def feed_digest(df: DataFrame) -> tuple[str, int]:
    each = df.select(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    row = each.agg(*parts, F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256("|".join(str(row[f"s{i}"]) for i in range(4)).encode()).hexdigest(), row["n"]


def read_verified(spark: SparkSession, path: str, digest: str, rows: int) -> DataFrame:
    """A published feed, if it is what its manifest says; an error if not."""
    df = spark.read.parquet(path)
    if feed_digest(df) != (digest, rows):
        raise ValueError(f"{path} is not what its manifest says")
    return df


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema: nothing is inferred, a line that does not parse is null in every field."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_tree(spark: SparkSession, pattern: str, schema: str, keys: dict[str, str]) -> DataFrame:
    """Files of a directory tree whose path carries keys; ``keys``: name -> regular expression with one group."""
    df = spark.read.schema(schema).json(pattern).withColumn("__path", F.input_file_name())
    for name, pattern_ in keys.items():
        df = df.withColumn(name, F.regexp_extract("__path", pattern_, 1))
    return df.drop("__path")


def parse_csv_text(text: Column, schema: str) -> Column:
    """One CSV record held in a column, quote-aware."""
    return F.from_csv(text, schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})


def csv_records(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, names, cells): every data line of the comma-delimited files of (file_id, line_no, line).

    A file's first line that is neither blank nor a comment is its header; it is comma-delimited if no other delimiter
    is commoner there. Blank and comment lines and repeated headers are no data. Cells stand under their names; a short
    line ends in nulls, an empty cell is null, quoted or not, and cells beyond the header follow at the end.
    """
    c = F.col
    text = lines.select("file_id", "line_no", F.regexp_replace("line", "^\ufeff", "").alias("line")).where((F.trim("line") != "") & ~c("line").startswith("#"))
    count = lambda d: F.length("header") - F.length(F.replace("header", F.lit(d), F.lit("")))
    header = text.groupBy("file_id").agg(F.min_by("line", "line_no").alias("header"))
    header = header.where(~F.ltrim("header").startswith("{") & (count(",") >= F.greatest(F.lit(1), *[count(d) for d in ";|\t"])))
    rows = text.join(header, "file_id").where(c("line") != c("header"))
    commas = lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))
    # no line has more cells than commas and one, so none is cut
    width = (rows.agg(F.max(F.greatest(commas("line"), commas("header")))).first()[0] or 0) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = lambda x: (lambda r: F.array(*[r[f"c{i}"] for i in range(width)]))(parse_csv_text(c(x), schema))
    last = lambda a: F.coalesce(F.array_max(F.transform(a, lambda v, i: F.when(v.isNotNull(), i + 1))), F.lit(0))
    both = rows.select("file_id", "line_no", cells("header").alias("n"), cells("line").alias("v"))
    named = both.withColumn("names", F.slice("n", F.lit(1), last(c("n"))))
    return named.select("file_id", "line_no", F.transform("names", F.trim).alias("names"), F.slice("v", F.lit(1), F.greatest(F.size("names"), last(c("v")))).alias("cells"))


def html_cells(html: Column) -> Column:
    """The rows of an HTML table as arrays of cell texts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), "&nbsp;", " "), "&amp;", "&"))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), clean))


def write_once(df: DataFrame, root: str, name: str) -> str:
    """A snapshot under a name made from its content: the same content is written once, later calls find it there."""
    digest = df.select(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256).alias("d")).agg(F.sum(F.conv(F.substring("d", 1, 12), 16, 10).cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    path = f"{root.rstrip('/')}/{name}_{hashlib.sha256(f'{digest[0]}|{digest[1]}'.encode()).hexdigest()[:24]}"
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path + "/_SUCCESS")
    if not target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target):
        df.write.mode("overwrite").parquet(path)
    return path


def prune(files: DataFrame, series: str, at: list[Column], size: str, most_per_series: int, most_bytes: int) -> DataFrame:
    """Which files retention keeps: the newest of each series, and of those the newest that fit into the space."""
    place = F.row_number().over(Window.partitionBy(series).orderBy(*at))
    kept = files.withColumn("__fits", place <= most_per_series)
    # bytes so far over all files in order, by slices, so that no task sees them all
    run = cumulative(kept, [], at, {"__bytes": F.when(F.col("__fits"), F.col(size)).otherwise(0)})
    return run.withColumn("keep", F.col("__fits") & (F.col("__bytes_upto") <= most_bytes)).select(*files.columns, "keep")
