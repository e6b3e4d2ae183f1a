"""Queries of problems 3, 4, 6, 7 and 8 and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftloom.llm import encoding, leakage, matching, packing, quantiles
from draftloom.session import read, stage

UNRESOLVED = "00-0000000"
VALID_POINTS = (-20.0, 100.0)


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing with the player_id it belongs to, or none, and a confidence."""
    c = F.col
    shared = {"name": c("name"), "position": c("position"), "team": c("team"), "birth_date": c("birth_date"), "college": c("college"), "jersey": c("jersey_number"), "rookie": c("rookie_season")}
    listings = stage(matching.prepared(read(spark, sf_dir, "source_listings"), {"listing_id": c("listing_id"), "source_id": c("source_id")}, shared), "match-listings")
    players = read(spark, sf_dir, "players").where(c("player_id").isNotNull() & (c("player_id") != UNRESOLVED))
    entities = stage(matching.prepared(players, {"record_id": c("roster_row_id"), "player_id": c("player_id")}, shared), "match-entities")
    return matching.match(listings, entities)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).where("player_id is not null").select("player_id", "listing_id")


def _points_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = read(spark, sf_dir, "player_weeks")
    c = F.col
    return quantiles.sketch(weeks, c("fantasy_points_ppr"), {"position": F.upper(F.trim("position")), "season": c("season"), "day": F.to_date("loaded_at").cast("string")}, valid=VALID_POINTS)


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fantasy_points_ppr at each probability of each grid: by position, position and season, position and day loaded."""
    finest = _points_sketch(spark, sf_dir)
    level = F.explode(F.array(F.lit("position"), F.lit("position_season"), F.lit("position_day")))
    c = F.col
    levels = finest.withColumn("level", level).select("level", "position", F.when(c("level") == "position_season", c("season")).alias("season"), F.when(c("level") == "position_day", c("day")).alias("day"), "sign", "bucket", "n")
    groups = ["level", "position", "season", "day"]
    merged = quantiles.merge([levels], groups)
    grids = read(spark, sf_dir, "distribution_grids").select("schema_version", F.posexplode("probabilities").alias("place", "probability"))
    asked = [r[0] for r in grids.select("probability").distinct().limit(quantiles.MAX_PROBABILITIES + 1).collect()]
    found = quantiles.percentiles(merged, groups, asked)
    return found.join(F.broadcast(grids), "probability").select(*groups, "schema_version", "place", "probability", F.round("value", 6).alias("value"), "n", "rejected", F.lit(quantiles.ERROR).alias("relative_error"))


def p4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable state: bucket counts by position, season and day loaded."""
    return _points_sketch(spark, sf_dir)


_BUCKETS = f"""
WITH rows_ AS (
  SELECT upper(trim(position)) AS position, season, CAST(CAST(loaded_at AS DATE) AS VARCHAR) AS day, fantasy_points_ppr AS x,
    CASE WHEN fantasy_points_ppr IS NULL THEN 1 WHEN isnan(fantasy_points_ppr) OR isinf(fantasy_points_ppr) THEN 2
         WHEN fantasy_points_ppr NOT BETWEEN {VALID_POINTS[0]} AND {VALID_POINTS[1]} THEN 3 END AS lost FROM player_weeks),
sketch AS (
  SELECT position, season, day,
    CAST(CASE WHEN lost IS NOT NULL THEN 9 WHEN abs(x) <= 1e-9 THEN 0 WHEN x > 0 THEN 1 ELSE -1 END AS INTEGER) AS sign,
    CAST(CASE WHEN lost IS NOT NULL THEN lost WHEN abs(x) <= 1e-9 THEN 0 ELSE ceil(ln(abs(x)) / CAST({math.log(quantiles.gamma())!r} AS DOUBLE)) END AS INTEGER) AS bucket,
    count(*) AS n FROM rows_ GROUP BY ALL)
"""
P4_SKETCH_SQL = _BUCKETS + "SELECT * FROM sketch"
P4_SQL = (
    _BUCKETS
    + f""", merged AS (
  SELECT 'position' AS level, position, CAST(NULL AS INTEGER) AS season, CAST(NULL AS VARCHAR) AS day, sign, bucket, sum(n) AS n FROM sketch GROUP BY ALL
  UNION ALL SELECT 'position_season', position, season, NULL, sign, bucket, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 'position_day', position, NULL, day, sign, bucket, sum(n) FROM sketch GROUP BY ALL),
totals AS (SELECT level, position, season, day, coalesce(sum(n) FILTER (sign <> 9), 0) AS total, coalesce(sum(n) FILTER (sign = 9), 0) AS rejected FROM merged GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, position, season, day ORDER BY sign, CASE WHEN sign < 0 THEN -bucket ELSE bucket END) AS c FROM merged WHERE sign <> 9),
grid AS (SELECT schema_version, CAST(i - 1 AS INTEGER) AS place, probabilities[i] AS probability FROM distribution_grids, range(1, len(probabilities) + 1) t(i) WHERE probabilities[i] BETWEEN 0 AND 1)
SELECT t.level, t.position, t.season, t.day, g.schema_version, g.place, g.probability,
  round(CASE WHEN c.sign = 0 THEN 0.0 ELSE c.sign * CAST({2 / (quantiles.gamma() + 1)!r} AS DOUBLE) * pow(CAST({quantiles.gamma()!r} AS DOUBLE), c.bucket) END, 6) AS value,
  CAST(t.total AS BIGINT) AS n, CAST(t.rejected AS BIGINT) AS rejected, CAST({quantiles.ERROR} AS DOUBLE) AS relative_error
FROM totals t CROSS JOIN grid g
LEFT JOIN cum c ON c.level = t.level AND c.position IS NOT DISTINCT FROM t.position AND c.season IS NOT DISTINCT FROM t.season AND c.day IS NOT DISTINCT FROM t.day
  AND floor(g.probability * (t.total - 1)) >= c.c - c.n AND floor(g.probability * (t.total - 1)) < c.c"""
)


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    return [(r["target_id"], r["token_capacity"]) for r in read(spark, sf_dir, "packing_targets").select("target_id", "token_capacity").collect()]


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of each capacity of packing_targets."""
    return packing.pack(read(spark, sf_dir, "documents"), _targets(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, sf_dir), read(spark, sf_dir, "packing_targets"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each affected document with the items that leaked into it, where and with how many edits."""
    return leakage.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.spans(read(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with their text as far as it can be restored."""
    docs = read(spark, sf_dir, "documents")
    return encoding.restore(docs, stage(encoding.spans(docs), "damage-spans"))


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_restored": p8_restored, "p3_found": p3_found, "p3_matches": p3_matches, "p4_percentiles": p4_percentiles, "p4_sketch": p4_sketch, "p6_packed": p6_packed, "p6_fill": p6_fill}
ORACLE = {"p4_percentiles": P4_SQL, "p4_sketch": P4_SKETCH_SQL}
