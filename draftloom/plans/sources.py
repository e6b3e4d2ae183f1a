"""Queries over projection sources: scores, weights, blends, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftloom.operators import consensus
from draftloom.session import read

c = F.col


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    named = _lines(spark, d).join(read(spark, d, "supplier").select("s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey"))
    return consensus.score_sources(named, "s_name", c("l_extendedprice"), c("l_extendedprice") * (1 - c("l_discount")), 20)


def source_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("s_name", "samples", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


def source_weights_inverse_mse(spark: SparkSession, d: str) -> DataFrame:
    return consensus.inverse_mse_weights(_scores(spark, d), 50).select("s_name", F.round("weight", 9).alias("weight"))


def source_weights_equal(spark: SparkSession, d: str) -> DataFrame:
    chosen = _lines(spark, d).where(c("l_suppkey") % 7 == 0).select("l_suppkey").distinct()
    return chosen.crossJoin(F.broadcast(chosen.agg(F.count(F.lit(1)).alias("n")))).select("l_suppkey", F.round(1 / c("n"), 9).alias("weight"))


def ensemble_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    weight = (1 + c("l_suppkey") % 5).cast("double")
    p = c("l_extendedprice")
    low, high = F.when(c("l_linenumber") != 1, p * 0.8), F.when(c("l_linenumber") != 2, p * 1.2)
    out = consensus.blend(_lines(spark, d), ["l_partkey"], weight, {"mean": p, "floor": F.coalesce(low, p * 0.7), "ceiling": F.coalesce(high, p * 1.3)})
    return out.select("l_partkey", *[F.round(x, 6).alias(x) for x in ("mean", "floor", "ceiling")])


def consensus_renormalized(spark: SparkSession, d: str) -> DataFrame:
    # fixed values: base weights of the four sources
    base = F.element_at(F.array(*[F.lit(x) for x in (1.15, 1.0, 0.9, 0.85)]), (c("l_suppkey") % 4 + 1).cast("int"))
    known = _lines(spark, d).where(c("l_returnflag") != "N").withColumn("source", c("l_suppkey") % 4)
    each = known.groupBy("l_partkey", "source").agg(F.avg("l_extendedprice").alias("points"), F.max(base).alias("w"))
    return consensus.blend(each, ["l_partkey"], c("w"), {"points": c("points")}).select("l_partkey", F.round("points", 6).alias("points"), F.round("weight", 6).alias("weight"))


def consensus_min_two_sources(spark: SparkSession, d: str) -> DataFrame:
    few = _lines(spark, d).where(c("l_quantity") > 40)
    return consensus.at_least_sources(few, "l_partkey", "l_suppkey", c("l_extendedprice"), 2).select("l_partkey", "sources", F.round("points", 6).alias("points"))


def leave_one_source_out(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).withColumn("source", c("l_suppkey") % 6)
    return consensus.leave_one_out(rows, "l_partkey", "source", "l_extendedprice").select("l_partkey", "source", F.round("own", 8).alias("own"), F.round("peers", 8).alias("peers"))


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    mean = _lines(spark, d).groupBy("l_partkey").agg(F.round(F.avg(c("l_extendedprice") / c("l_quantity")), 6).alias("seen"))
    return read(spark, d, "part").join(mean, c("p_partkey") == c("l_partkey")).select("p_partkey", "p_type", c("p_retailprice").alias("target"), (c("seen") - c("p_retailprice")).alias("residual"))


def knn_local_bias(spark: SparkSession, d: str) -> DataFrame:
    return consensus.neighbour_bias(_residuals(spark, d), "p_type", "p_partkey", "target", "residual").select("p_partkey", F.round("bias", 6).alias("bias"))


def calibration_tanh(spark: SparkSession, d: str) -> DataFrame:
    out = consensus.neighbour_bias(_residuals(spark, d), "p_type", "p_partkey", "target", "residual")
    kept = 16 * F.tanh(0.35 * (c("residual") - c("bias")) / 16)
    return out.select("p_partkey", F.round(F.greatest(F.lit(0.0), c("target") + kept), 6).alias("value"), F.round(kept, 6).alias("kept"))


def market_rank_map(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    own = part.select("p_partkey", "p_type", "p_size", "p_retailprice")
    template = part.select("p_type", c("p_retailprice").alias("points"), c("p_partkey").alias("k"))
    return consensus.map_by_rank(own, template, "p_type", [c("p_size").desc(), c("p_partkey")], [c("points").desc(), c("k")], "points").select("p_partkey", "place", F.round(0.75 * c("points") + 0.25 * c("p_retailprice"), 6).alias("blended"))


def overlay_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Own and consensus values mixed with a weight per position."""
    # fixed values: the share of the own value by position
    share = {"RB": 0.25, "WR": 0.2, "TE": 0.3, "QB": 0.5, "K": 0.5}
    weights = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    w = F.coalesce(F.try_element_at(weights, F.upper("position")), F.lit(0.2))
    rows = read(spark, d, "player_weeks").where(c("projected").isNotNull() & ~F.isnan("projected") & c("fantasy_points").isNotNull())
    each = rows.groupBy("player_id", "season", F.upper("position").alias("position")).agg(F.avg("projected").alias("own"), F.avg(F.when(~F.isnan("fantasy_points"), c("fantasy_points"))).alias("consensus"))
    return each.select("player_id", "season", "position", F.round(w * c("own") + (1 - w) * F.coalesce("consensus", "own"), 8).alias("overlay"))


def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many keys each combination of sources knows."""
    flags = _lines(spark, d).groupBy("l_partkey").agg(*[F.max((c("l_suppkey") % 3 == i).cast("int")).alias(f"s{i}") for i in range(3)])
    return flags.groupBy("s0", "s1", "s2").agg(F.count(F.lit(1)).alias("n"))


_SCORES = """scores AS (SELECT s_name, count(*) AS samples, sqrt(avg((l_extendedprice * l_discount) ** 2)) AS rmse, avg(abs(l_extendedprice * l_discount)) AS mae
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(*) >= 20)"""
_RESIDUALS = """r AS (SELECT p_partkey, p_type, p_retailprice AS target, seen - p_retailprice AS residual FROM part JOIN
  (SELECT l_partkey, round(avg(l_extendedprice / l_quantity), 6) AS seen FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
near AS (SELECT a.p_partkey, a.target, a.residual, b.residual AS other, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(b.target - a.target), b.target DESC, b.p_partkey) AS n
  FROM r a JOIN r b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey),
bias AS (SELECT p_partkey, any_value(target) AS target, any_value(residual) AS residual, median(other) AS bias FROM near WHERE n <= 9 GROUP BY 1)"""

QUERIES = {f.__name__: f for f in (source_scores, source_weights_inverse_mse, source_weights_equal, ensemble_weighted_mean, consensus_renormalized, consensus_min_two_sources, leave_one_source_out, knn_local_bias, calibration_tanh, market_rank_map, overlay_by_position, source_coverage)}
ORACLE = {
    "source_scores": f"WITH {_SCORES} SELECT s_name, samples, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM scores",
    "source_weights_inverse_mse": f"WITH {_SCORES} SELECT s_name, round((1 / greatest(0.01, rmse ** 2)) / sum(1 / greatest(0.01, rmse ** 2)) OVER (), 9) AS weight FROM scores WHERE samples >= 50",
    "source_weights_equal": "SELECT l_suppkey, round(1.0::DOUBLE / count(*) OVER (), 9) AS weight FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 7 = 0)",
    "ensemble_weighted_mean": """WITH w AS (SELECT l_partkey, CAST(1 + l_suppkey % 5 AS DOUBLE) AS w, l_extendedprice AS p, CASE WHEN l_linenumber <> 1 THEN l_extendedprice * 0.8::DOUBLE END AS lo, CASE WHEN l_linenumber <> 2 THEN l_extendedprice * 1.2::DOUBLE END AS hi FROM lineitem)
      SELECT l_partkey, round(sum(p * w) / sum(w), 6) AS mean, round(sum(coalesce(lo, p * 0.7::DOUBLE) * w) / sum(w), 6) AS floor, round(sum(coalesce(hi, p * 1.3::DOUBLE) * w) / sum(w), 6) AS ceiling FROM w GROUP BY 1""",
    "consensus_renormalized": """WITH e AS (SELECT l_partkey, l_suppkey % 4 AS s, avg(l_extendedprice) AS points FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
      w AS (SELECT *, CAST([1.15, 1.0, 0.9, 0.85][s + 1] AS DOUBLE) AS w FROM e)
      SELECT l_partkey, round(sum(points * w) / sum(w), 6) AS points, round(sum(w), 6) AS weight FROM w GROUP BY 1""",
    "consensus_min_two_sources": "SELECT l_partkey, count(DISTINCT l_suppkey) AS sources, round(avg(l_extendedprice), 6) AS points FROM lineitem WHERE l_quantity > 40 GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2",
    "leave_one_source_out": """WITH own AS (SELECT l_partkey, l_suppkey % 6 AS source, avg(l_extendedprice) AS own FROM lineitem GROUP BY 1, 2),
      t AS (SELECT *, (sum(own) OVER (PARTITION BY l_partkey) - own) AS rest, count(*) OVER (PARTITION BY l_partkey) AS n FROM own)
      SELECT l_partkey, source, round(own, 8) AS own, round(rest / (n - 1), 8) AS peers FROM t WHERE n > 1""",
    "knn_local_bias": f"WITH {_RESIDUALS} SELECT p_partkey, round(bias, 6) AS bias FROM bias",
    "calibration_tanh": f"WITH {_RESIDUALS} SELECT p_partkey, round(greatest(0.0, target + 16 * tanh(0.35::DOUBLE * (residual - bias) / 16)), 6) AS value, round(16 * tanh(0.35::DOUBLE * (residual - bias) / 16), 6) AS kept FROM bias",
    "market_rank_map": """WITH a AS (SELECT p_partkey, p_type, p_retailprice, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS INTEGER) AS place FROM part),
      b AS (SELECT p_type, p_retailprice AS points, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place FROM part)
      SELECT p_partkey, a.place, round(0.75::DOUBLE * points + 0.25::DOUBLE * p_retailprice, 6) AS blended FROM a JOIN b ON a.p_type = b.p_type AND a.place = b.place""",
    "overlay_by_position": """WITH e AS (SELECT player_id, season, upper(position) AS position, avg(projected) AS own, avg(fantasy_points) FILTER (NOT isnan(fantasy_points)) AS cons
      FROM player_weeks WHERE projected IS NOT NULL AND NOT isnan(projected) AND fantasy_points IS NOT NULL GROUP BY ALL),
      w AS (SELECT *, CAST(CASE position WHEN 'RB' THEN 0.25 WHEN 'WR' THEN 0.2 WHEN 'TE' THEN 0.3 WHEN 'QB' THEN 0.5 WHEN 'K' THEN 0.5 ELSE 0.2 END AS DOUBLE) AS w FROM e)
      SELECT player_id, season, position, round(w * own + (1 - w) * coalesce(cons, own), 8) AS overlay FROM w""",
    "source_coverage": """WITH f AS (SELECT l_partkey, CAST(max(CAST(l_suppkey % 3 = 0 AS INTEGER)) AS INTEGER) AS s0, CAST(max(CAST(l_suppkey % 3 = 1 AS INTEGER)) AS INTEGER) AS s1, CAST(max(CAST(l_suppkey % 3 = 2 AS INTEGER)) AS INTEGER) AS s2 FROM lineitem GROUP BY 1)
      SELECT s0, s1, s2, count(*) AS n FROM f GROUP BY ALL""",
}
