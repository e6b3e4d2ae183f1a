"""Queries of the statistics kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import ranks, stats
from draftloom.session import read

c = F.col
R = lambda x, n=6: F.round(x, n)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Weekly rows: source, position, projected, actual, and a key that orders ties."""
    lines = read(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_extendedprice").cast("decimal(12,2)").cast("string")))
    return lines.join(read(spark, d, "part").select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey")).withColumn("actual", c("l_extendedprice") * (1 - c("l_discount")))


def quantile_linear(spark: SparkSession, d: str) -> DataFrame:
    return ranks.quantiles(_rows(spark, d), ["p_type"], "l_extendedprice", [0.1, 0.25, 0.5, 0.9]).select("p_type", *[R(c("q")[i]).alias(n) for i, n in enumerate(("q10", "q25", "q50", "q90"))])


def quantile_floor(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_floor(_rows(spark, d), ["p_type"], "l_extendedprice", 0.9)


def quantile_floor_n(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_floor_n(_rows(spark, d), ["p_type"], "l_extendedprice", 0.9)


def quantile_higher(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_higher(_rows(spark, d), ["p_type"], "l_extendedprice", 0.8)


def quantile_nearest(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_nearest(_rows(spark, d), ["p_type"], "l_extendedprice", 0.95)


def quantile_weighted(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_weighted(_rows(spark, d), ["p_type"], "l_extendedprice", "l_quantity", 0.5)


def spearman_by_group(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_rows(spark, d), ["p_type"], "l_quantity", "l_extendedprice").select("p_type", "n", R("spearman").alias("spearman"))


def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.errors(_rows(spark, d), ["l_suppkey", "p_type"], c("l_extendedprice"), c("actual")).select("l_suppkey", "p_type", "n", *[R(x).alias(x) for x in ("mae", "rmse", "bias")])


def ols_calibration(spark: SparkSession, d: str) -> DataFrame:
    x, y = c("l_extendedprice"), c("actual")
    return _rows(spark, d).groupBy("p_type").agg(R(F.regr_slope(y, x)).alias("slope"), R(F.regr_intercept(y, x), 3).alias("intercept"), R(F.corr(x, y)).alias("pearson"))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("is_accepted is not null")
    return docs.select((F.pmod(c("n_chars"), F.lit(1000)) / 1000.0).alias("p"), c("is_accepted").cast("double").alias("y"), "source", "doc_id")


def brier_ece(spark: SparkSession, d: str) -> DataFrame:
    rows = _outcomes(spark, d)
    brier = rows.agg(F.avg((c("p") - c("y")) ** 2).alias("brier"))
    return brier.crossJoin(stats.calibration_error(stats.calibration_bins(rows, c("p"), c("y")))).select(R("brier").alias("brier"), R("ece").alias("ece"))


def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    return stats.calibration_bins(_outcomes(spark, d), c("p"), c("y")).select("bin", "count", R("predicted").alias("predicted"), R("observed").alias("observed"))


def log_loss(spark: SparkSession, d: str) -> DataFrame:
    p = S.clamp(c("p"), 1e-6, 1 - 1e-6)
    return _outcomes(spark, d).groupBy("source").agg(R(F.avg(-(c("y") * F.log(p) + (1 - c("y")) * F.log(1 - p)))).alias("log_loss"))


def wilson_lower(spark: SparkSession, d: str) -> DataFrame:
    t = _outcomes(spark, d).groupBy("source").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n"))
    return t.select("source", "n", R(S.wilson_lower(c("hits"), c("n"), 1.6448536269514722)).alias("lower"))


def _with_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    q = ranks.quantiles(rows, ["p_type"], "l_extendedprice", [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])
    return rows.join(q.drop("n"), "p_type")


def pinball_wis_coverage(spark: SparkSession, d: str) -> DataFrame:
    ps, y = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95], c("actual")
    loss = sum((stats.pinball(y, c("q")[i], F.lit(p)) for i, p in enumerate(ps)), F.lit(0.0)) / len(ps)
    wis = (0.5 * F.abs(y - c("q")[3]) + 0.05 * stats.interval_score(y, c("q")[0], c("q")[6], 0.1) + 0.1 * stats.interval_score(y, c("q")[1], c("q")[5], 0.2) + 0.25 * stats.interval_score(y, c("q")[2], c("q")[4], 0.5)) / 3.5
    inside = y.between(c("q")[1], c("q")[5]).cast("double")
    return _with_quantiles(spark, d).groupBy("p_type").agg(R(F.avg(loss), 5).alias("pinball"), R(F.avg(wis), 5).alias("wis"), R(F.avg(inside)).alias("coverage"))


def crps_trapezoid(spark: SparkSession, d: str) -> DataFrame:
    ps = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
    losses = [2 * stats.pinball(c("actual"), c("q")[i], F.lit(p)) for i, p in enumerate(ps)]
    area = sum(((losses[i] + losses[i - 1]) / 2 * (ps[i] - ps[i - 1]) for i in range(1, len(ps))), F.lit(0.0)) + losses[0] * ps[0] + losses[-1] * (1 - ps[-1])
    return _with_quantiles(spark, d).groupBy("p_type").agg(R(F.avg(area), 5).alias("crps"))


def _closeness(spark: SparkSession, d: str, deviation) -> DataFrame:  # noqa: ANN001
    rows = _rows(spark, d)
    sd = rows.groupBy("p_type").agg(deviation("l_extendedprice").alias("sd"))
    z = rows.join(sd, "p_type").withColumn("z", F.abs(c("l_extendedprice") - c("actual")) / c("sd"))
    return ranks.quantiles(z, ["p_type"], "z", [0.5, 0.9]).select("p_type", "n", R(c("q")[0], 7).alias("median"), R(c("q")[1], 7).alias("p90"))


def standardized_closeness_pop(spark: SparkSession, d: str) -> DataFrame:
    return _closeness(spark, d, F.stddev_pop)


def standardized_closeness_samp(spark: SparkSession, d: str) -> DataFrame:
    return _closeness(spark, d, F.stddev_samp)


def pairwise_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Within an order: do quantity and price rank its lines alike?"""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("x"), F.sum("l_extendedprice").alias("y"))
    return stats.concordance(lines, "l_orderkey", "x", "y", "l_partkey").select("l_orderkey", "pairs", R("accuracy").alias("accuracy"))


def normal_cdf_erf(spark: SparkSession, d: str) -> DataFrame:
    z = (c("p_retailprice") - 950) / 15
    return read(spark, d, "part").select("p_partkey", R(S.normal_cdf_erf(z), 9).alias("cdf"))


def normal_cdf_tail(spark: SparkSession, d: str) -> DataFrame:
    z = (c("p_retailprice") - 950) / 5
    return read(spark, d, "part").select("p_partkey", R(S.normal_cdf_tail(z), 9).alias("cdf"))


def softmax_temperature(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    top = part.groupBy("p_brand").agg(F.max("p_retailprice").alias("top"))
    e = part.join(top, "p_brand").withColumn("e", F.exp((c("p_retailprice") - c("top")) / 8.0))
    total = e.groupBy("p_brand").agg(F.sum("e").alias("total"))
    return e.join(total, "p_brand").select("p_partkey", R(c("e") / c("total"), 9).alias("share"))


CURVE = [(1.0, 2.5), (12.0, 6.0), (24.0, 9.5), (36.0, 14.0), (50.0, 20.0)]


def curve_interpolate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", R(S.interpolate(c("p_size").cast("double"), CURVE), 9).alias("sd"))


def min_max_scale(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    ends = part.groupBy("p_type").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return part.join(ends, "p_type").select("p_partkey", R(F.when(c("low") == c("high"), 0.5).otherwise(S.clamp((c("p_retailprice") - c("low")) / F.nullif(c("high") - c("low"), F.lit(0.0)))), 9).alias("scaled"))


def average_tie_rank(spark: SparkSession, d: str) -> DataFrame:
    return stats.average_rank(read(spark, d, "part"), ["p_type"], "p_retailprice").select("p_partkey", R("rank", 3).alias("rank"))


def tertile_tier(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    cut = ranks.quantiles(part, ["p_type"], "p_retailprice", [1 / 3, 2 / 3])
    return part.join(cut, "p_type").select("p_partkey", F.when(c("p_retailprice") <= c("q")[0], "low").when(c("p_retailprice") <= c("q")[1], "middle").otherwise("high").alias("tier"))


def rounding_rules(spark: SparkSession, d: str) -> DataFrame:
    """The three rounding rules side by side, on halves."""
    x = (c("l_quantity") - 25) / 2
    return read(spark, d, "lineitem").groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n")).select("x", "n", S.half_up(c("x")).cast("long").alias("half_up"), F.bround("x", 0).cast("long").alias("half_even"), F.round("x", 0).cast("long").alias("half_away"))


def finite_or_default(spark: SparkSession, d: str) -> DataFrame:
    x = S.finite(c("fantasy_points_ppr"), 0.0)
    return read(spark, d, "player_weeks").select("week_row_id", x.alias("points"))


_ROWS = """rows_ AS (SELECT *, l_extendedprice * (1 - l_discount) AS actual, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_OUT = "o AS (SELECT (n_chars % 1000) / 1000.0::DOUBLE AS p, CAST(is_accepted AS DOUBLE) AS y, source FROM documents WHERE is_accepted IS NOT NULL)"
_Q = f"WITH {_ROWS}, q AS (SELECT p_type, quantile_cont(l_extendedprice, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q FROM rows_ GROUP BY 1)"


def _index(at: str) -> str:
    return f"""WITH {_ROWS}, r AS (SELECT p_type, l_extendedprice, row_number() OVER (PARTITION BY p_type ORDER BY l_extendedprice, k) - 1 AS place, count(*) OVER (PARTITION BY p_type) AS n FROM rows_)
    SELECT p_type, l_extendedprice AS q FROM r WHERE place = {at}"""


def _pin(q: str, p: str) -> str:
    return f"greatest({p}::DOUBLE * (actual - {q}), ({p}::DOUBLE - 1) * (actual - {q}))"


def _is(a: str, b: str, alpha: float) -> str:
    return f"(({b} - {a}) + greatest(0.0, {a} - actual) * {2 / alpha}::DOUBLE + greatest(0.0, actual - {b}) * {2 / alpha}::DOUBLE)"


_PS = ("0.05", "0.1", "0.25", "0.5", "0.75", "0.9", "0.95")
_LOSS = [f"2 * {_pin(f'q[{i + 1}]', p)}" for i, p in enumerate(_PS)]
_AREA = " + ".join([f"({_LOSS[i]} + {_LOSS[i - 1]}) / 2 * {float(_PS[i]) - float(_PS[i - 1])!r}::DOUBLE" for i in range(1, 7)] + [f"{_LOSS[0]} * 0.05::DOUBLE", f"{_LOSS[6]} * {1 - 0.95!r}::DOUBLE"])


def _close(sd: str) -> str:
    return f"""WITH {_ROWS}, z AS (SELECT p_type, abs(l_extendedprice - actual) / {sd}(l_extendedprice) OVER (PARTITION BY p_type) AS z FROM rows_)
    SELECT p_type, count(*) AS n, round(quantile_cont(z, 0.5), 7) AS median, round(quantile_cont(z, 0.9), 7) AS p90 FROM z GROUP BY 1"""


_ERF = "(1 - ((((t * 1.061405429::DOUBLE - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x))"
_TAIL = "exp(-x * x / 2) * 0.3989422804014327::DOUBLE * t * (0.31938153::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))"

QUERIES = {f.__name__: f for f in (quantile_linear, quantile_floor, quantile_floor_n, quantile_higher, quantile_nearest, quantile_weighted, spearman_by_group, error_metrics, ols_calibration, brier_ece, calibration_table, log_loss, wilson_lower, pinball_wis_coverage, crps_trapezoid, standardized_closeness_pop, standardized_closeness_samp, pairwise_concordance, normal_cdf_erf, normal_cdf_tail, softmax_temperature, curve_interpolate, min_max_scale, average_tie_rank, tertile_tier, rounding_rules, finite_or_default)}
ORACLE = {
    "quantile_linear": f"WITH {_ROWS} SELECT p_type, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM rows_ GROUP BY 1",
    "quantile_floor": _index("floor((n - 1) * 0.9::DOUBLE)"),
    "quantile_floor_n": _index("least(n - 1, floor(n * 0.9::DOUBLE))"),
    "quantile_higher": _index("ceil((n - 1) * 0.8::DOUBLE)"),
    "quantile_nearest": _index("greatest(0, ceil(n * 0.95::DOUBLE) - 1)"),
    "quantile_weighted": f"""WITH {_ROWS}, r AS (SELECT p_type, l_extendedprice, sum(l_quantity) OVER (PARTITION BY p_type ORDER BY l_extendedprice, k ROWS UNBOUNDED PRECEDING) AS run, sum(l_quantity) OVER (PARTITION BY p_type) AS al FROM rows_)
      SELECT p_type, min(l_extendedprice) AS q FROM r WHERE run >= al * 0.5::DOUBLE GROUP BY 1""",
    "spearman_by_group": f"""WITH {_ROWS}, r AS (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY l_quantity) + (count(*) OVER (PARTITION BY p_type, l_quantity) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY p_type ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY p_type, l_extendedprice) - 1) / 2 AS ry FROM rows_)
      SELECT p_type, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""",
    "error_metrics": f"WITH {_ROWS} SELECT l_suppkey, p_type, count(*) AS n, round(avg(abs(l_extendedprice - actual)), 6) AS mae, round(sqrt(avg((l_extendedprice - actual) ** 2)), 6) AS rmse, round(avg(l_extendedprice - actual), 6) AS bias FROM rows_ GROUP BY 1, 2",
    "ols_calibration": f"WITH {_ROWS} SELECT p_type, round(regr_slope(actual, l_extendedprice), 6) AS slope, round(regr_intercept(actual, l_extendedprice), 3) AS intercept, round(corr(l_extendedprice, actual), 6) AS pearson FROM rows_ GROUP BY 1",
    "brier_ece": f"WITH {_OUT}, b AS (SELECT least(9, floor(p * 10)) AS b, count(*) AS n, avg(p) AS ap, avg(y) AS ay FROM o GROUP BY 1) SELECT round((SELECT avg((p - y) ** 2) FROM o), 6) AS brier, round(sum(n * abs(ap - ay)) / sum(n), 6) AS ece FROM b",
    "calibration_table": f"WITH {_OUT} SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, count(*) AS count, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM o GROUP BY 1",
    "log_loss": f"WITH {_OUT}, p AS (SELECT source, y, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM o) SELECT source, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM p GROUP BY 1",
    "wilson_lower": f"WITH {_OUT}, t AS (SELECT source, sum(y) / count(*) AS p, count(*) AS n, 1.6448536269514722::DOUBLE AS z FROM o GROUP BY 1) SELECT source, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lower FROM t",
    "pinball_wis_coverage": f"""{_Q} SELECT p_type, round(avg(({" + ".join(_pin(f"q[{i + 1}]", p) for i, p in enumerate(_PS))}) / 7), 5) AS pinball,
      round(avg((0.5::DOUBLE * abs(actual - q[4]) + 0.05::DOUBLE * {_is("q[1]", "q[7]", 0.1)} + 0.1::DOUBLE * {_is("q[2]", "q[6]", 0.2)} + 0.25::DOUBLE * {_is("q[3]", "q[5]", 0.5)}) / 3.5::DOUBLE), 5) AS wis,
      round(avg(CAST(actual BETWEEN q[2] AND q[6] AS DOUBLE)), 6) AS coverage FROM rows_ JOIN q USING (p_type) GROUP BY 1""",
    "crps_trapezoid": f"{_Q} SELECT p_type, round(avg({_AREA}), 5) AS crps FROM rows_ JOIN q USING (p_type) GROUP BY 1",
    "standardized_closeness_pop": _close("stddev_pop"),
    "standardized_closeness_samp": _close("stddev_samp"),
    "pairwise_concordance": """WITH l AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS x, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2)
      SELECT a.l_orderkey, count(*) AS pairs, round(avg(CASE WHEN a.x = b.x THEN 0.5::DOUBLE WHEN (a.x > b.x) = (a.y > b.y) THEN 1 ELSE 0 END), 6) AS accuracy
      FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey AND a.y <> b.y GROUP BY 1""",
    "normal_cdf_erf": f"WITH z AS (SELECT p_partkey, (p_retailprice - 950) / 15 AS z FROM part), t AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + abs(z) / sqrt(2.0::DOUBLE) * 0.3275911::DOUBLE) AS t FROM z) SELECT p_partkey, round(0.5::DOUBLE * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * {_ERF}), 9) AS cdf FROM t",
    "normal_cdf_tail": f"WITH z AS (SELECT p_partkey, (p_retailprice - 950) / 5 AS z FROM part), t AS (SELECT *, abs(z) AS x, 1 / (1 + abs(z) * 0.2316419::DOUBLE) AS t FROM z) SELECT p_partkey, round(CASE WHEN z < -8 THEN 0.0 WHEN z > 8 THEN 1.0 WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END::DOUBLE, 9) AS cdf FROM t",
    "softmax_temperature": "WITH e AS (SELECT p_partkey, p_brand, exp((p_retailprice - max(p_retailprice) OVER (PARTITION BY p_brand)) / 8.0::DOUBLE) AS e FROM part) SELECT p_partkey, round(e / sum(e) OVER (PARTITION BY p_brand), 9) AS share FROM e",
    "curve_interpolate": "SELECT p_partkey, round(CASE WHEN p_size <= 1 THEN 2.5 " + " ".join(f"WHEN p_size <= {b} THEN {va} + ({vb} - {va}) * (CAST(p_size AS DOUBLE) - {a}) / ({b} - {a})" for (a, va), (b, vb) in zip(CURVE, CURVE[1:])) + " ELSE 20.0 END::DOUBLE, 9) AS sd FROM part",
    "min_max_scale": """WITH m AS (SELECT *, min(p_retailprice) OVER (PARTITION BY p_type) AS lo, max(p_retailprice) OVER (PARTITION BY p_type) AS hi FROM part)
      SELECT p_partkey, round(CASE WHEN lo = hi THEN 0.5::DOUBLE ELSE least(greatest((p_retailprice - lo) / (hi - lo), 0), 1) END, 9) AS scaled FROM m""",
    "average_tie_rank": "SELECT p_partkey, round(rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_type, p_retailprice) - 1) / 2, 3) AS rank FROM part",
    "tertile_tier": """WITH q AS (SELECT p_type, quantile_cont(p_retailprice, [1.0::DOUBLE / 3, 2.0::DOUBLE / 3]) AS q FROM part GROUP BY 1)
      SELECT p_partkey, CASE WHEN p_retailprice <= q[1] THEN 'low' WHEN p_retailprice <= q[2] THEN 'middle' ELSE 'high' END AS tier FROM part JOIN q USING (p_type)""",
    "rounding_rules": """SELECT (l_quantity - 25) / 2 AS x, count(*) AS n, CAST(floor((l_quantity - 25) / 2 + 0.5::DOUBLE) AS BIGINT) AS half_up, CAST(round_even((l_quantity - 25) / 2, 0) AS BIGINT) AS half_even,
      CAST(sign((l_quantity - 25) / 2) * floor(abs((l_quantity - 25) / 2) + 0.5::DOUBLE) AS BIGINT) AS half_away FROM lineitem GROUP BY ALL""",
    "finite_or_default": "SELECT week_row_id, CASE WHEN fantasy_points_ppr IS NULL OR isnan(fantasy_points_ppr) OR isinf(fantasy_points_ppr) THEN 0.0 ELSE fantasy_points_ppr END::DOUBLE AS points FROM player_weeks",
}
