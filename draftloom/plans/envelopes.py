"""Quantile envelopes: validation, normalisation, sampling, point masses, shrinkage and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftloom.functions import grids as G
from draftloom.functions import scalars as S
from draftloom.operators import ranks
from draftloom.plans.simulations import _GRID, PS, _at, _grid, _trap
from draftloom.plans.statistics import _ROWS, _rows
from draftloom.session import read

c = F.col
R = lambda x, n=6: F.round(x, n)
LOW, HIGH = 0.0, 120_000.0
SHRINK = 20.0
EPS = 2.220446049250313e-16


def grid_errors(spark: SparkSession, d: str) -> DataFrame:
    """Why a published grid of probabilities cannot be used; none of these for the fixed one."""
    x = read(spark, d, "distribution_grids")
    ps = c("probabilities")
    steps = F.zip_with(F.slice(ps, 1, F.size(ps) - 1), F.slice(ps, 2, F.size(ps)), lambda a, b: b > a)
    errors = F.array_compact(
        F.array(
            F.when(c("schema_version").isNull() | (c("schema_version") != "quantile-v1"), "unsupported version"),
            F.when(c("unit").isNull() | (c("unit") != "season-fantasy-points"), "unsupported unit"),
            F.when(ps.isNull() | (F.size(ps) < 2), "at least two quantiles are required"),
            F.when(F.exists(ps, lambda p: p.isNull() | F.isnan(p)), "not a number"),
            F.when(F.exists(ps, lambda p: (p < 0) | (p > 1)), "probability out of range"),
            F.when((F.size(ps) >= 2) & F.exists(steps, lambda s: ~s), "not strictly increasing"),
            F.when(F.size(ps) != len(PS), "not the fixed number of points"),
        )
    )
    return x.select("schema_version", "unit", F.coalesce(F.size(ps), F.lit(-1)).alias("points"), F.array_join(errors, "; ").alias("errors"))


def grid_value_errors(spark: SparkSession, d: str) -> DataFrame:
    """Grids whose values fall, and means outside the grid."""
    g = _grid(spark, d).withColumn("m", G.trapezoid_mean(PS, c("q")) * 1.3)
    falls = F.zip_with(F.slice("x", 1, len(PS) - 1), F.slice("x", 2, len(PS)), lambda a, b: (b < a).cast("int"))
    return g.select("l_partkey", F.aggregate(falls, F.lit(0), lambda a, b: a + b).alias("falls"), ((c("m") < c("x")[0]) | (c("m") > c("x")[len(PS) - 1])).alias("mean_outside"))


def _target() -> Column:
    """By part: no target, a lower one, a higher one, or one beyond the bounds."""
    mean = G.trapezoid_mean(PS, c("q"))
    k = F.pmod(c("l_partkey"), F.lit(4))
    return F.when(k == 1, mean * 0.8).when(k == 2, mean * 1.2).when(k == 3, F.lit(HIGH + 1.0))


def grid_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Crossing grids made usable: bounded, monotone, with tails, moved to a target mean, as shares of the upper
    bound; nothing for impossible targets."""
    ps, values = G.normalized(PS, c("x"), c("t"), LOW, HIGH)
    out = _grid(spark, d).withColumn("t", _target()).withColumn("v", values).where("v is not null")
    return out.select("l_partkey", F.posexplode("v").alias("i", "value")).select("l_partkey", "i", R(c("value") / HIGH, 8).alias("value"))


def grid_normalized_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean after normalisation beside the target."""
    ps, values = G.normalized(PS, c("x"), c("t"), LOW, HIGH)
    out = _grid(spark, d).withColumn("t", _target()).withColumn("v", values)
    return out.select("l_partkey", R("t", 8).alias("target"), R(F.when(c("v").isNotNull(), G.trapezoid_mean(ps, c("v"))), 8).alias("mean"))


def grid_sample(spark: SparkSession, d: str) -> DataFrame:
    """Draws from grids by a uniform or a normal number, never by both or neither."""
    k = F.pmod(c("l_partkey"), F.lit(5))
    u = F.when(k.isin(0, 3), F.pmod(c("l_partkey"), F.lit(89)) / 88.0)
    z = F.when(k.isin(1, 2, 3), (F.pmod(c("l_partkey"), F.lit(61)) - 30) / 10.0)
    return _grid(spark, d).withColumn("u", u).withColumn("z", z).select("l_partkey", R(G.sampled(PS, c("q"), c("u"), c("z")), 5).alias("value"))


def summary_grid(spark: SparkSession, d: str) -> DataFrame:
    """Listings' floor, mean and ceiling as a grid at 0, .1, .5, .9, 1 with the listed mean; errors where they do not fit."""
    x = read(spark, d, "source_listings").select("listing_id", "floor", "mean", "ceiling").withColumn("e", G.summary_errors(c("floor"), c("mean"), c("ceiling")))
    ps, values = G.normalized([0.1, 0.5, 0.9], F.array("floor", "mean", "ceiling"), c("mean"), 0.0)
    v = F.when(F.size("e") == 0, values)
    return x.withColumn("v", v).select("listing_id", F.array_join("e", "; ").alias("errors"), *[R(c("v")[i], 5).alias(f"v{i}") for i in range(len(ps))])


def zero_inflated_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of each part's grid with a point mass at nought of up to a half."""
    mass = F.pmod(c("l_partkey"), F.lit(11)) / 20.0
    g = _grid(spark, d).withColumn("mass", mass)
    return g.select("l_partkey", *[R(G.zero_inflated(PS, c("q"), c("mass"), F.lit(p)), 5).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])


def grid_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    """Each brand-and-size grid pulled toward its brand's, and that toward the grid of all, by how many rows speak for it."""
    x = _rows(spark, d).join(read(spark, d, "part").select(c("p_partkey").alias("k2"), "p_brand", "p_size"), c("l_partkey") == c("k2")).select("p_brand", "p_size", "l_extendedprice", F.lit(1).alias("one"))
    top = ranks.quantiles(x, ["one"], "l_extendedprice", PS, "q0").drop("n")
    mid = ranks.quantiles(x, ["p_brand"], "l_extendedprice", PS, "q1").withColumnRenamed("n", "n1").withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    pull = lambda own, n, up: F.zip_with(own, up, lambda a, b: (a * n + b * SHRINK) / (n + SHRINK))
    mid = mid.select("p_brand", pull(c("q1"), c("n1"), c("q0")).alias("q1"))
    low = ranks.quantiles(x, ["p_brand", "p_size"], "l_extendedprice", PS, "q2").join(mid, "p_brand")
    return low.select("p_brand", "p_size", "n", F.posexplode(pull(c("q2"), c("n"), c("q1"))).alias("i", "v")).select("p_brand", "p_size", "n", "i", R("v", 5).alias("v"))


def template_grid(spark: SparkSession, d: str) -> DataFrame:
    """A part's price spread by its type's ratios of actual to projected: the template of the type times the price."""
    ratio = _rows(spark, d).where("l_extendedprice > 0").withColumn("r", c("actual") / c("l_extendedprice"))
    t = ranks.quantiles(ratio, ["p_type"], "r", PS)
    p = read(spark, d, "part").select("p_partkey", "p_type", "p_retailprice").join(F.broadcast(t.drop("n")), "p_type")
    return p.select("p_partkey", *[R(F.greatest(F.lit(0.0), c("q")[i] * c("p_retailprice"))).alias(n) for i, n in ((2, "p10"), (6, "p50"), (10, "p90"))])


def hierarchical_cells_blended(spark: SparkSession, d: str) -> DataFrame:
    """Zero rates by flag, status and tax, each level pulled toward the blended rate of the level above."""
    x = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.round(c("l_tax") * 100).cast("int").alias("tax"), (c("l_discount") < 0.02).cast("double").alias("z"))
    finest = x.groupBy("l_returnflag", "l_linestatus", "tax").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n"))
    levels = [["l_returnflag", "l_linestatus", "tax"], ["l_returnflag", "l_linestatus"], ["l_returnflag"]]
    rate = finest.agg((F.sum("s") / F.sum("n")).alias("up"))
    keys: list[str] = []
    for level in reversed(levels):
        own = finest.groupBy(*level).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        own = own.join(rate, keys) if keys else own.crossJoin(F.broadcast(rate))
        rate, keys = own.select(*level, "n", ((c("s") + c("up") * SHRINK) / (c("n") + SHRINK)).alias("up")), level
        if level is not levels[0]:
            rate = rate.drop("n")
    return rate.select("l_returnflag", "l_linestatus", "tax", "n", R("up", 8).alias("rate"))


def keys_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Private keys removed from nested objects before they leave: at the top and inside every struct of the array."""
    e = read(spark, d, "events").select("event_id", F.to_json(F.struct(c("event_id"), c("user_id"), F.array(F.struct(c("event_type"), c("user_id"), c("value"))).alias("items"))).alias("j"))
    kept = F.from_json("j", "event_id bigint, items array<struct<event_type string, value double>>")
    return e.select("event_id", F.size(kept["items"]).alias("items"), kept["items"][0]["event_type"].alias("event_type"), F.to_json(kept).contains("user_id").alias("leaks"))


def _iso(x: str, n: int) -> str:
    return f"list_transform(range(1, {n + 1}), lambda i: list_max(list_transform(range(1, i + 1), lambda j: list_min(list_transform(range(i, {n + 1}), lambda k: list_sum({x}[j:k]) / (k - j + 1))))))"


def _tail_sql(ratio: float, rise: str, reach: str, growth: float = 3.0) -> str:
    return f"least(greatest(0, {rise} * {ratio!r}::DOUBLE), greatest({rise} * {growth}::DOUBLE, {reach} * 0.5::DOUBLE, {EPS!r}::DOUBLE))"


def _norm(ps: list[float], src: str, key: str, x: str, high: float | None) -> tuple[str, list[float]]:
    """CTEs n1..n5 that normalise column ``x`` of ``src`` toward column t."""
    n = len(ps)
    top = lambda v: f"least({v}, {high}::DOUBLE)" if high is not None else v
    bound = lambda v: f"greatest({top(v)}, {LOW}::DOUBLE)"
    grid = [0.0, *ps, 1.0]
    first = bound(f"s[1] - {_tail_sql(ps[0] / (ps[1] - ps[0]), '(s[2] - s[1])', f'(s[{n}] - s[1])')}")
    last = top(f"s[{n}] + {_tail_sql((1 - ps[-1]) / (ps[-1] - ps[-2]), f'(s[{n}] - s[{n - 1}])', f'(s[{n}] - s[1])')}")
    beyond = f"t < {LOW}::DOUBLE" + (f" OR t > {high}::DOUBLE" if high is not None else "")
    up = f"list_transform(w, lambda v: CASE WHEN m = {high}::DOUBLE THEN t ELSE {high}::DOUBLE - ({high}::DOUBLE - v) * ({high}::DOUBLE - t) / ({high}::DOUBLE - m) END)" if high is not None else "list_transform(w, lambda v: v + t - m)"
    return (
        f"""n1 AS (SELECT {key}, t, list_transform({x}, lambda v: {bound('v')}) AS b FROM {src}), n2 AS (SELECT {key}, t, {_iso('b', n)} AS s FROM n1), n3 AS (SELECT {key}, t, list_concat([{first}], s, [{last}]) AS w FROM n2), n4 AS (SELECT *, {_trap(grid, 'w')} AS m FROM n3),
 n5 AS (SELECT {key}, t, CASE WHEN t IS NULL THEN w WHEN {beyond} THEN NULL WHEN abs(m - t) <= 1e-12 THEN w WHEN t <= m THEN list_transform(w, lambda v: CASE WHEN m = {LOW}::DOUBLE THEN t ELSE {LOW}::DOUBLE + (v - {LOW}::DOUBLE) * (t - {LOW}::DOUBLE) / (m - {LOW}::DOUBLE) END) ELSE {up} END AS z FROM n4),
 n6 AS (SELECT {key}, t, CASE WHEN z IS NOT NULL THEN list_transform({_iso('z', n + 2)}, lambda v: {bound('v')}) END AS v FROM n5)""",
        grid,
    )


_NORM, _NGRID = _norm(PS, "gt", "l_partkey", "x", HIGH)
_GT = f"{_GRID}, gt AS (SELECT l_partkey, q, x, CASE l_partkey % 4 WHEN 1 THEN ({_trap(PS, 'q')}) * 0.8::DOUBLE WHEN 2 THEN ({_trap(PS, 'q')}) * 1.2::DOUBLE WHEN 3 THEN {HIGH + 1.0}::DOUBLE END AS t FROM x)"
_SNORM, _ = _norm([0.1, 0.5, 0.9], "ok", "listing_id", "x", None)
_FIN = "({0} IS NOT NULL AND NOT isnan({0}) AND NOT isinf({0}))"
_SERR = ", ".join(f"CASE WHEN NOT {_FIN.format(k)} THEN '{k} must be a finite number' END" for k in ("floor", "mean", "ceiling"))
_CDF = "(CASE WHEN z < -8 THEN 0 WHEN z > 8 THEN 1 WHEN z >= 0 THEN 1 - up ELSE up END)"
_UP = "exp(-1 * z * z / 2) * 0.3989422804014327::DOUBLE * (k * (0.31938153::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE)))))"

QUERIES = {f.__name__: f for f in (grid_errors, grid_value_errors, grid_normalized, grid_normalized_mean, grid_sample, summary_grid, zero_inflated_quantile, grid_shrinkage, template_grid, hierarchical_cells_blended, keys_stripped)}
ORACLE = {
    "grid_errors": f"""SELECT schema_version, unit, CAST(coalesce(len(probabilities), -1) AS INTEGER) AS points, concat_ws('; ', CASE WHEN schema_version IS NULL OR schema_version <> 'quantile-v1' THEN 'unsupported version' END, CASE WHEN unit IS NULL OR unit <> 'season-fantasy-points' THEN 'unsupported unit' END,
      CASE WHEN probabilities IS NULL OR len(probabilities) < 2 THEN 'at least two quantiles are required' END, CASE WHEN len(list_filter(probabilities, lambda p: p IS NULL OR isnan(p))) > 0 THEN 'not a number' END, CASE WHEN len(list_filter(probabilities, lambda p: p < 0 OR p > 1)) > 0 THEN 'probability out of range' END,
      CASE WHEN len(list_filter(range(2, len(probabilities) + 1), lambda i: NOT probabilities[i] > probabilities[i - 1])) > 0 THEN 'not strictly increasing' END, CASE WHEN len(probabilities) <> {len(PS)} THEN 'not the fixed number of points' END) AS errors FROM distribution_grids""",
    "grid_value_errors": f"WITH {_GRID} SELECT l_partkey, CAST(len(list_filter(range(2, 14), lambda i: x[i] < x[i - 1])) AS INTEGER) AS falls, ({_trap(PS, 'q')}) * 1.3::DOUBLE < x[1] OR ({_trap(PS, 'q')}) * 1.3::DOUBLE > x[13] AS mean_outside FROM x",
    "grid_normalized": f"WITH {_GT}, {_NORM} SELECT l_partkey, CAST(i - 1 AS INTEGER) AS i, round(v[i] / {HIGH}::DOUBLE, 8) AS value FROM n6, range(1, 16) t(i) WHERE v IS NOT NULL",
    "grid_normalized_mean": f"WITH {_GT}, {_NORM} SELECT l_partkey, round(t, 8) AS target, round(CASE WHEN v IS NOT NULL THEN {_trap(_NGRID, 'v')} END, 8) AS mean FROM n6",
    "grid_sample": f"""WITH {_GRID}, a AS (SELECT l_partkey, q, CASE WHEN l_partkey % 5 IN (0, 3) THEN (l_partkey % 89) / 88.0::DOUBLE END AS u, CASE WHEN l_partkey % 5 IN (1, 2, 3) THEN (l_partkey % 61 - 30) / 10.0::DOUBLE END AS z FROM g), b AS (SELECT *, 1 / (1 + abs(z) * 0.2316419::DOUBLE) AS k FROM a), e AS (SELECT *, {_UP} AS up FROM b),
      p AS (SELECT l_partkey, q, (u IS NULL) <> (z IS NULL) AS one, coalesce(u, {_CDF}) AS p FROM e) SELECT l_partkey, round(CASE WHEN one AND p BETWEEN 0 AND 1 THEN {_at(PS, 'q', 'p')} END, 5) AS value FROM p""",
    "summary_grid": f"""WITH a AS (SELECT listing_id, floor, mean, ceiling, concat_ws('; ', {_SERR}, CASE WHEN {_FIN.format('floor')} AND {_FIN.format('mean')} AND {_FIN.format('ceiling')} AND (floor > mean OR mean > ceiling) THEN 'floor, mean and ceiling must be in order' END) AS errors FROM source_listings),
      ok AS (SELECT listing_id, [floor, mean, ceiling] AS x, mean AS t FROM a WHERE errors = ''), {_SNORM} SELECT a.listing_id, errors, {', '.join(f'round(v[{i + 1}], 5) AS v{i}' for i in range(5))} FROM a LEFT JOIN n6 USING (listing_id)""",
    "zero_inflated_quantile": f"WITH {_GRID}, m AS (SELECT l_partkey, q, (l_partkey % 11) / 20.0::DOUBLE AS mass FROM g) SELECT l_partkey, " + ", ".join(f"round(CASE WHEN {p}::DOUBLE <= mass THEN 0 ELSE {_at(PS, 'q', f'(({p}::DOUBLE - mass) / (1 - mass))')} END, 5) AS {n}" for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))) + " FROM m",
    "grid_shrinkage": f"""WITH x AS (SELECT p_brand, p_size, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT quantile_cont(v, {PS}) AS q0 FROM x), b AS (SELECT p_brand, quantile_cont(v, {PS}) AS q1, count(*) AS n1 FROM x GROUP BY 1), l AS (SELECT p_brand, p_size, quantile_cont(v, {PS}) AS q2, count(*) AS n FROM x GROUP BY 1, 2)
      SELECT p_brand, p_size, n, CAST(i - 1 AS INTEGER) AS i, round((q2[i] * n + ((q1[i] * n1 + q0[i] * {SHRINK}::DOUBLE) / (n1 + {SHRINK}::DOUBLE)) * {SHRINK}::DOUBLE) / (n + {SHRINK}::DOUBLE), 5) AS v FROM l JOIN b USING (p_brand), t, range(1, 14) r(i)""",
    "template_grid": f"WITH {_ROWS}, t AS (SELECT p_type, quantile_cont(actual / l_extendedprice, {PS}) AS q FROM rows_ WHERE l_extendedprice > 0 GROUP BY 1) SELECT p_partkey, " + ", ".join(f"round(greatest(0, q[{i + 1}] * p_retailprice), 6) AS {n}" for i, n in ((2, "p10"), (6, "p50"), (10, "p90"))) + " FROM part JOIN t USING (p_type)",
    "hierarchical_cells_blended": f"""WITH x AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(l_discount < 0.02::DOUBLE AS DOUBLE) AS z FROM lineitem), r0 AS (SELECT avg(z) AS r0 FROM x), r1 AS (SELECT a, (sum(z) + any_value(r0) * {SHRINK}::DOUBLE) / (count(*) + {SHRINK}::DOUBLE) AS r1 FROM x, r0 GROUP BY 1),
      r2 AS (SELECT a, b, (sum(z) + any_value(r1) * {SHRINK}::DOUBLE) / (count(*) + {SHRINK}::DOUBLE) AS r2 FROM x JOIN r1 USING (a) GROUP BY 1, 2) SELECT a AS l_returnflag, b AS l_linestatus, tax, count(*) AS n, round((sum(z) + any_value(r2) * {SHRINK}::DOUBLE) / (count(*) + {SHRINK}::DOUBLE), 8) AS rate FROM x JOIN r2 USING (a, b) GROUP BY 1, 2, 3""",
    "keys_stripped": "SELECT event_id, CAST(1 AS INTEGER) AS items, event_type, false AS leaks FROM events",
}
