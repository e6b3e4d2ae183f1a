"""Queries on grids, keyed simulations, resampling, calibration and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.functions import grids as G
from draftloom.functions import scalars as S
from draftloom.operators import ranks
from draftloom.operators import resample as B
from draftloom.plans.statistics import _ROWS, _rows
from draftloom.plans.temporal import _SEASONS, _seasons
from draftloom.session import read

c = F.col
R = lambda x, n=6: F.round(x, n)
PS = [0.01, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99]


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """A 13-point grid per part; the crossing version swaps neighbours, as forecasts fitted apart do."""
    g = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.percentile("l_extendedprice", PS).alias("q"))
    swapped = F.array(*[c("q")[i ^ 1] if i < 12 else c("q")[i] for i in range(13)])
    return g.select("l_partkey", "q", swapped.alias("x"))


def grid_mean_trapezoid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("l_partkey", R(G.trapezoid_mean(PS, c("q")), 8).alias("mean"))


def grid_inverse_cdf(spark: SparkSession, d: str) -> DataFrame:
    p = F.pmod(c("l_partkey"), F.lit(97)) / 97.0
    return _grid(spark, d).select("l_partkey", R(G.quantile_at(PS, c("q"), p), 8).alias("value"))


def grid_running_max(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("l_partkey", F.posexplode(G.running_max(c("x"))).alias("i", "v")).select("l_partkey", "i", R("v", 8).alias("v"))


def grid_isotonic(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("l_partkey", F.posexplode(G.isotonic(c("x"))).alias("i", "v")).select("l_partkey", "i", R("v", 8).alias("v"))


def grid_tails_recenter(spark: SparkSession, d: str) -> DataFrame:
    """Tails to probability 0 and 1, then the grid moved to nine tenths of its mean."""
    ps, values = G.with_tails(PS, c("q"), 0.0, float("inf"), 1.5)
    t = _grid(spark, d).withColumn("t", values).withColumn("m", G.trapezoid_mean(ps, c("t")))
    return t.select("l_partkey", F.posexplode(G.recenter(c("t"), c("m"), c("m") * 0.9, 0.0)).alias("i", "v")).select("l_partkey", "i", R("v", 8).alias("v"))


def envelope_13pt(spark: SparkSession, d: str) -> DataFrame:
    """A three-point summary (floor, mean, ceiling) as the thirteen-point grid."""
    p = read(spark, d, "part").withColumn("v", F.array(c("p_retailprice") * 0.7, c("p_retailprice"), c("p_retailprice") * 1.4))
    return p.select("p_partkey", F.posexplode(F.array(*[G.quantile_at([0.1, 0.5, 0.9], c("v"), F.lit(x)) for x in PS])).alias("i", "v")).select("p_partkey", "i", R("v").alias("v"))


def validate_rows_errors(spark: SparkSession, d: str) -> DataFrame:
    x = c("fantasy_points_ppr")
    errors = F.array_compact(F.array(F.when(c("player_id") == "00-0000000", "unresolved"), F.when(c("position").isNull(), "no position"), F.when(x.isNull() | F.isnan(x), "no points"), F.when(~F.isnan(x) & (F.abs(x) > 90), "impossible points"), F.when(c("loaded_at") > F.make_timestamp_ntz(c("season") + 1, F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), "late")))
    return read(spark, d, "player_weeks").select("week_row_id", F.array_join(errors, "; ").alias("errors"))


def canonical_digest(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat_ws("|", c("p_partkey").cast("string"), "p_name", "p_brand", c("p_retailprice").cast("decimal(12,2)").cast("string"))
    return read(spark, d, "part").select("p_partkey", F.sha2(s, 256).alias("digest"))


def keyed_uniform(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", S.fnv1a(F.concat(F.lit("p"), c("p_partkey").cast("string"))).alias("h"))
    return p.select("p_partkey", B.uniform(42, c("p_partkey"), [c("h")]).alias("u"))


def keyed_normal_shock(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_retailprice", S.fnv1a(F.concat(F.lit("p"), c("p_partkey").cast("string"))).alias("h"))
    z = p.withColumn("z", B.normal(7, c("p_partkey"), [c("h")]))
    return z.select("p_partkey", R("z").alias("z"), R(S.two_piece_shock(c("z"), c("p_retailprice"), c("p_retailprice") * 0.7, c("p_retailprice") * 1.5), 8).alias("shock"))


def _season(spark: SparkSession, leagues: int) -> DataFrame:
    """Wins and points of every team of every simulated league over a 14-week round robin."""
    base = spark.range(leagues).select(c("id").alias("league")).withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(13))))
    points = 100.0 + B.normal(11, c("league"), [c("team").cast("long")]) * 8 + B.normal(13, c("league"), [c("team").cast("long"), c("week").cast("long")]) * 20
    x = base.withColumn("points", F.round(points, 6))
    i = F.when(c("team") == 0, 0).otherwise(F.pmod(c("team") - 1 - c("week"), F.lit(11)) + 1)
    j = 11 - i
    rival = F.when(j == 0, 0).otherwise(F.pmod(j - 1 + c("week"), F.lit(11)) + 1).cast("int")
    x = x.withColumn("rival", rival)
    other = x.select("league", "week", c("team").alias("rival"), c("points").alias("against"))
    y = x.join(other, ["league", "week", "rival"])
    return y.groupBy("league", "team").agg(F.sum((c("points") > c("against")).cast("int")).alias("wins"), F.sum("points").alias("points"))


def _seeded(spark: SparkSession, leagues: int) -> DataFrame:
    w = Window.partitionBy("league").orderBy(c("wins").desc(), c("points").desc(), "team")
    return _season(spark, leagues).withColumn("seed", F.row_number().over(w))


def round_robin_season(spark: SparkSession, d: str) -> DataFrame:
    return _seeded(spark, 200).select("league", "team", "wins", R("points", 9).alias("points"), "seed")


def playoff_bracket(spark: SparkSession, d: str) -> DataFrame:
    """Six seeds, byes for two: the champion of every league by keyed play-off points."""
    s = _seeded(spark, 200).where("seed <= 6")
    form = lambda r: 100.0 + B.normal(17 + r, c("league"), [c("team").cast("long")]) * 20
    p = s.groupBy("league").agg(F.map_from_entries(F.collect_list(F.struct("seed", F.struct(c("team").alias("team"), c("seed").alias("seed"), *[F.round(form(r), 6).alias(f"f{r}") for r in range(3)])))).alias("m"))
    beat = lambda a, b, r: F.when(a[f"f{r}"] >= b[f"f{r}"], a).otherwise(b)
    m = lambda k: F.element_at(c("m"), F.lit(k))
    p = p.withColumn("a", beat(m(3), m(6), 0)).withColumn("b", beat(m(4), m(5), 0))
    p = p.withColumn("x", beat(m(1), c("b"), 1)).withColumn("y", beat(m(2), c("a"), 1))
    return p.select("league", beat(c("x"), c("y"), 2)["team"].alias("champion"))


def finish_histogram(spark: SparkSession, d: str) -> DataFrame:
    t = _seeded(spark, 200).groupBy("team", "seed").agg(F.count(F.lit(1)).alias("n"))
    return t.select("team", "seed", "n", R((c("n") + 1) / (200 + 12.0), 8).alias("smoothed"))


def synthetic_leagues(spark: SparkSession, d: str) -> DataFrame:
    """Does the best projected team win more often? One row per projected rank over 2,000 leagues."""
    x = spark.range(2000).select(c("id").alias("league")).withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(9))))
    x = x.withColumn("skill", B.normal(3, c("league"), [c("team").cast("long")])).withColumn("result", F.round(c("skill") + 1.5 * B.normal(5, c("league"), [c("team").cast("long")]), 9)).withColumn("skill", F.round("skill", 9))
    w = Window.partitionBy("league")
    r = x.withColumn("projected", F.row_number().over(w.orderBy(c("skill").desc(), "team"))).withColumn("finish", F.row_number().over(w.orderBy(c("result").desc(), "team")))
    return r.groupBy("projected").agg(F.sum((c("finish") == 1).cast("long")).alias("titles"), R(F.avg("finish"), 6).alias("mean_finish"))


def residual_season_sim(spark: SparkSession, d: str) -> DataFrame:
    """Season totals of 1,000 keyed draws of 17 weekly residual quantiles per type."""
    q = ranks.quantiles(_rows(spark, d).withColumn("r", c("l_extendedprice") - c("actual")), ["p_type"], "r", PS).withColumn("h", S.fnv1a(F.translate(F.upper("p_type"), " ", "_")))
    x = q.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(17))))
    v = S.let(B.uniform(23, c("draw"), [c("h"), c("week").cast("long")]), lambda u: G.quantile_at(PS, c("q"), u))
    total = x.groupBy("p_type", "draw").agg(F.sum(v).alias("t"))
    return ranks.quantiles(total, ["p_type"], "t", [0.1, 0.5, 0.9]).select("p_type", *[R(c("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return B.bootstrap(B.clustered(rows, ["s_nationkey"], c("s_suppkey"), c("s_acctbal")), ["s_nationkey"], 300, 29).select("s_nationkey", *[R(x, 7).alias(x) for x in ("mean", "low", "high")])


def _error_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_returnflag", "l_suppkey", F.year("l_shipdate").alias("season"), (c("l_extendedprice") * c("l_discount")).alias("e"))


def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return B.bootstrap(B.clustered(_error_rows(spark, d), ["l_returnflag"], c("l_suppkey"), c("e")), ["l_returnflag"], 300, 31).select("l_returnflag", *[R(x, 4).alias(x) for x in ("mean", "low", "high")])


def dual_cluster(spark: SparkSession, d: str) -> DataFrame:
    """The wider of the intervals from two ways of clustering."""
    rows = _error_rows(spark, d).withColumn("team_season", F.concat_ws("-", c("l_suppkey").cast("string"), c("season").cast("string")))
    a = B.bootstrap(B.clustered(rows, ["l_returnflag"], c("l_suppkey"), c("e")), ["l_returnflag"], 200, 37)
    b = B.bootstrap(B.clustered(rows, ["l_returnflag"], c("team_season"), c("e")), ["l_returnflag"], 200, 41)
    j = a.join(b.select("l_returnflag", c("low").alias("low2"), c("high").alias("high2")), "l_returnflag")
    return j.select("l_returnflag", R(F.least("low", "low2"), 4).alias("low"), R(F.greatest("high", "high2"), 4).alias("high"))


def stack_simplex_grid(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "player_examples").where("target_ppr_total is not null and not isnan(target_ppr_total) and fantasy_points_ppr_lag1 is not null and not isnan(fantasy_points_ppr_lag1)")
    lag2 = F.coalesce(F.when(~F.isnan("fantasy_points_ppr_lag2"), c("fantasy_points_ppr_lag2")), c("fantasy_points_ppr_lag1"))
    rows = x.select("position", "target_ppr_total", c("fantasy_points_ppr_lag1").alias("a"), lag2.alias("b"), F.lit(90.0).alias("c"))
    return B.simplex_search(rows, ["position"], ["a", "b", "c"], "target_ppr_total").select("position", "w0", "w1", "w2", R("mae").alias("mae"))


def budget_reconcile(spark: SparkSession, d: str) -> DataFrame:
    s = _seasons(spark, d).where("recent_team is not null").select("player_id", "season", "recent_team", "fantasy_points_ppr")
    return B.budget(s, ["recent_team", "season"], "fantasy_points_ppr", F.lit(900.0), 0.8, 1.25).select("player_id", "season", R("scaled").alias("scaled"))


def share_allocate(spark: SparkSession, d: str) -> DataFrame:
    """A team's target budget by blended shares, renormalised."""
    s = _seasons(spark, d).where("recent_team is not null and targets is not null").select("player_id", "season", "recent_team", "targets", F.coalesce(F.when(~F.isnan("target_share"), c("target_share")), F.lit(0.0)).alias("share"))
    t = s.groupBy("recent_team", "season").agg(F.sum("targets").alias("total"))
    b = s.join(t, ["recent_team", "season"]).withColumn("mix", 0.6 * F.coalesce(F.try_divide(c("targets"), c("total")), F.lit(0.0)) + 0.4 * c("share"))
    m = b.groupBy("recent_team", "season").agg(F.sum("mix").alias("all"))
    return b.join(m, ["recent_team", "season"]).where("all > 0").select("player_id", "season", R(550 * c("mix") / c("all")).alias("allocated"))


def residual_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = ranks.quantiles(_rows(spark, d).withColumn("r", c("actual") - c("l_extendedprice")), ["p_type"], "r", [0.1, 0.9]).drop("n")
    p = read(spark, d, "part").join(q, "p_type")
    return p.select("p_partkey", *[R(F.greatest(F.lit(0.0), c("p_retailprice") * 20 + c("q")[i]), 8).alias(n) for i, n in enumerate(("p10", "p90"))])


def conformal_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Signed residual intervals of a brand and size, or of the brand where fewer than 40 rows stand behind it."""
    x = read(spark, d, "lineitem").join(read(spark, d, "part"), c("l_partkey") == c("p_partkey")).select("p_brand", "p_size", (-c("l_extendedprice") * c("l_discount")).alias("r"))
    fine = ranks.quantiles(x, ["p_brand", "p_size"], "r", [0.9]).select("p_brand", "p_size", c("q")[0].alias("fine"), "n")
    coarse = ranks.quantiles(x, ["p_brand"], "r", [0.9]).select("p_brand", c("q")[0].alias("coarse"))
    return fine.join(coarse, "p_brand").select("p_brand", "p_size", "n", R(F.when(c("n") >= 40, c("fine")).otherwise(c("coarse")), 8).alias("bound"))


def stability_labels(spark: SparkSession, d: str) -> DataFrame:
    """Steady or volatile, by the share of weeks far from the player's own median, with a prior of eight weeks."""
    w = read(spark, d, "player_weeks").where("player_id <> '00-0000000' and fantasy_points is not null and not isnan(fantasy_points)")
    m = w.groupBy("player_id").agg(F.median("fantasy_points").alias("m"))
    t = w.join(m, "player_id").groupBy("player_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.abs(c("fantasy_points") - c("m")) > 6).cast("int")).alias("far"))
    rate = (c("far") + 2.0) / (c("n") + 8.0)
    return t.select("player_id", "n", R(rate, 8).alias("rate"), F.when(rate <= 0.2, "steady").when(rate >= 0.45, "volatile").otherwise("mixed").alias("label"))


def draft_capital_features(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "players").where("draft_pick is not null")
    return p.groupBy("team").agg(F.count(F.lit(1)).alias("n"), R(F.sum(F.exp(-(c("draft_pick") - 1) / 60.0)), 8).alias("capital"), R(F.avg(1 / F.sqrt(F.greatest(F.lit(1), c("draft_pick")).cast("double"))), 8).alias("mean_capital"))


def hierarchical_cells(spark: SparkSession, d: str) -> DataFrame:
    """Zero rates by flag, status and tax at four levels, as plain averages of each level; hierarchical_shrink blends levels."""
    x = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.round(c("l_tax") * 100).cast("int").alias("tax"), (c("l_discount") < 0.02).cast("double").alias("z"))
    g = x.groupingSets([["l_returnflag", "l_linestatus", "tax"], ["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus", "tax").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg("z").alias("rate"))
    return g.select("l_returnflag", "l_linestatus", "tax", c("level").cast("int").alias("level"), "n", R("rate", 8).alias("rate"))


def hierarchical_shrink(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").select("l_returnflag", F.round(c("l_tax") * 100).cast("int").alias("tax"), (c("l_discount") < 0.02).cast("double").alias("z"))
    top = x.agg(F.avg("z").alias("r0"))
    mid = x.groupBy("l_returnflag").agg(F.avg("z").alias("m"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(top)).select("l_returnflag", ((c("m") * c("n") + c("r0") * 50) / (c("n") + 50)).alias("r1"))
    low = x.groupBy("l_returnflag", "tax").agg(F.avg("z").alias("m"), F.count(F.lit(1)).alias("n")).join(mid, "l_returnflag")
    return low.select("l_returnflag", "tax", R((c("m") * c("n") + c("r1") * 50) / (c("n") + 50), 8).alias("rate"))


def grouping_sets_gate(spark: SparkSession, d: str) -> DataFrame:
    """The mean absolute error overall, by flag, by type, by both; cells of fewer than 10 rows are left out."""
    x = _rows(spark, d).select("l_returnflag", "p_type", F.abs(c("l_extendedprice") - c("actual")).alias("e"))
    g = x.groupingSets([[], ["l_returnflag"], ["p_type"], ["l_returnflag", "p_type"]], "l_returnflag", "p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"))
    return g.where("n >= 10").select("l_returnflag", "p_type", "n", R("mae", 8).alias("mae"))


def boolean_gate(spark: SparkSession, d: str) -> DataFrame:
    """Did a candidate beat the baseline in every year, and over all?"""
    x = read(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return x.groupBy("l_suppkey").agg(F.bool_and(c("a") <= c("b") * 1.6).alias("every_season"), (F.avg("a") <= F.avg("b") * 1.4).alias("overall"))


_GRID = f"g AS (SELECT l_partkey, quantile_cont(l_extendedprice, {PS}) AS q FROM lineitem GROUP BY 1), x AS (SELECT l_partkey, q, [{', '.join(f'q[{(i ^ 1) + 1 if i < 12 else i + 1}]' for i in range(13))}] AS x FROM g)"


def _trap(ps: list[float], v: str) -> str:
    return " + ".join([f"{v}[1] * {ps[0]!r}::DOUBLE", f"{v}[{len(ps)}] * {1 - ps[-1]!r}::DOUBLE"] + [f"({v}[{i + 1}] + {v}[{i}]) / 2 * {ps[i] - ps[i - 1]!r}::DOUBLE" for i in range(1, len(ps))])


def _at(ps: list[float], v: str, p: str) -> str:
    return f"CASE WHEN {p} <= {ps[0]!r}::DOUBLE THEN {v}[1] " + " ".join(f"WHEN {p} <= {ps[i]!r}::DOUBLE THEN {v}[{i}] + ({v}[{i + 1}] - {v}[{i}]) * ({p} - {ps[i - 1]!r}::DOUBLE) / {ps[i] - ps[i - 1]!r}::DOUBLE" for i in range(1, len(ps))) + f" ELSE {v}[{len(ps)}] END"


def _mul(a: str, b: str) -> str:
    return f"((({a}) & 65535) * {b} + (((({a}) >> 16) * {b}) & 65535) * 65536) & 4294967295"


def _fnv(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda h, ch: {_mul('xor(h, ch)', '16777619')})"


def _chain(seed: int, scenario: str, parts: list[str], name: str, src: str, keep: str) -> tuple[str, str]:
    """CTEs that compute a keyed state step by step, and the name of the last one; ``keep``: columns carried along."""
    ctes = [f"{name}0 AS (SELECT {keep}, xor({_mul(f'CAST({scenario} + 1 AS BIGINT)', str(0x9E3779B1))}, {seed}) AS h FROM {src})"]
    for i, part in enumerate(parts):
        ctes.append(f"{name}{i + 1}a AS (SELECT {keep}, xor(h, {part}) AS h FROM {name}{i}), {name}{i + 1}b AS (SELECT {keep}, xor(h, h >> 16) AS h FROM {name}{i + 1}a), {name}{i + 1} AS (SELECT {keep}, {_mul('h', str(0x85EBCA6B))} AS h FROM {name}{i + 1}b)")
    return ", ".join(ctes), f"{name}{len(parts)}"


def _finish(name: str, src: str, keep: str, out: str) -> str:
    return f"""{name}p AS (SELECT {keep}, xor(h, h >> 16) AS h FROM {src}), {name}q AS (SELECT {keep}, {_mul('h', str(0x7FEB352D))} AS h FROM {name}p), {name}r AS (SELECT {keep}, xor(h, h >> 15) AS h FROM {name}q),
      {name}s AS (SELECT {keep}, {_mul('h', str(0x846CA68B))} AS h FROM {name}r), {name}t AS (SELECT {keep}, (xor(h, h >> 16) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS {out} FROM {name}s)"""


def _normal(seed: int, scenario: str, parts: list[str], name: str, src: str, keep: str, out: str) -> tuple[str, str]:
    """CTEs that add a keyed normal column ``out`` to ``src``."""
    base, last = _chain(seed, scenario, parts, name + "b", src, keep)
    steps = [base]
    for u in ("u1", "u2"):
        mixed = f"{name}{u}x AS (SELECT {keep}, xor(h, {_fnv(f"'{u}'")}) AS h FROM {last}), {name}{u}y AS (SELECT {keep}, xor(h, h >> 16) AS h FROM {name}{u}x), {name}{u}z AS (SELECT {keep}, {_mul('h', str(0x85EBCA6B))} AS h FROM {name}{u}y)"
        steps += [mixed, _finish(name + u, f"{name}{u}z", keep, u)]
    steps.append(f"{name} AS (SELECT {keep}, sqrt(-2 * ln(greatest(1e-12::DOUBLE, u1))) * cos(2 * pi() * u2) AS {out} FROM {name}u1t JOIN {name}u2t USING ({keep}))")
    return ", ".join(steps), name


_P = f"p AS (SELECT p_partkey, p_retailprice, {_fnv("'p' || p_partkey")} AS h0 FROM part)"
_NS, _NSN = _normal(7, "p_partkey", ["h0"], "n", "p", "p_partkey, p_retailprice, h0", "z")
_U, _UN = _chain(42, "p_partkey", ["h0"], "k", "p", "p_partkey, h0")


def _season_sql(leagues: int) -> str:
    a, _ = _normal(11, "league", ["team"], "na", "base", "league, team, week", "z1")
    b, _ = _normal(13, "league", ["team", "week"], "nb", "base", "league, team, week", "z2")
    return f"""base AS MATERIALIZED (SELECT league, CAST(team AS INTEGER) AS team, CAST(week AS INTEGER) AS week FROM range({leagues}) a(league), range(12) b(team), range(14) c(week)), {a}, {b},
      pts AS MATERIALIZED (SELECT league, team, week, round(100 + z1 * 8 + z2 * 20, 6) AS points, CASE WHEN team = 0 THEN 0 ELSE ((team - 1 - week) % 11 + 11) % 11 + 1 END AS i FROM na JOIN nb USING (league, team, week)),
      rv AS (SELECT *, CASE WHEN 11 - i = 0 THEN 0 ELSE (10 - i + week) % 11 + 1 END AS rival FROM pts),
      st AS (SELECT x.league, x.team, sum(CAST(x.points > y.points AS INTEGER)) AS wins, sum(x.points) AS points FROM rv x JOIN pts y ON x.league = y.league AND x.week = y.week AND x.rival = y.team GROUP BY 1, 2),
      sd AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY league ORDER BY wins DESC, points DESC, team) AS INTEGER) AS seed FROM st)"""


def _boot_sql(group: str, src: str, draws: int, seed: int, pre: str = "") -> str:
    """``src``: (group, cluster, total, size) as a query."""
    keys, last = _chain(seed, "draw", ["h0"], f"{pre}c", f"{pre}sl", f"{group}, draw, h0, total, size")
    fin = _finish(f"{pre}f", last, f"{group}, draw, total, size", "u")
    weight = " + ".join(f"CAST(u > {x!r}::DOUBLE AS INTEGER)" for x in B.POISSON)
    return f"""{pre}cl AS MATERIALIZED (SELECT *, {_fnv('CAST(cluster AS VARCHAR)')} AS h0 FROM ({src})), {pre}sl AS (SELECT {group}, draw, h0, total, size FROM {pre}cl, range({draws}) d(draw)), {keys}, {fin},
      {pre}e AS (SELECT {group}, draw, sum(total * w) / nullif(sum(size * w), 0) AS m FROM (SELECT {group}, draw, total, size, {weight} AS w FROM {pre}ft) GROUP BY 1, 2),
      {pre}o AS (SELECT {group}, avg(m) AS mean, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM {pre}e GROUP BY 1)"""


_SYN = _normal(3, "league", ["team"], "na", "base", "league, team", "z1")[0] + ", " + _normal(5, "league", ["team"], "nb", "base", "league, team", "z2")[0]
_ERRS = "SELECT l_returnflag, {k} AS cluster, sum(l_extendedprice * l_discount) AS total, count(*) AS size FROM lineitem GROUP BY 1, 2"
_SIMPLEX = [(i / 20, j / 20, (20 - i - j) / 20) for i in range(21) for j in range(21 - i)]
_RES_CHAIN, _RES_LAST = _chain(23, "draw", ["h0", "week"], "c", "sl", "p_type, q, h0, draw, week")
_TAILCAP = "least(greatest(0, {rise} * {r}), greatest({rise} * 1.5::DOUBLE, (q[13] - q[1]) * 0.5::DOUBLE, 2.220446049250313e-16::DOUBLE))"

QUERIES = {f.__name__: f for f in (grid_mean_trapezoid, grid_inverse_cdf, grid_running_max, grid_isotonic, grid_tails_recenter, envelope_13pt, validate_rows_errors, canonical_digest, keyed_uniform, keyed_normal_shock, round_robin_season, playoff_bracket, finish_histogram, synthetic_leagues, residual_season_sim, bootstrap_mean, cluster_bootstrap, dual_cluster, stack_simplex_grid, budget_reconcile, share_allocate, residual_quantiles, conformal_fallback, stability_labels, draft_capital_features, hierarchical_cells, hierarchical_shrink, grouping_sets_gate, boolean_gate)}
ORACLE = {
    "grid_mean_trapezoid": f"WITH {_GRID} SELECT l_partkey, round({_trap(PS, 'q')}, 8) AS mean FROM g",
    "grid_inverse_cdf": f"WITH {_GRID} SELECT l_partkey, round({_at(PS, 'q', '((l_partkey % 97) / 97.0::DOUBLE)')}, 8) AS value FROM g",
    "grid_running_max": f"WITH {_GRID} SELECT l_partkey, CAST(i - 1 AS INTEGER) AS i, round(list_max(x[1:i]), 8) AS v FROM x, range(1, 14) t(i)",
    "grid_isotonic": f"""WITH {_GRID}, s AS (SELECT l_partkey, j, k, list_avg(x[j:k]) AS m FROM x, range(1, 14) a(j), range(1, 14) b(k) WHERE j <= k),
      lo AS (SELECT l_partkey, i, j, min(m) AS m FROM s, range(1, 14) t(i) WHERE j <= i AND k >= i GROUP BY 1, 2, 3) SELECT l_partkey, CAST(i - 1 AS INTEGER) AS i, round(max(m), 8) AS v FROM lo GROUP BY 1, 2""",
    "grid_tails_recenter": f"""WITH {_GRID}, t AS (SELECT l_partkey, list_concat([greatest(0, q[1] - {_TAILCAP.format(rise='(q[2] - q[1])', r=repr(PS[0] / (PS[1] - PS[0])) + '::DOUBLE')})], q, [q[13] + {_TAILCAP.format(rise='(q[13] - q[12])', r=repr((1 - PS[-1]) / (PS[-1] - PS[-2])) + '::DOUBLE')}]) AS t FROM g)
      SELECT l_partkey, CAST(i - 1 AS INTEGER) AS i, round(t[i] * 0.9::DOUBLE, 8) AS v FROM t, range(1, 16) r(i)""",
    "envelope_13pt": f"WITH v AS (SELECT p_partkey, [p_retailprice * 0.7::DOUBLE, p_retailprice, p_retailprice * 1.4::DOUBLE] AS v FROM part), g AS (SELECT p_partkey, [{', '.join(_at([0.1, 0.5, 0.9], 'v', repr(p) + '::DOUBLE') for p in PS)}] AS g FROM v) SELECT p_partkey, CAST(i - 1 AS INTEGER) AS i, round(g[i], 6) AS v FROM g, range(1, 14) t(i)",
    "validate_rows_errors": """SELECT week_row_id, concat_ws('; ', CASE WHEN player_id = '00-0000000' THEN 'unresolved' END, CASE WHEN position IS NULL THEN 'no position' END, CASE WHEN fantasy_points_ppr IS NULL OR isnan(fantasy_points_ppr) THEN 'no points' END,
      CASE WHEN NOT isnan(fantasy_points_ppr) AND abs(fantasy_points_ppr) > 90 THEN 'impossible points' END, CASE WHEN loaded_at > make_timestamp(season + 1, 3, 1, 0, 0, 0.0) THEN 'late' END) AS errors FROM player_weeks""",
    "canonical_digest": "SELECT p_partkey, sha256(concat_ws('|', p_partkey, p_name, p_brand, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR))) AS digest FROM part",
    "keyed_uniform": f"WITH {_P}, {_U}, {_finish('f', _UN, 'p_partkey', 'u')} SELECT p_partkey, u FROM ft",
    "keyed_normal_shock": f"""WITH {_P}, {_NS}, s AS (SELECT p_partkey, z, greatest(1, p_retailprice - p_retailprice * 0.7::DOUBLE) / 1.5::DOUBLE AS dn, greatest(1, p_retailprice * 1.5::DOUBLE - p_retailprice) / 1.5::DOUBLE AS up FROM n)
      SELECT p_partkey, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN z * up ELSE z * dn END - (up - dn) / sqrt(2 * pi()), 8) AS shock FROM s""",
    "round_robin_season": f"WITH {_season_sql(200)} SELECT league, team, CAST(wins AS BIGINT) AS wins, round(points, 9) AS points, seed FROM sd",
    "playoff_bracket": f"""WITH {_season_sql(200)}, pl AS MATERIALIZED (SELECT league, CAST(team AS BIGINT) AS team, seed FROM sd WHERE seed <= 6), {', '.join(_normal(17 + r, "league", ["team"], f"q{r}", "pl", "league, team, seed", f"z{r}")[0] for r in range(3))},
      f AS MATERIALIZED (SELECT league, team, seed, round(100 + z0 * 20, 6) AS f0, round(100 + z1 * 20, 6) AS f1, round(100 + z2 * 20, 6) AS f2 FROM q0 JOIN q1 USING (league, team, seed) JOIN q2 USING (league, team, seed)),
      a AS (SELECT x.league, CASE WHEN x.f0 >= y.f0 THEN x.seed ELSE y.seed END AS seed FROM f x JOIN f y ON x.league = y.league AND x.seed = 3 AND y.seed = 6),
      b AS (SELECT x.league, CASE WHEN x.f0 >= y.f0 THEN x.seed ELSE y.seed END AS seed FROM f x JOIN f y ON x.league = y.league AND x.seed = 4 AND y.seed = 5),
      s1 AS (SELECT f.league, CASE WHEN f.f1 >= g.f1 THEN f.seed ELSE g.seed END AS seed FROM f JOIN b ON f.league = b.league AND f.seed = 1 JOIN f g ON g.league = b.league AND g.seed = b.seed),
      s2 AS (SELECT f.league, CASE WHEN f.f1 >= g.f1 THEN f.seed ELSE g.seed END AS seed FROM f JOIN a ON f.league = a.league AND f.seed = 2 JOIN f g ON g.league = a.league AND g.seed = a.seed)
      SELECT x.league, CAST(CASE WHEN x.f2 >= y.f2 THEN x.team ELSE y.team END AS INTEGER) AS champion FROM s1 JOIN s2 USING (league) JOIN f x ON x.league = s1.league AND x.seed = s1.seed JOIN f y ON y.league = s2.league AND y.seed = s2.seed""",
    "finish_histogram": f"WITH {_season_sql(200)} SELECT team, seed, count(*) AS n, round((count(*) + 1) / 212.0::DOUBLE, 8) AS smoothed FROM sd GROUP BY 1, 2",
    "synthetic_leagues": f"""WITH base AS MATERIALIZED (SELECT league, team FROM range(2000) a(league), range(10) b(team)), {_SYN}, x AS MATERIALIZED (SELECT league, team, round(z1, 9) AS skill, round(z1 + 1.5::DOUBLE * z2, 9) AS result FROM na JOIN nb USING (league, team)),
      r AS (SELECT row_number() OVER (PARTITION BY league ORDER BY skill DESC, team) AS projected, row_number() OVER (PARTITION BY league ORDER BY result DESC, team) AS finish FROM x) SELECT CAST(projected AS INTEGER) AS projected, count(*) FILTER (finish = 1) AS titles, round(avg(finish), 6) AS mean_finish FROM r GROUP BY 1""",
    "residual_season_sim": f"""WITH {_ROWS}, q AS MATERIALIZED (SELECT p_type, quantile_cont(l_extendedprice - actual, {PS}) AS q, {_fnv("replace(upper(p_type), ' ', '_')")} AS h0 FROM rows_ GROUP BY 1), sl AS (SELECT p_type, q, h0, draw, CAST(week AS BIGINT) AS week FROM q, range(1000) a(draw), range(1, 18) b(week)),
      {_RES_CHAIN}, {_finish('f', _RES_LAST, 'p_type, q, draw, week', 'u')}, t AS (SELECT p_type, draw, sum({_at(PS, 'q', 'u')}) AS t FROM ft GROUP BY 1, 2)
      SELECT p_type, round(quantile_cont(t, 0.1), 4) AS p10, round(quantile_cont(t, 0.5), 4) AS p50, round(quantile_cont(t, 0.9), 4) AS p90 FROM t GROUP BY 1""",
    "bootstrap_mean": f"WITH {_boot_sql('s_nationkey', 'SELECT s_nationkey, s_suppkey AS cluster, sum(s_acctbal) AS total, count(*) AS size FROM supplier GROUP BY 1, 2', 300, 29)} SELECT s_nationkey, round(mean, 7) AS mean, round(low, 7) AS low, round(high, 7) AS high FROM o",
    "cluster_bootstrap": f"WITH {_boot_sql('l_returnflag', _ERRS.format(k='l_suppkey'), 300, 31)} SELECT l_returnflag, round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high FROM o",
    "dual_cluster": f"""WITH {_boot_sql('l_returnflag', _ERRS.format(k='l_suppkey'), 200, 37, 'a')}, {_boot_sql('l_returnflag', _ERRS.format(k="concat_ws('-', l_suppkey, year(l_shipdate))"), 200, 41, 'b')}
      SELECT l_returnflag, round(least(ao.low, bo.low), 4) AS low, round(greatest(ao.high, bo.high), 4) AS high FROM ao JOIN bo USING (l_returnflag)""",
    "stack_simplex_grid": f"""WITH w(g, w0, w1, w2, x) AS (VALUES {', '.join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {e!r}::DOUBLE, {0.01 * ((a - 1 / 3) ** 2 + (b - 1 / 3) ** 2 + (e - 1 / 3) ** 2)!r}::DOUBLE)" for i, (a, b, e) in enumerate(_SIMPLEX))}),
      r AS (SELECT position, target_ppr_total AS y, fantasy_points_ppr_lag1 AS a, coalesce(CASE WHEN NOT isnan(fantasy_points_ppr_lag2) THEN fantasy_points_ppr_lag2 END, fantasy_points_ppr_lag1) AS b FROM player_examples WHERE target_ppr_total IS NOT NULL AND NOT isnan(target_ppr_total) AND fantasy_points_ppr_lag1 IS NOT NULL AND NOT isnan(fantasy_points_ppr_lag1)),
      s AS (SELECT position, g, w0, w1, w2, any_value(x) AS x, avg(abs(a * w0 + b * w1 + 90.0 * w2 - y)) AS mae FROM r, w GROUP BY 1, 2, 3, 4, 5), b AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY round(mae + x, 9), g) AS n FROM s)
      SELECT position, w0, w1, w2, round(mae, 6) AS mae FROM b WHERE n = 1""",
    "budget_reconcile": f"WITH {_SEASONS} SELECT player_id, season, round(fantasy_points_ppr * coalesce(least(greatest(900.0::DOUBLE / nullif(sum(fantasy_points_ppr) OVER (PARTITION BY recent_team, season), 0), 0.8::DOUBLE), 1.25::DOUBLE), 1), 6) AS scaled FROM s WHERE recent_team IS NOT NULL",
    "share_allocate": f"""WITH {_SEASONS}, a AS (SELECT player_id, season, recent_team, targets, coalesce(CASE WHEN NOT isnan(target_share) THEN target_share END, 0) AS share, sum(targets) OVER (PARTITION BY recent_team, season) AS total FROM s WHERE recent_team IS NOT NULL AND targets IS NOT NULL),
      b AS (SELECT *, 0.6::DOUBLE * coalesce(targets / nullif(total, 0), 0) + 0.4::DOUBLE * share AS mix FROM a), t AS (SELECT *, sum(mix) OVER (PARTITION BY recent_team, season) AS al FROM b) SELECT player_id, season, round(550 * mix / al, 6) AS allocated FROM t WHERE al > 0""",
    "residual_quantiles": f"WITH {_ROWS}, q AS (SELECT p_type, quantile_cont(actual - l_extendedprice, [0.1, 0.9]) AS q FROM rows_ GROUP BY 1) SELECT p_partkey, round(greatest(0, p_retailprice * 20 + q[1]), 8) AS p10, round(greatest(0, p_retailprice * 20 + q[2]), 8) AS p90 FROM part JOIN q USING (p_type)",
    "conformal_fallback": """WITH x AS (SELECT p_brand, p_size, -l_extendedprice * l_discount AS r FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT p_brand, p_size, quantile_cont(r, 0.9) AS fine, count(*) AS n FROM x GROUP BY 1, 2), k AS (SELECT p_brand, quantile_cont(r, 0.9) AS coarse FROM x GROUP BY 1)
      SELECT p_brand, p_size, n, round(CASE WHEN n >= 40 THEN fine ELSE coarse END, 8) + 0.0 AS bound FROM f JOIN k USING (p_brand)""",
    "stability_labels": """WITH w AS (SELECT player_id, fantasy_points, median(fantasy_points) OVER (PARTITION BY player_id) AS m FROM player_weeks WHERE player_id <> '00-0000000' AND fantasy_points IS NOT NULL AND NOT isnan(fantasy_points)),
      t AS (SELECT player_id, count(*) AS n, (count(*) FILTER (abs(fantasy_points - m) > 6) + 2.0::DOUBLE) / (count(*) + 8.0::DOUBLE) AS rate FROM w GROUP BY 1) SELECT player_id, n, round(rate, 8) AS rate, CASE WHEN rate <= 0.2::DOUBLE THEN 'steady' WHEN rate >= 0.45::DOUBLE THEN 'volatile' ELSE 'mixed' END AS label FROM t""",
    "draft_capital_features": "SELECT team, count(*) AS n, round(sum(exp(-(draft_pick - 1) / 60.0::DOUBLE)), 8) AS capital, round(avg(1 / sqrt(greatest(1, draft_pick)::DOUBLE)), 8) AS mean_capital FROM players WHERE draft_pick IS NOT NULL GROUP BY 1",
    "hierarchical_cells": """WITH x AS (SELECT l_returnflag, l_linestatus, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(l_discount < 0.02::DOUBLE AS DOUBLE) AS z FROM lineitem)
      SELECT l_returnflag, l_linestatus, tax, CAST(grouping(l_returnflag, l_linestatus, tax) AS INTEGER) AS level, count(*) AS n, round(avg(z), 8) AS rate FROM x GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, tax), (l_returnflag, l_linestatus), (l_returnflag), ())""",
    "hierarchical_shrink": """WITH x AS (SELECT l_returnflag, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(l_discount < 0.02::DOUBLE AS DOUBLE) AS z FROM lineitem), m AS (SELECT l_returnflag, (sum(z) + (SELECT avg(z) FROM x) * 50) / (count(*) + 50) AS r1 FROM x GROUP BY 1)
      SELECT x.l_returnflag, tax, round((sum(z) + any_value(r1) * 50) / (count(*) + 50), 8) AS rate FROM x JOIN m ON x.l_returnflag = m.l_returnflag GROUP BY 1, 2""",
    "grouping_sets_gate": f"WITH {_ROWS} SELECT l_returnflag, p_type, count(*) AS n, round(avg(abs(l_extendedprice - actual)), 8) AS mae FROM rows_ GROUP BY GROUPING SETS ((), (l_returnflag), (p_type), (l_returnflag, p_type)) HAVING count(*) >= 10",
    "boolean_gate": "WITH x AS (SELECT l_suppkey, year(l_shipdate) AS y, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, bool_and(a <= b * 1.6::DOUBLE) AS every_season, avg(a) <= avg(b) * 1.4::DOUBLE AS overall FROM x GROUP BY 1",
}
