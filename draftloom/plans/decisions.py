"""Queries of the decision layer."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import decision as D
from draftloom.operators import ranks
from draftloom.plans.temporal import _SEASONS, _seasons
from draftloom.session import read

c = F.col
R = lambda x, n=6: F.round(x, n)
SLOTS, FLEX_SLOTS = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "K": 1}, 1
# fixed values: starters of a position demanded by a league of 12 teams
DEMAND = {"QB": 12, "RB": 29, "WR": 29, "TE": 13, "K": 12}


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return _seasons(spark, d).select("player_id", "season", "position", c("recent_team").alias("team"), c("fantasy_points_ppr").alias("mean"), "games", "targets", "carries")


def _demand() -> F.Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEMAND.items() for x in kv]), c("position")), F.lit(1))


def snake_slots(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 193).select(c("id").alias("pick"), S.snake_slot(c("id"), 12).alias("slot"))


def next_pick_for_slot(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 193).crossJoin(spark.range(1, 13).select(c("id").cast("int").alias("slot"))).select(c("id").cast("int").alias("after"), "slot", S.next_pick(c("id").cast("int"), c("slot"), 12, 16).alias("next"))


def replacement_level(spark: SparkSession, d: str) -> DataFrame:
    return D.replacement(_pool(spark, d), ["season", "position"], "mean", "player_id", _demand())


def value_over_replacement(spark: SparkSession, d: str) -> DataFrame:
    return D.over_replacement(_pool(spark, d), ["season", "position"], "mean", "player_id", _demand()).select("player_id", "season", R("over").alias("over"))


def position_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranks.placed(_pool(spark, d), ["season", "position"], [c("mean").desc(), c("player_id")], "rank").select("player_id", "season", "rank")


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return D.top_k(_pool(spark, d), ["season", "position"], [c("mean").desc(), c("player_id")], 12).select("season", "position", "player_id", "place")


def locked_cohort(spark: SparkSession, d: str) -> DataFrame:
    return D.top_k(_pool(spark, d), ["season", "position"], [c("mean").desc(), c("player_id")], _demand(), max(DEMAND.values())).select("season", "player_id")


def position_rank_curve(spark: SparkSession, d: str) -> DataFrame:
    """Median over seasons of the k-th best of a position."""
    top = D.top_k(_pool(spark, d), ["season", "position"], [c("mean").desc(), c("player_id")], 40)
    return top.groupBy("position", "place").agg(R(F.median("mean")).alias("median"), F.count(F.lit(1)).alias("seasons"))


def board_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 of the board: missing market positions last, whatever the direction."""
    x = read(spark, d, "source_listings").select("listing_id", "adp", "mean", "name")
    x = x.withColumn("adp", F.when(F.isnan("adp"), None).otherwise(c("adp"))).withColumn("mean", F.when(F.isnan("mean"), None).otherwise(c("mean")))
    top = x.orderBy(c("adp").asc_nulls_last(), c("mean").desc_nulls_last(), c("listing_id")).limit(200)
    return top.select("listing_id", "adp", "mean")


def shortlist_top_n(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").orderBy(c("p_retailprice").desc(), "p_partkey").limit(24).select("p_partkey", "p_retailprice")


def candidate_frontier(spark: SparkSession, d: str) -> DataFrame:
    """An ordered union of pickers, each candidate once, at its first picker, the first 18."""
    p = read(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    best = lambda order: F.row_number().over(Window.partitionBy("p_type").orderBy(*order))
    a = p.withColumn("rank", best([c("p_retailprice").desc(), c("p_partkey")])).where("rank <= 1").withColumn("picker", F.lit(0))
    b = p.withColumn("rank", best([c("p_size").desc(), c("p_partkey")])).where("rank <= 2").withColumn("picker", F.lit(1))
    top = p.orderBy(c("p_retailprice").desc(), "p_partkey").limit(8).withColumn("rank", F.lit(9)).withColumn("picker", F.lit(2))
    first = a.unionByName(b).unionByName(top).groupBy("p_partkey").agg(F.min(F.struct("picker", "rank", "p_partkey")).alias("o"))
    return first.orderBy("o").limit(18).select("p_partkey", c("o.picker").alias("picker"))


def shortlist_required_first(spark: SparkSession, d: str) -> DataFrame:
    """Ten candidates: the first of each required type, then the best of the rest, shown by rank."""
    p = read(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("p_type").orderBy(c("p_retailprice").desc(), "p_partkey")))
    return ranked.orderBy((c("rank") == 1).desc(), c("p_retailprice").desc(), "p_partkey").limit(10).select("p_partkey", "rank")


def draftable_antijoin(spark: SparkSession, d: str) -> DataFrame:
    drafted = read(spark, d, "lineitem").where("l_quantity >= 45").select("l_partkey")
    return read(spark, d, "part").join(drafted, c("p_partkey") == c("l_partkey"), "left_anti").where("p_size > 1").select("p_partkey")


def market_window_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates near the market, and each metric's two outliers per type, once each."""
    p = read(spark, d, "part")
    near = p.where(c("p_size").between(10, 14)).select("p_partkey")
    out = lambda col: D.top_k(p, ["p_type"], [c(col).desc(), c("p_partkey")], 2).select("p_partkey")
    return near.unionByName(out("p_retailprice")).unionByName(out("p_size")).distinct()


def round_robin_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen weeks of a twelve-team league by the circle method."""
    wk, i = spark.range(14).select(c("id").cast("int").alias("week")), spark.range(6).select(c("id").cast("int").alias("i"))
    team = lambda x: F.when(x == 0, F.lit(0)).otherwise(F.pmod(x - 1 + c("week"), F.lit(11)) + 1)
    return wk.crossJoin(i).select((c("week") + 1).alias("week"), team(c("i")).alias("home"), team(11 - c("i")).alias("away"))


def points_bucket_ladder(spark: SparkSession, d: str) -> DataFrame:
    # fixed values: points for points allowed
    steps = [(0, 10.0), (6, 7.0), (13, 4.0), (20, 1.0), (27, 0.0), (34, -1.0)]
    return read(spark, d, "lineitem").groupBy(c("l_quantity").alias("allowed")).agg(F.count(F.lit(1)).alias("n")).select("allowed", "n", S.ladder(c("allowed"), steps, -4.0).alias("points"))


def linear_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Half- and full-reception points from standard points and receptions, never below nought."""
    w = read(spark, d, "player_weeks").where(c("fantasy_points").isNotNull() & ~F.isnan("fantasy_points"))
    rec = F.coalesce(c("receptions").cast("double"), F.lit(0.0))
    return w.select("week_row_id", R(F.greatest(F.lit(0.0), c("fantasy_points") + 0.5 * rec)).alias("half"), R(F.greatest(F.lit(0.0), c("fantasy_points") + rec)).alias("full"))


def lineup_fixed_flex(spark: SparkSession, d: str) -> DataFrame:
    x = D.line_up(_pool(spark, d).where("team is not null"), ["team", "season"], "position", "mean", "player_id", SLOTS, FLEX_SLOTS)
    return x.select("team", "season", "player_id", "slot")


def lineup_score(spark: SparkSession, d: str) -> DataFrame:
    x = D.line_up(_pool(spark, d).where("team is not null"), ["team", "season"], "position", "mean", "player_id", SLOTS, FLEX_SLOTS)
    return x.groupBy("team", "season").agg(R(F.sum("mean"), 4).alias("score"), F.count(F.lit(1)).alias("starters"))


def marginal_starter_value(spark: SparkSession, d: str) -> DataFrame:
    """What each player adds to the own team's line-up: the line-up with the player minus the line-up without."""
    pool = _pool(spark, d).where("team is not null")
    whole = D.line_up(pool, ["team", "season"], "position", "mean", "player_id", SLOTS, FLEX_SLOTS)
    score = whole.groupBy("team", "season").agg(F.sum("mean").alias("score"))
    # only a starter can change the line-up: leave each starter out once
    out = whole.select("team", "season", c("player_id").alias("without"))
    rest = pool.join(out, ["team", "season"]).where("player_id <> without")
    reduced = D.line_up(rest, ["team", "season", "without"], "position", "mean", "player_id", SLOTS, FLEX_SLOTS).groupBy("team", "season", "without").agg(F.sum("mean").alias("reduced"))
    return out.join(score, ["team", "season"]).join(reduced, ["team", "season", "without"], "left").select(c("without").alias("player_id"), "team", "season", R(c("score") - F.coalesce("reduced", F.lit(0.0)), 4).alias("marginal"))


def roster_needs(spark: SparkSession, d: str) -> DataFrame:
    n = _pool(spark, d).where("team is not null").groupBy("team", "season").agg(*[F.count_if(c("position") == p).alias(f"n_{p}") for p in SLOTS])
    need = [F.greatest(F.lit(0), F.lit(k) - c(f"n_{p}")).cast("int").alias(p) for p, k in SLOTS.items()]
    over = F.greatest(F.lit(0), c("n_RB") - 2) + F.greatest(F.lit(0), c("n_WR") - 2) + F.greatest(F.lit(0), c("n_TE") - 1)
    return n.select("team", "season", *need, F.greatest(F.lit(0), F.lit(FLEX_SLOTS) - over).cast("int").alias("FLEX"))


def starter_access_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("s", c("p_size") / 51.0)
    x = D.access_by_prefix(p, "p_brand", [c("p_retailprice").desc(), c("p_partkey")], c("p_retailprice"), c("s"))
    return x.select("p_partkey", R("reach", 8).alias("reach"), R("access").alias("access"))


def tier_selection(spark: SparkSession, d: str) -> DataFrame:
    """At most three of a position within max(8, 8 %) of its leader."""
    x = D.top_k(_pool(spark, d), ["season", "position"], [c("mean").desc(), c("player_id")], 3).withColumnRenamed("place", "n")
    x = x.withColumn("lead", F.max(F.when(c("n") == 1, c("mean"))).over(Window.partitionBy("season", "position")))
    return x.where((c("n") <= 3) & ((c("n") == 1) | (c("lead") - c("mean") <= F.greatest(F.lit(8.0), c("lead") * 0.08)))).select("season", "position", "player_id", "n")


def market_survival(spark: SparkSession, d: str) -> DataFrame:
    """The chance that a listed player is still there at pick 60, given it is at pick 40."""
    curve = [(1.0, 2.5), (24.0, 6.0), (60.0, 12.0), (120.0, 20.0), (200.0, 28.0)]
    adp = F.when(F.isnan("adp"), None).otherwise(c("adp"))
    x = read(spark, d, "source_listings").select("listing_id", F.when((adp > 0) & (adp < 500), adp).alias("adp"))
    alive = lambda pick: S.clamp(1 - S.normal_cdf_erf((F.lit(pick) - 0.5 - c("adp")) / S.interpolate(c("adp"), curve)))
    p = F.when(c("adp").isNull(), 0.5).when(alive(40.0) < 1e-9, 0.0).otherwise(S.clamp(F.try_divide(alive(60.0), alive(40.0))))
    return x.select("listing_id", R(p).alias("survival"))


WEIGHTS = {"price": 0.5, "size": 0.3, "use": 0.2}


def _factors(spark: SparkSession, d: str) -> DataFrame:
    use = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    p = read(spark, d, "part").join(use, c("p_partkey") == c("l_partkey"), "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    ends = p.agg(F.min("p_retailprice").alias("a0"), F.max("p_retailprice").alias("a1"), F.min("p_size").alias("b0"), F.max("p_size").alias("b1"), F.min("q").alias("c0"), F.max("q").alias("c1"))
    x = p.crossJoin(F.broadcast(ends))
    scale = lambda v, a, b: (v - a) / (b - a)
    return x.select("p_partkey", "p_type", scale(c("p_retailprice"), c("a0"), c("a1")).alias("price"), scale(c("p_size"), c("b0"), c("b1")).alias("size"), scale(c("q"), c("c0"), c("c1")).alias("use"))


def weighted_score_drivers(spark: SparkSession, d: str) -> DataFrame:
    """Weighted score of each candidate and its two strongest drivers."""
    impact = [F.struct((-F.abs(F.round((c(k) - 0.5) * w, 9))).alias("o"), F.lit(k).alias("k")) for k, w in WEIGHTS.items()]
    score = sum((c(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    drivers = F.array_join(F.transform(F.slice(F.array_sort(F.array(*impact)), 1, 2), lambda x: x["k"]), ",")
    return _factors(spark, d).select("p_partkey", R(score, 8).alias("score"), drivers.alias("drivers"))


def candidate_board_reasons(spark: SparkSession, d: str) -> DataFrame:
    ranked = D.top_k(read(spark, d, "part").where("p_size > 5"), ["p_type"], [c("p_retailprice").desc(), c("p_partkey")], 20).select("p_partkey", "place")
    drafted = read(spark, d, "lineitem").where("l_quantity >= 49").select(c("l_partkey").alias("p_partkey")).distinct().withColumn("gone", F.lit(True))
    x = read(spark, d, "part").join(ranked, "p_partkey", "left").join(drafted, "p_partkey", "left")
    why = F.when(c("gone"), "drafted").when(c("p_size") <= 5, "not eligible").when(c("place").isNull(), "outside the window").otherwise("ranked")
    return x.select("p_partkey", "place", why.alias("reason"))


def dominance_pairs(spark: SparkSession, d: str) -> DataFrame:
    top = D.top_k(read(spark, d, "part"), ["p_type"], [c("p_retailprice").desc(), c("p_partkey")], 24)
    return D.dominance(top, "p_type", "p_partkey", [("p_retailprice", 0.05), ("p_size", 1.0)])


def dominance_order(spark: SparkSession, d: str) -> DataFrame:
    top = D.top_k(read(spark, d, "part"), ["p_type"], [c("p_retailprice").desc(), c("p_partkey")], 24).select("p_type", "p_partkey", "p_retailprice", "p_size")
    metrics = [("p_retailprice", 0.05), ("p_size", 1.0)]
    return top.groupBy("p_type").applyInPandas(lambda g: D.peel(g, "p_partkey", "p_retailprice", metrics)[["p_type", "p_partkey", "place"]], "p_type string, p_partkey long, place int")


def evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "lineitem").groupBy(c("l_suppkey").alias("key")).agg(F.avg("l_discount").alias("value"), (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("error"))
    one = s.join(read(spark, d, "supplier").select(c("s_suppkey").alias("key"), "s_nationkey"), "key").withColumn("error", F.coalesce("error", F.lit(0.0)))
    run = lambda g: D.merge_groups(g, "value", "error", 1.96)[["s_nationkey", "key", "value", "tier"]]
    return one.groupBy("s_nationkey").applyInPandas(run, "s_nationkey int, key long, value double, tier int")


def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    """Two candidates' outcomes in the same scenarios: mean difference, its error and a 95 % interval."""
    l = read(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("v"))
    base = read(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), (c("o_totalprice") / 10000).alias("base"))
    x = l.join(base, "l_orderkey").withColumn("diff", c("v") - c("base"))
    t = x.groupBy("l_suppkey").agg(F.avg("diff").alias("m"), (F.stddev_samp("diff") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.select("l_suppkey", "n", R("m", 7).alias("mean"), R("se", 7).alias("se"), R(c("m") - 1.96 * c("se"), 7).alias("low"), R(c("m") + 1.96 * c("se"), 7).alias("high"))


def title_calibration(spark: SparkSession, d: str) -> DataFrame:
    x = spark.range(0, 10001, 250)
    # fixed values: a prior of 15,000 scenarios at one over twelve teams
    return x.select(c("id").alias("wins"), R((c("id") + 15000.0 / 12) / (10000 + 15000)).alias("probability"))


def staged_z(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([(n,) for n in (1000, 2500, 5000, 10000)], "scenarios int")
    # fixed value: the z of a sequence of looks
    return x.select("scenarios", R(2.75 / F.sqrt(c("scenarios") / 10000.0), 8).alias("z"))


_POOL = f"{_SEASONS}, p AS (SELECT player_id, season, position, recent_team AS team, fantasy_points_ppr AS mean FROM s)"
_D = "CASE position " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEMAND.items()) + " ELSE 1 END"
_RANK = f"{_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY mean DESC, player_id) AS rn, count(*) OVER (PARTITION BY season, position) AS n, {_D} AS demand FROM p)"
_REPL = f"{_RANK}, q AS (SELECT season, position, mean AS replacement FROM r WHERE rn - 1 = least(demand, n - 1))"
_FIXED = "CASE position " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLOTS.items()) + " ELSE 0 END"


def _lineup(src: str, team: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, row_number() OVER (PARTITION BY {team}, position ORDER BY mean DESC, player_id) <= {_FIXED} AS fixed FROM {src}),
      {name} AS (SELECT *, CASE WHEN fixed THEN position ELSE 'FLEX' END AS slot FROM (SELECT *, row_number() OVER (PARTITION BY {team}, NOT fixed AND position IN ('RB','WR','TE') ORDER BY mean DESC, player_id) AS f FROM {name}1)
        WHERE fixed OR (position IN ('RB','WR','TE') AND f <= {FLEX_SLOTS}))"""


_TEAM = f"{_POOL}, t AS (SELECT * FROM p WHERE team IS NOT NULL), {_lineup('t', 'team, season', 'l')}"
_ERF = "0.5::DOUBLE * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - ((((t * 1.061405429::DOUBLE - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-1 * pow(abs(z) / sqrt(2.0::DOUBLE), 2))))"
_CURVE = [(1.0, 2.5), (24.0, 6.0), (60.0, 12.0), (120.0, 20.0), (200.0, 28.0)]
_SD = "CASE WHEN adp <= 1 THEN 2.5 " + " ".join(f"WHEN adp <= {b} THEN {va} + ({vb} - {va}) * (adp - {a}) / ({b} - {a})" for (a, va), (b, vb) in zip(_CURVE, _CURVE[1:])) + " ELSE 28.0 END"
_FACT = """u AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), x AS (SELECT p_partkey, p_retailprice AS a, p_size AS b, coalesce(q, 0) AS q FROM part LEFT JOIN u ON p_partkey = l_partkey),
      f AS (SELECT p_partkey, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS price, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS size, (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()) AS use FROM x)"""

QUERIES = {f.__name__: f for f in (snake_slots, next_pick_for_slot, replacement_level, value_over_replacement, position_rank, topk_per_group, locked_cohort, position_rank_curve, board_nulls_last, shortlist_top_n, candidate_frontier, shortlist_required_first, draftable_antijoin, market_window_union, round_robin_pairs, points_bucket_ladder, linear_scoring, lineup_fixed_flex, lineup_score, marginal_starter_value, roster_needs, starter_access_prefix, tier_selection, market_survival, weighted_score_drivers, candidate_board_reasons, dominance_pairs, dominance_order, evidence_groups, paired_difference, title_calibration, staged_z)}
ORACLE = {
    "snake_slots": "SELECT pick, CAST(CASE WHEN ((pick - 1) // 12) % 2 = 0 THEN (pick - 1) % 12 + 1 ELSE 12 - (pick - 1) % 12 END AS INTEGER) AS slot FROM range(1, 193) t(pick)",
    "next_pick_for_slot": """WITH p AS (SELECT pick, CASE WHEN ((pick - 1) // 12) % 2 = 0 THEN (pick - 1) % 12 + 1 ELSE 12 - (pick - 1) % 12 END AS slot FROM range(1, 193) t(pick))
      SELECT CAST(a.after AS INTEGER) AS after, CAST(s.slot AS INTEGER) AS slot, CAST((SELECT min(pick) FROM p WHERE p.slot = s.slot AND p.pick > a.after) AS INTEGER) AS next FROM range(0, 193) a(after), range(1, 13) s(slot)""",
    "replacement_level": f"WITH {_REPL} SELECT * FROM q",
    "value_over_replacement": f"WITH {_REPL} SELECT player_id, season, round(mean - replacement, 6) AS over FROM r JOIN q USING (season, position)",
    "position_rank": f"WITH {_RANK} SELECT player_id, season, CAST(rn AS INTEGER) AS rank FROM r",
    "topk_per_group": f"WITH {_RANK} SELECT season, position, player_id, CAST(rn AS INTEGER) AS place FROM r WHERE rn <= 12",
    "locked_cohort": f"WITH {_RANK} SELECT season, player_id FROM r WHERE rn <= demand",
    "position_rank_curve": f"WITH {_RANK} SELECT position, CAST(rn AS INTEGER) AS place, round(median(mean), 6) AS median, count(*) AS seasons FROM r WHERE rn <= 40 GROUP BY 1, 2",
    "board_nulls_last": "SELECT listing_id, a AS adp, m AS mean FROM (SELECT listing_id, CASE WHEN NOT isnan(adp) THEN adp END AS a, CASE WHEN NOT isnan(mean) THEN mean END AS m FROM source_listings) ORDER BY a ASC NULLS LAST, m DESC NULLS LAST, listing_id LIMIT 200",
    "shortlist_top_n": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 24",
    "candidate_frontier": """WITH a AS (SELECT p_partkey, 0 AS picker, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), b AS (SELECT p_partkey, 1 AS picker, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS rank FROM part),
      t AS (SELECT p_partkey, 2 AS picker, 9 AS rank FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 8), u AS (SELECT * FROM a WHERE rank <= 1 UNION ALL SELECT * FROM b WHERE rank <= 2 UNION ALL SELECT * FROM t),
      f AS (SELECT p_partkey, picker, rank, row_number() OVER (PARTITION BY p_partkey ORDER BY picker, rank) AS n FROM u) SELECT p_partkey, picker FROM f WHERE n = 1 ORDER BY picker, rank, p_partkey LIMIT 18""",
    "shortlist_required_first": "WITH r AS (SELECT p_partkey, p_retailprice, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part) SELECT p_partkey, rank FROM r ORDER BY (rank = 1) DESC, p_retailprice DESC, p_partkey LIMIT 10",
    "draftable_antijoin": "SELECT p_partkey FROM part WHERE p_size > 1 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)",
    "market_window_union": """SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 14 UNION SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 2
      UNION SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n <= 2""",
    "round_robin_pairs": "SELECT CAST(w + 1 AS INTEGER) AS week, CAST(CASE WHEN i = 0 THEN 0 ELSE (i - 1 + w) % 11 + 1 END AS INTEGER) AS home, CAST((10 - i + w) % 11 + 1 AS INTEGER) AS away FROM range(14) a(w), range(6) b(i)",
    "points_bucket_ladder": "SELECT l_quantity AS allowed, count(*) AS n, CAST(CASE WHEN l_quantity <= 0 THEN 10 WHEN l_quantity <= 6 THEN 7 WHEN l_quantity <= 13 THEN 4 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 27 THEN 0 WHEN l_quantity <= 34 THEN -1 ELSE -4 END AS DOUBLE) AS points FROM lineitem GROUP BY 1",
    "linear_scoring": "SELECT week_row_id, round(greatest(0, fantasy_points + 0.5::DOUBLE * coalesce(receptions, 0)), 6) AS half, round(greatest(0, fantasy_points + coalesce(receptions, 0)), 6) AS \"full\" FROM player_weeks WHERE fantasy_points IS NOT NULL AND NOT isnan(fantasy_points)",
    "lineup_fixed_flex": f"WITH {_TEAM} SELECT team, season, player_id, slot FROM l",
    "lineup_score": f"WITH {_TEAM} SELECT team, season, round(sum(mean), 4) AS score, count(*) AS starters FROM l GROUP BY 1, 2",
    "marginal_starter_value": f"""WITH {_TEAM}, sc AS (SELECT team, season, sum(mean) AS score FROM l GROUP BY 1, 2), w AS (SELECT t.*, l.player_id AS without FROM t JOIN l ON t.team = l.team AND t.season = l.season AND t.player_id <> l.player_id),
      {_lineup('w', 'team, season, without', 'm')}, rd AS (SELECT team, season, without, sum(mean) AS reduced FROM m GROUP BY 1, 2, 3)
      SELECT l.player_id, l.team, l.season, round(score - coalesce(reduced, 0), 4) AS marginal FROM l JOIN sc ON l.team = sc.team AND l.season = sc.season LEFT JOIN rd ON rd.team = l.team AND rd.season = l.season AND rd.without = l.player_id""",
    "roster_needs": f"""WITH {_POOL}, n AS (SELECT team, season, {', '.join(f"count(*) FILTER (position = '{k}') AS n{k}" for k in SLOTS)} FROM p WHERE team IS NOT NULL GROUP BY 1, 2)
      SELECT team, season, {', '.join(f'CAST(greatest(0, {v} - n{k}) AS INTEGER) AS "{k}"' for k, v in SLOTS.items())}, CAST(greatest(0, 1 - (greatest(0, nRB - 2) + greatest(0, nWR - 2) + greatest(0, nTE - 1))) AS INTEGER) AS "FLEX" FROM n""",
    "starter_access_prefix": """WITH s AS (SELECT *, p_size / 51.0::DOUBLE AS s FROM part), g AS (SELECT *, coalesce(exp(sum(ln(greatest(1e-12::DOUBLE, 1 - s))) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS gone FROM s)
      SELECT p_partkey, round(gone * s, 8) AS reach, round(sum(gone * s * p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING), 6) AS access FROM g""",
    "tier_selection": f"WITH {_RANK}, l AS (SELECT *, first_value(mean) OVER (PARTITION BY season, position ORDER BY mean DESC, player_id) AS lead FROM r) SELECT season, position, player_id, CAST(rn AS INTEGER) AS n FROM l WHERE rn <= 3 AND (rn = 1 OR lead - mean <= greatest(8, lead * 0.08::DOUBLE))",
    "market_survival": f"""WITH a AS (SELECT listing_id, CASE WHEN NOT isnan(adp) AND adp > 0 AND adp < 500 THEN adp END AS adp FROM source_listings), b AS (SELECT *, CAST({_SD} AS DOUBLE) AS sd FROM a),
      z AS (SELECT listing_id, adp, pick, (pick - 0.5::DOUBLE - adp) / sd AS z FROM b, (VALUES (40.0::DOUBLE), (60.0::DOUBLE)) v(pick)), t AS (SELECT *, 1 / (1 + abs(z) / sqrt(2.0::DOUBLE) * 0.3275911::DOUBLE) AS t FROM z),
      l AS (SELECT listing_id, adp, max(CASE WHEN pick = 40 THEN least(greatest(1 - {_ERF}, 0), 1) END) AS now, max(CASE WHEN pick = 60 THEN least(greatest(1 - {_ERF}, 0), 1) END) AS later FROM t GROUP BY 1, 2)
      SELECT listing_id, round(CASE WHEN adp IS NULL THEN 0.5::DOUBLE WHEN now < 1e-9::DOUBLE THEN 0 ELSE least(greatest(later / now, 0), 1) END, 6) AS survival FROM l""",
    "weighted_score_drivers": f"""WITH {_FACT}, i AS (SELECT *, list_sort([{', '.join(f"{{'o': -abs(round(({k} - 0.5::DOUBLE) * {w}::DOUBLE, 9)), 'k': '{k}'}}" for k, w in WEIGHTS.items())}]) AS i FROM f)
      SELECT p_partkey, round(price * 0.5::DOUBLE + size * 0.3::DOUBLE + use * 0.2::DOUBLE, 8) AS score, concat(i[1].k, ',', i[2].k) AS drivers FROM i""",
    "candidate_board_reasons": """WITH r AS (SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part WHERE p_size > 5), k AS (SELECT * FROM r WHERE place <= 20), g AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49)
      SELECT p.p_partkey, place, CASE WHEN l_partkey IS NOT NULL THEN 'drafted' WHEN p_size <= 5 THEN 'not eligible' WHEN place IS NULL THEN 'outside the window' ELSE 'ranked' END AS reason FROM part p LEFT JOIN k USING (p_partkey) LEFT JOIN g ON l_partkey = p.p_partkey""",
    "dominance_pairs": """WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 24)
      SELECT a.p_type, a.p_partkey AS winner, b.p_partkey AS loser FROM t a JOIN t b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey WHERE a.p_retailprice >= b.p_retailprice - 0.05::DOUBLE AND a.p_size >= b.p_size - 1 AND (a.p_retailprice > b.p_retailprice + 0.05::DOUBLE OR a.p_size > b.p_size + 1)""",
    "paired_difference": """WITH l AS (SELECT l_suppkey, l_orderkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), x AS (SELECT l_suppkey, v - o_totalprice / 10000 AS diff FROM l JOIN orders ON o_orderkey = l_orderkey),
      t AS (SELECT l_suppkey, count(*) AS n, avg(diff) AS m, stddev_samp(diff) / sqrt(count(*)) AS se FROM x GROUP BY 1 HAVING count(*) > 1) SELECT l_suppkey, n, round(m, 7) AS mean, round(se, 7) AS se, round(m - 1.96::DOUBLE * se, 7) AS low, round(m + 1.96::DOUBLE * se, 7) AS high FROM t""",
    "title_calibration": "SELECT w AS wins, round((w + 15000.0::DOUBLE / 12) / 25000, 6) AS probability FROM range(0, 10001, 250) t(w)",
    "staged_z": "SELECT CAST(n AS INTEGER) AS scenarios, round(2.75::DOUBLE / sqrt(n / 10000.0::DOUBLE), 8) AS z FROM (VALUES (1000), (2500), (5000), (10000)) t(n)",
}
