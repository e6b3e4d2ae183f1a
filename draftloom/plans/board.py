"""The candidate board: demand, needs, caps, availability, the weighted score and dominance, per source of listings.

A board is the set of listings of one source; a roster is one team of one season.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import ranks
from draftloom.plans.temporal import _SEASONS, _seasons
from draftloom.session import read

c = F.col
R = lambda x, n=6: F.round(x, n)
# fixed values: a league's size, rounds and slots
TEAMS, ROUNDS = 12, 16
SLOTS = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "K": 1, "DST": 1}
FLEX, BENCH = 1, 6
FLEXIBLE = ("RB", "WR", "TE")
POSITIONS = tuple(SLOTS)
# fixed values: shares of a flexible slot and of one that also takes quarterbacks
FLEX_SHARE = {"RB": 0.45, "WR": 0.45, "TE": 0.10}
SUPER_SHARE = {"QB": 0.75, "RB": 0.25 / 3, "WR": 0.25 / 3, "TE": 0.25 / 3}
# fixed values: weights of the balanced strategy and of the profile led by projections, mixed 65 to 35
STRATEGY = {"projection": 0.52, "ceiling": 0.10, "floor": 0.08, "scarcity": 0.09, "need": 0.15, "availability": 0.04, "risk": -0.03}
PROFILE = {"projection": 0.55, "ceiling": 0.10, "floor": 0.08, "scarcity": 0.08, "need": 0.14, "availability": 0.04, "risk": -0.03}
WEIGHTS = {k: round(STRATEGY[k] * 0.65 + PROFILE[k] * 0.35, 10) for k in STRATEGY}
CURVE = [(1.0, 2.5), (24.0, 6.0), (60.0, 12.0), (120.0, 20.0), (200.0, 28.0)]


def _of(table: dict, key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def demand(position: Column, teams: Column | int = TEAMS, superflex: Column | int = 0) -> Column:
    """Starters of a position that a league asks for, its share of the flexible slots included; at least one."""
    teams, superflex = (x if isinstance(x, Column) else F.lit(x) for x in (teams, superflex))
    raw = teams * (_of({k: float(v) for k, v in SLOTS.items()}, position, 0.0) + FLEX * _of(FLEX_SHARE, position, 0.0) + superflex * _of(SUPER_SHARE, position, 0.0))
    return F.greatest(F.lit(1), S.half_up(raw)).cast("int")


def cap(position: Column) -> Column:
    """How many of a position a roster can use at all."""
    required = _of(SLOTS, position, 0)
    return F.when(position.isin("QB", "TE"), required + 1).when(position.isin("RB", "WR"), required + FLEX + max(1, -(-BENCH * 35 // 100))).otherwise(required).cast("int")


def _rosters(spark: SparkSession, d: str) -> DataFrame:
    """Per team and season: n_<position>, open_<position> and open_FLEX, and the picks still to make."""
    x = _seasons(spark, d).where("recent_team is not null").groupBy("recent_team", "season").agg(*[F.count_if(c("position") == p).cast("int").alias(f"n_{p}") for p in POSITIONS])
    x = x.withColumnRenamed("recent_team", "team").select("*", *[F.greatest(F.lit(0), F.lit(k) - c(f"n_{p}")).alias(f"open_{p}") for p, k in SLOTS.items()])
    over = sum((F.greatest(F.lit(0), c(f"n_{p}") - SLOTS[p]) for p in FLEXIBLE), F.lit(0))
    have = sum((c(f"n_{p}") for p in POSITIONS), F.lit(0))
    return x.withColumn("open_FLEX", F.greatest(F.lit(0), F.lit(FLEX) - over)).withColumn("left", F.greatest(F.lit(0), F.lit(ROUNDS) - have))


def _each_position(spark: SparkSession, d: str) -> DataFrame:
    """Rosters by position: count, required, and what the ladders look at."""
    one = lambda p: F.struct(F.lit(p).alias("position"), c(f"n_{p}").alias("n"), F.lit(SLOTS[p]).alias("required"))
    return _rosters(spark, d).select("*", F.explode(F.array(*[one(p) for p in POSITIONS])).alias("p")).select("*", "p.*").drop("p")


def replacement_demand(spark: SparkSession, d: str) -> DataFrame:
    """Demand of every position of the data in leagues of 8 to 14 teams, with and without a slot for any position."""
    p = read(spark, d, "player_seasons").select(F.upper(F.trim("position")).alias("position")).where("position is not null").distinct()
    x = p.select("position", F.explode(F.array(*[F.lit(n) for n in (8, 10, 12, 14)])).alias("teams")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("superflex"))
    return x.select("position", "teams", "superflex", demand(c("position"), c("teams"), c("superflex")).alias("demand"))


def remaining_demand(spark: SparkSession, d: str) -> DataFrame:
    """Demand less what is taken (here: who played 14 games or more), never below nought."""
    x = _seasons(spark, d).where("position is not null").groupBy("season", "position").agg(F.count_if(c("games") >= 14).alias("taken"))
    return x.select("season", "position", "taken", F.greatest(F.lit(0), demand(c("position")) - c("taken")).cast("int").alias("remaining"))


def _listings(spark: SparkSession, d: str) -> DataFrame:
    """Usable listings: a known position, a mean above nought, floor and ceiling in order around it."""
    known = lambda x: F.when(~F.isnan(x), c(x))
    x = read(spark, d, "source_listings").select("listing_id", "source_id", F.upper(F.trim("position")).alias("position"), known("mean").alias("mean"), known("floor").alias("floor"), known("ceiling").alias("ceiling"), known("adp").alias("adp"))
    x = x.withColumn("position", F.when(c("position").isin("D/ST", "DEF", "DST"), "DST").when(c("position") == "PK", "K").otherwise(c("position")))
    x = x.where(c("position").isin(*POSITIONS) & (c("mean") > 0))
    return x.select("listing_id", "source_id", "position", "mean", F.least("mean", F.coalesce("floor", c("mean") * 0.7)).alias("floor"), F.greatest("mean", F.coalesce("ceiling", c("mean") * 1.3)).alias("ceiling"), F.when((c("adp") > 0) & (c("adp") < 500), c("adp")).alias("adp"))


def _over(spark: SparkSession, d: str) -> DataFrame:
    """Listings with mean, floor and ceiling over the replacement of their source and position: three order statistics."""
    x = _listings(spark, d)
    group = ["source_id", "position"]
    # demand from the top is an index from the bottom
    index = c("n") - 1 - F.least(demand(c("position")), c("n") - 1)
    for k in ("mean", "floor", "ceiling"):
        x = x.join(ranks.order_statistics(_listings(spark, d), group, k, {f"r_{k}": index}), group)
    return x.select("*", *[(c(k) - c(f"r_{k}")).alias(f"o_{k}") for k in ("mean", "floor", "ceiling")])


def over_replacement_range(spark: SparkSession, d: str) -> DataFrame:
    return _over(spark, d).select("listing_id", R("o_mean").alias("mean_over"), R("o_floor").alias("floor_over"), R("o_ceiling").alias("ceiling_over"))


def position_need(spark: SparkSession, d: str) -> DataFrame:
    """How much each roster needs each position: a ladder from an open starter down to depth."""
    n, q, p = c("n"), c("required"), c("position")
    ready = (c("n_RB") >= SLOTS["RB"] + 2) & (c("n_WR") >= SLOTS["WR"] + 2)
    # fixed values: the ladder's steps
    need = (
        F.when(n < q, 1.0)
        .when(p.isin(*FLEXIBLE) & (c("open_FLEX") > 0), F.when(p == "TE", 0.22).otherwise(0.72))
        .when(p == "QB", F.when(n == q, 0.22).otherwise(0.0))
        .when(p.isin("K", "DST"), 0.0)
        .when(p == "TE", F.when(n == q, F.when(ready, 0.48).otherwise(0.24)).otherwise(0.0))
        .otherwise(F.when(n < cap(p), 0.42).otherwise(0.12))
    )
    return _each_position(spark, d).select("team", "season", "position", need.alias("need"))


def overdraft_penalty(spark: SparkSession, d: str) -> DataFrame:
    """What one more of a position costs a roster that has enough of it."""
    n, q, p, flex = c("n"), c("required"), c("position"), c("open_FLEX") > 0
    rb, wr = c("n_RB") < SLOTS["RB"] + 1, c("n_WR") < SLOTS["WR"] + 1
    te = F.when(rb & wr, 0.34).when(rb | wr, 0.20).when(n >= q + F.when(flex, 1).otherwise(0), F.least(F.lit(0.55), 0.20 + (n - q) * 0.14)).otherwise(0.0)
    # fixed values: the penalties
    cost = (
        F.when((p == "QB") & (n >= q + 1), 1.25)
        .when((p == "QB") & (n >= q), F.when(flex, 0.78).otherwise(0.48))
        .when(p.isin("K", "DST") & (n >= q), 1.25)
        .when((p == "TE") & (n >= q), te)
        .when(p.isin("RB", "WR") & (n >= cap(p)), F.least(F.lit(0.5), 0.16 + (n - cap(p)) * 0.10))
        .otherwise(0.0)
    )
    return _each_position(spark, d).select("team", "season", "position", R(cost, 8).alias("penalty"))


def _completion(x: DataFrame) -> DataFrame:
    missing = sum((c(f"open_{p}") for p in (*POSITIONS, "FLEX")), F.lit(0))
    wanted = F.array_compact(F.array(*[F.when((c(f"open_{p}") > 0) | ((c("open_FLEX") > 0) if p in FLEXIBLE else F.lit(False)), p) for p in POSITIONS]))
    return x.withColumn("missing", missing).withColumn("wanted", wanted).withColumn("forced", (c("missing") > 0) & (c("left") > 0) & (c("missing") >= c("left")))


def completion_constraint(spark: SparkSession, d: str) -> DataFrame:
    """Whether a roster's remaining picks must all fill open slots, and with which positions."""
    return _completion(_rosters(spark, d)).select("team", "season", c("missing").cast("int").alias("missing"), c("left").cast("int").alias("left"), "forced", F.array_join("wanted", ",").alias("wanted"))


def position_cap_filter(spark: SparkSession, d: str) -> DataFrame:
    """Which positions a roster may still draft from: below its cap and, where completion is forced, wanted."""
    x = _completion(_each_position(spark, d))
    open_ = c("n") < cap(c("position"))
    return x.select("team", "season", "position", "n", cap(c("position")).alias("cap"), (open_ & (~c("forced") | F.array_contains("wanted", c("position")))).alias("open"))


def late_value_exception(spark: SparkSession, d: str) -> DataFrame:
    """Tight ends good enough to be taken beyond the cap: clear of the best back and receiver of their source."""
    x = _listings(spark, d)
    best = x.where(c("position").isin("RB", "WR")).groupBy("source_id").agg(F.max("mean").alias("m"), F.max("ceiling").alias("k"))
    te = x.where("position = 'TE'").join(best, "source_id")
    clear = (c("mean") >= c("m") + F.greatest(F.lit(3.0), c("m") * 0.03)) | (c("ceiling") >= c("k") + F.greatest(F.lit(5.0), c("k") * 0.03))
    return te.select("listing_id", clear.alias("clear"))


def _alive(pick: Column, adp: Column) -> Column:
    return S.clamp(1 - S.normal_cdf_erf((pick - 0.5 - adp) / S.interpolate(adp, CURVE)))


def availability(position: Column, adp: Column, target: Column, current: Column) -> Column:
    """The chance to be left at ``target``, given at ``current``: certain for a pick not later, even for tight ends, half
    where no market is known."""
    now, later = _alive(current, adp), _alive(target, adp)
    return F.when(target <= current, 1.0).when(position == "TE", 1.0).when(adp.isNull(), 0.5).when(now < 1e-9, 0.0).otherwise(S.clamp(F.try_divide(later, now)))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("target"), F.lit(float(b)).alias("current")) for a, b in ((60, 40), (37, 36), (30, 40))])
    return _listings(spark, d).select("*", F.explode(pairs).alias("t")).select("*", "t.*")


def availability_rules(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("listing_id", "target", "current", R(availability(c("position"), c("adp"), c("target"), c("current"))).alias("chance"))


def availability_after_selection(spark: SparkSession, d: str) -> DataFrame:
    """As above after one's own pick at ``current``: that pick takes nobody else, so the window starts behind it."""
    return _turns(spark, d).select("listing_id", "target", "current", R(availability(c("position"), c("adp"), c("target"), c("current") + 1)).alias("chance"))


def market_spread(spark: SparkSession, d: str) -> DataFrame:
    """The spread of a player's market position: the sources' own where three or more agree on who it is, bounded by the
    curve's, else the curve's. Tight ends and players without a market have none."""
    adp = F.when((c("adp") > 0) & (c("adp") < 500), c("adp"))
    x = read(spark, d, "source_listings").where("name is not null").select(S.ascii_key(c("name")).alias("nk"), F.upper(F.trim("position")).alias("position"), "source_id", adp.alias("adp")).where("nk <> '' and position <> 'TE' and adp is not null")
    g = x.groupBy("nk", "position").agg(F.avg("adp").alias("center"), F.stddev_samp("adp").alias("seen"), F.countDistinct("source_id").alias("sources"))
    prior = S.interpolate(c("center"), CURVE)
    own = F.least(F.greatest(c("seen"), F.lit(0.5)), F.greatest(F.lit(2.0), prior * 2.5))
    return g.select("nk", "position", "sources", R("center").alias("center"), R(F.when((c("sources") >= 3) & (c("seen") > 0), own).otherwise(prior)).alias("spread"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The board of each source from one roster's view (a quarterback, a back and two receivers taken, pick 40, next 60)."""
    x = ranks.placed(_over(spark, d), ["source_id", "position"], [c("mean").desc(), c("listing_id")], "rank")
    x = x.withColumn("risk", S.clamp((c("ceiling") - c("floor")) / (2 * c("mean")), 0.05, 0.95)).withColumn("scarcity", 1.0 / c("rank"))
    x = x.withColumn("lineup", F.greatest(F.lit(0.0), c("o_mean")))
    ends = x.groupBy("source_id").agg(*[f(k).alias(f"{s}_{k}") for k in ("o_mean", "o_floor", "o_ceiling", "risk", "scarcity", "lineup") for s, f in (("a", F.min), ("b", F.max))])
    x = x.join(F.broadcast(ends), "source_id")
    scale = lambda k: F.when(c(f"b_{k}") == c(f"a_{k}"), 0.5).otherwise(S.clamp((c(k) - c(f"a_{k}")) / (c(f"b_{k}") - c(f"a_{k}"))))
    need = _of({"QB": 0.22, "RB": 1.0, "WR": 0.72, "TE": 1.0, "K": 1.0, "DST": 1.0}, c("position"), 0.0)
    factors = {"projection": scale("o_mean"), "ceiling": scale("o_ceiling"), "floor": scale("o_floor"), "scarcity": scale("scarcity"), "need": need, "availability": 1 - availability(c("position"), c("adp"), F.lit(60.0), F.lit(40.0)), "risk": scale("risk")}
    x = x.select("*", *[v.alias(f"f_{k}") for k, v in factors.items()], scale("lineup").alias("f_lineup"))
    free = F.when(c("position").isin("RB", "WR"), 12).otherwise(3)
    tier = F.least(F.lit(0.32), F.greatest(F.lit(0), c("rank") - free) * 0.045)
    double = F.when(c("position") == "QB", 0.78).otherwise(0.0)
    adjust = 0.18 * c("f_lineup") - tier - double
    return x.withColumn("score", sum((c(f"f_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0)) + adjust)


def recommendation_score(spark: SparkSession, d: str) -> DataFrame:
    """The weighted score of every candidate with its adjustments, and its three strongest drivers."""
    impact = F.array(*[F.struct((-F.abs(F.round(c(f"f_{k}") * w, 9))).alias("o"), F.lit(k).alias("k")) for k, w in WEIGHTS.items()])
    drivers = F.array_join(F.transform(F.slice(F.array_sort(impact), 1, 3), lambda x: x["k"]), ",")
    return _scored(spark, d).select("listing_id", R("score", 7).alias("score"), drivers.alias("drivers"))


def _top(spark: SparkSession, d: str, n: int = 24) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(c("score").desc(), "listing_id")
    return _scored(spark, d).withColumn("place", F.row_number().over(w)).where(c("place") <= n)


def dominates(a: str, b: str) -> Column:
    """Whether candidate ``a`` beats ``b`` on every count that matters: the same role, no less needed, and either a better
    range throughout or a materially better projection at little cost elsewhere."""
    x, y = (lambda k: c(f"{a}.{k}")), (lambda k: c(f"{b}.{k}"))
    same = x("position") == y("position")
    flexible = x("position").isin(*FLEXIBLE) & y("position").isin(*FLEXIBLE)
    step = lambda k, share: F.greatest(F.lit(3.0), F.abs(y(k)) * share)
    higher = {k: x(k) - y(k) >= step(k, 0.05) for k in ("mean", "floor")}
    close = {k: x(k) >= y(k) - step(k, 0.08) for k in ("floor", "ceiling")}
    ranges = ("mean", "floor", "ceiling")
    no_worse = x("mean") >= y("mean") - 0.01
    better = x("mean") > y("mean") + 0.5
    for k in ranges[1:]:
        no_worse, better = no_worse & (x(k) >= y(k) - 0.01), better | (x(k) > y(k) + 0.5)
    need = x("f_need") - y("f_need")
    depth = flexible & (((need >= 0.10) & ((no_worse & better) | (higher["mean"] & higher["floor"] & close["ceiling"]))) | ((need >= 0) & higher["mean"] & higher["floor"] & (x("ceiling") >= y("ceiling") - 0.01)))
    starter = flexible & (x("f_need") >= 0.9) & (y("f_need") < 0.9) & (x("mean") >= y("mean") - step("mean", 0.05)) & close["floor"] & close["ceiling"]
    return (same | flexible) & (need >= 0) & (starter | depth | (same & higher["mean"] & close["floor"] & close["ceiling"]) | (no_worse & better & (same | higher["mean"])))


def dominance_rules(spark: SparkSession, d: str) -> DataFrame:
    """Pairs (winner, loser) among the best 24 of each source: at most 552 a source."""
    t = _top(spark, d)
    return t.alias("a").join(t.alias("b"), (c("a.source_id") == c("b.source_id")) & (c("a.listing_id") != c("b.listing_id"))).where(dominates("a", "b")).select(c("a.listing_id").alias("winner"), c("b.listing_id").alias("loser"))


def swap_opportunities(spark: SparkSession, d: str) -> DataFrame:
    """For every starter below the best: how many players of the position were better, and the next better one.

    Counted by rank within season and position, not by pairs.
    """
    x = _seasons(spark, d).where(c("position").isNotNull() & c("fantasy_points_ppr").isNotNull() & ~F.isnan("fantasy_points_ppr")).select("player_id", "season", "position", "fantasy_points_ppr")
    x = ranks.placed(x, ["season", "position"], [c("fantasy_points_ppr").desc(), c("player_id")], "rank")
    before = x.select("season", "position", (c("rank") + 1).alias("rank"), c("player_id").alias("next_better"), c("fantasy_points_ppr").alias("more"))
    return x.join(before, ["season", "position", "rank"]).select("player_id", "season", (c("rank") - 1).alias("better"), "next_better", R(c("more") - c("fantasy_points_ppr")).alias("gain"))


def specialists_retained(spark: SparkSession, d: str) -> DataFrame:
    """Listings kept on the board: all of the core positions, of kickers and defences only the best teams x 2."""
    w = Window.partitionBy("source_id", "position").orderBy(c("mean").desc(), "listing_id")
    x = _listings(spark, d)
    few = x.where(c("position").isin("K", "DST")).withColumn("r", F.row_number().over(w)).where(c("r") <= TEAMS * 2).select("listing_id")
    return x.where(~c("position").isin("K", "DST")).select("listing_id").unionByName(few)


_LIST = f"""n0 AS (SELECT listing_id, source_id, upper(trim(position)) AS p0, CASE WHEN NOT isnan(mean) THEN mean END AS mean, CASE WHEN NOT isnan(floor) THEN floor END AS f0, CASE WHEN NOT isnan(ceiling) THEN ceiling END AS c0, CASE WHEN NOT isnan(adp) THEN adp END AS a0 FROM source_listings),
 n1 AS (SELECT *, CASE WHEN p0 IN ('D/ST','DEF','DST') THEN 'DST' WHEN p0 = 'PK' THEN 'K' ELSE p0 END AS position FROM n0),
 li AS (SELECT listing_id, source_id, position, mean, least(mean, coalesce(f0, mean * 0.7::DOUBLE)) AS floor, greatest(mean, coalesce(c0, mean * 1.3::DOUBLE)) AS ceiling, CASE WHEN a0 > 0 AND a0 < 500 THEN a0 END AS adp FROM n1 WHERE position IN {POSITIONS} AND mean > 0)"""


def _case(table: dict, col: str, default: object = 0) -> str:
    return f"(CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in table.items()) + f" ELSE {default} END)"


def _demand_sql(col: str = "position", teams: str = str(TEAMS), superflex: str = "0") -> str:
    return f"CAST(greatest(1, floor({teams} * ({_case(SLOTS, col)} + {FLEX} * {_case(FLEX_SHARE, col)} + {superflex} * {_case(SUPER_SHARE, col)}) + 0.5::DOUBLE)) AS INTEGER)"


_CAP = f"CAST(CASE WHEN position IN ('QB','TE') THEN required + 1 WHEN position IN ('RB','WR') THEN required + {FLEX} + 3 ELSE required END AS INTEGER)"
_ROST = f"""{_SEASONS}, r0 AS (SELECT recent_team AS team, season, {', '.join(f"CAST(count(*) FILTER (position = '{p}') AS INTEGER) AS n_{p}" for p in POSITIONS)} FROM s WHERE recent_team IS NOT NULL GROUP BY 1, 2),
 r1 AS (SELECT *, {', '.join(f'greatest(0, {k} - n_{p}) AS open_{p}' for p, k in SLOTS.items())}, greatest(0, {FLEX} - ({' + '.join(f'greatest(0, n_{p} - {SLOTS[p]})' for p in FLEXIBLE)})) AS open_FLEX, greatest(0, {ROUNDS} - ({' + '.join(f'n_{p}' for p in POSITIONS)})) AS "left" FROM r0),
 r2 AS (SELECT *, {' + '.join(f'open_{p}' for p in (*POSITIONS, 'FLEX'))} AS missing, list_filter([{', '.join(f"CASE WHEN open_{p} > 0{' OR open_FLEX > 0' if p in FLEXIBLE else ''} THEN '{p}' END" for p in POSITIONS)}], lambda x: x IS NOT NULL) AS wanted FROM r1),
 r3 AS (SELECT *, missing > 0 AND "left" > 0 AND missing >= "left" AS forced FROM r2),
 e AS ({' UNION ALL '.join(f"SELECT *, '{p}' AS position, n_{p} AS n, {SLOTS[p]} AS required FROM r3" for p in POSITIONS)})"""
_OVER = f"""{_LIST}, k0 AS (SELECT *, {_demand_sql()} AS dem, count(*) OVER (PARTITION BY source_id, position) AS n, {', '.join(f'row_number() OVER (PARTITION BY source_id, position ORDER BY {k} DESC, listing_id) - 1 AS at_{k}' for k in ('mean', 'floor', 'ceiling'))} FROM li),
 k1 AS (SELECT source_id, position, {', '.join(f'max({k}) FILTER (at_{k} = least(dem, n - 1)) AS r_{k}' for k in ('mean', 'floor', 'ceiling'))} FROM k0 GROUP BY 1, 2),
 ov AS (SELECT k0.*, {', '.join(f'k0.{k} - r_{k} AS o_{k}' for k in ('mean', 'floor', 'ceiling'))} FROM k0 JOIN k1 USING (source_id, position))"""


def _sd(x: str) -> str:
    return f"CAST(CASE WHEN {x} <= {CURVE[0][0]} THEN {CURVE[0][1]} " + " ".join(f"WHEN {x} <= {b} THEN {va}::DOUBLE + ({vb}::DOUBLE - {va}::DOUBLE) * ({x} - {a}) / ({b}::DOUBLE - {a}::DOUBLE)" for (a, va), (b, vb) in zip(CURVE, CURVE[1:])) + f" ELSE {CURVE[-1][1]} END AS DOUBLE)"


def _erf(z: str) -> str:
    t = f"(1 / (1 + abs({z}) / sqrt(2.0::DOUBLE) * 0.3275911::DOUBLE))"
    return f"(0.5::DOUBLE * (1 + CASE WHEN {z} < 0 THEN -1 ELSE 1 END * (1 - (((({t} * 1.061405429::DOUBLE - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t} * exp(-1 * pow(abs({z}) / sqrt(2.0::DOUBLE), 2)))))"


def _alive_sql(pick: str) -> str:
    return f"least(greatest(1 - {_erf(f'(({pick} - 0.5::DOUBLE - adp) / ' + _sd('adp') + ')')}, 0), 1)"


def _chance(target: str, current: str) -> str:
    return f"(CASE WHEN {target} <= {current} THEN 1 WHEN position = 'TE' THEN 1 WHEN adp IS NULL THEN 0.5 WHEN {_alive_sql(current)} < 1e-9::DOUBLE THEN 0 ELSE least(greatest({_alive_sql(target)} / {_alive_sql(current)}, 0), 1) END)::DOUBLE"


_TURNS = f"{_LIST}, tu AS (SELECT li.*, target, current FROM li, (VALUES (60.0::DOUBLE, 40.0::DOUBLE), (37.0::DOUBLE, 36.0::DOUBLE), (30.0::DOUBLE, 40.0::DOUBLE)) v(target, current))"
_KS = ("o_mean", "o_floor", "o_ceiling", "risk", "scarcity", "lineup")


def _scale_sql(k: str) -> str:
    return f"(CASE WHEN max({k}) OVER (PARTITION BY source_id) = min({k}) OVER (PARTITION BY source_id) THEN 0.5::DOUBLE ELSE least(greatest(({k} - min({k}) OVER (PARTITION BY source_id)) / (max({k}) OVER (PARTITION BY source_id) - min({k}) OVER (PARTITION BY source_id)), 0), 1) END)"


_SCORE = f"""{_OVER}, b0 AS (SELECT *, at_mean + 1 AS rank, least(greatest((ceiling - floor) / (2 * mean), 0.05::DOUBLE), 0.95::DOUBLE) AS risk, 1.0::DOUBLE / (at_mean + 1) AS scarcity, greatest(0, o_mean) AS lineup FROM ov),
 b1 AS (SELECT *, {_scale_sql('o_mean')} AS f_projection, {_scale_sql('o_ceiling')} AS f_ceiling, {_scale_sql('o_floor')} AS f_floor, {_scale_sql('scarcity')} AS f_scarcity, {_case({'QB': 0.22, 'RB': 1.0, 'WR': 0.72, 'TE': 1.0, 'K': 1.0, 'DST': 1.0}, 'position')} AS f_need, 1 - {_chance('60.0::DOUBLE', '40.0::DOUBLE')} AS f_availability, {_scale_sql('risk')} AS f_risk, {_scale_sql('lineup')} AS f_lineup FROM b0),
 b2 AS (SELECT *, {' + '.join(f'f_{k} * {w!r}::DOUBLE' for k, w in WEIGHTS.items())} + 0.18::DOUBLE * f_lineup - least(0.32::DOUBLE, greatest(0, rank - CASE WHEN position IN ('RB','WR') THEN 12 ELSE 3 END) * 0.045::DOUBLE) - CASE WHEN position = 'QB' THEN 0.78::DOUBLE ELSE 0 END AS score FROM b1)"""


def _step_sql(k: str, share: float) -> str:
    return f"greatest(3, abs(b.{k}) * {share}::DOUBLE)"


_HIGH = {k: f"a.{k} - b.{k} >= {_step_sql(k, 0.05)}" for k in ("mean", "floor")}
_CLOSE = {k: f"a.{k} >= b.{k} - {_step_sql(k, 0.08)}" for k in ("floor", "ceiling")}
_NOWORSE = " AND ".join(f"a.{k} >= b.{k} - 0.01::DOUBLE" for k in ("mean", "floor", "ceiling"))
_BETTER = "(" + " OR ".join(f"a.{k} > b.{k} + 0.5::DOUBLE" for k in ("mean", "floor", "ceiling")) + ")"
_FLEXIBLE = f"(a.position IN {FLEXIBLE} AND b.position IN {FLEXIBLE})"
_NEED = "(a.f_need - b.f_need)"
_DOM = f"""(a.position = b.position OR {_FLEXIBLE}) AND {_NEED} >= 0 AND (
 ({_FLEXIBLE} AND a.f_need >= 0.9::DOUBLE AND b.f_need < 0.9::DOUBLE AND a.mean >= b.mean - {_step_sql('mean', 0.05)} AND {_CLOSE['floor']} AND {_CLOSE['ceiling']})
 OR ({_FLEXIBLE} AND (({_NEED} >= 0.10::DOUBLE AND (({_NOWORSE} AND {_BETTER}) OR ({_HIGH['mean']} AND {_HIGH['floor']} AND {_CLOSE['ceiling']}))) OR ({_HIGH['mean']} AND {_HIGH['floor']} AND a.ceiling >= b.ceiling - 0.01::DOUBLE)))
 OR (a.position = b.position AND {_HIGH['mean']} AND {_CLOSE['floor']} AND {_CLOSE['ceiling']})
 OR ({_NOWORSE} AND {_BETTER} AND (a.position = b.position OR {_HIGH['mean']})))"""

QUERIES = {f.__name__: f for f in (replacement_demand, remaining_demand, over_replacement_range, position_need, overdraft_penalty, completion_constraint, position_cap_filter, late_value_exception, availability_rules, availability_after_selection, market_spread, recommendation_score, dominance_rules, swap_opportunities, specialists_retained)}
ORACLE = {
    "replacement_demand": f"SELECT DISTINCT upper(trim(position)) AS position, CAST(t.teams AS INTEGER) AS teams, CAST(f.sf AS INTEGER) AS superflex, {_demand_sql('upper(trim(position))', 't.teams', 'f.sf')} AS demand FROM player_seasons, (VALUES (8),(10),(12),(14)) t(teams), (VALUES (0),(1)) f(sf) WHERE position IS NOT NULL",
    "remaining_demand": f"WITH {_SEASONS}, g AS (SELECT season, position, count(*) FILTER (games >= 14) AS taken FROM s WHERE position IS NOT NULL GROUP BY 1, 2) SELECT season, position, taken, CAST(greatest(0, {_demand_sql()} - taken) AS INTEGER) AS remaining FROM g",
    "over_replacement_range": f"WITH {_OVER} SELECT listing_id, round(o_mean, 6) AS mean_over, round(o_floor, 6) AS floor_over, round(o_ceiling, 6) AS ceiling_over FROM ov",
    "position_need": f"""WITH {_ROST} SELECT team, season, position, CAST(CASE WHEN n < required THEN 1.0 WHEN position IN {FLEXIBLE} AND open_FLEX > 0 THEN CASE WHEN position = 'TE' THEN 0.22 ELSE 0.72 END WHEN position = 'QB' THEN CASE WHEN n = required THEN 0.22 ELSE 0 END
      WHEN position IN ('K','DST') THEN 0 WHEN position = 'TE' THEN CASE WHEN n = required THEN CASE WHEN n_RB >= 4 AND n_WR >= 4 THEN 0.48 ELSE 0.24 END ELSE 0 END WHEN n < {_CAP} THEN 0.42 ELSE 0.12 END AS DOUBLE) AS need FROM e""",
    "overdraft_penalty": f"""WITH {_ROST} SELECT team, season, position, round(CAST(CASE WHEN position = 'QB' AND n >= required + 1 THEN 1.25 WHEN position = 'QB' AND n >= required THEN CASE WHEN open_FLEX > 0 THEN 0.78 ELSE 0.48 END WHEN position IN ('K','DST') AND n >= required THEN 1.25
      WHEN position = 'TE' AND n >= required THEN CASE WHEN n_RB < 3 AND n_WR < 3 THEN 0.34 WHEN n_RB < 3 OR n_WR < 3 THEN 0.20 WHEN n >= required + CASE WHEN open_FLEX > 0 THEN 1 ELSE 0 END THEN least(0.55, 0.20 + (n - required) * 0.14) ELSE 0 END
      WHEN position IN ('RB','WR') AND n >= {_CAP} THEN least(0.5, 0.16 + (n - {_CAP}) * 0.10) ELSE 0 END AS DOUBLE), 8) AS penalty FROM e""",
    "completion_constraint": f"""WITH {_ROST} SELECT team, season, CAST(missing AS INTEGER) AS missing, CAST("left" AS INTEGER) AS "left", forced, array_to_string(wanted, ',') AS wanted FROM r3""",
    "position_cap_filter": f"WITH {_ROST} SELECT team, season, position, n, {_CAP} AS cap, n < {_CAP} AND (NOT forced OR list_contains(wanted, position)) AS open FROM e",
    "late_value_exception": f"WITH {_LIST}, b AS (SELECT source_id, max(mean) AS m, max(ceiling) AS k FROM li WHERE position IN ('RB','WR') GROUP BY 1) SELECT listing_id, mean >= m + greatest(3, m * 0.03::DOUBLE) OR ceiling >= k + greatest(5, k * 0.03::DOUBLE) AS clear FROM li JOIN b ON li.source_id = b.source_id WHERE position = 'TE'",
    "availability_rules": f"WITH {_TURNS} SELECT listing_id, target, current, round({_chance('target', 'current')}, 6) AS chance FROM tu",
    "availability_after_selection": f"WITH {_TURNS} SELECT listing_id, target, current, round({_chance('target', '(current + 1)')}, 6) AS chance FROM tu",
    "market_spread": f"""WITH x AS (SELECT regexp_replace(regexp_replace(lower(strip_accents(name)), '\\s+(jr|sr|ii|iii|iv|v)\\.?$', ''), '[^a-z0-9]', '', 'g') AS nk, upper(trim(position)) AS position, source_id, CASE WHEN adp > 0 AND adp < 500 THEN adp END AS adp FROM source_listings WHERE name IS NOT NULL),
      g AS (SELECT nk, position, avg(adp) AS center, stddev_samp(adp) AS seen, count(DISTINCT source_id) AS sources FROM x WHERE nk <> '' AND position <> 'TE' AND adp IS NOT NULL GROUP BY 1, 2)
      SELECT nk, position, sources, round(center, 6) AS center, round(CASE WHEN sources >= 3 AND seen > 0 THEN least(greatest(seen, 0.5::DOUBLE), greatest(2.0::DOUBLE, {_sd('center')} * 2.5::DOUBLE)) ELSE {_sd('center')} END, 6) AS spread FROM g""",
    "recommendation_score": f"""WITH {_SCORE}, i AS (SELECT *, list_sort([{', '.join(f"{{'o': -abs(round(f_{k} * {w!r}::DOUBLE, 9)), 'k': '{k}'}}" for k, w in WEIGHTS.items())}]) AS i FROM b2) SELECT listing_id, round(score, 7) AS score, concat(i[1].k, ',', i[2].k, ',', i[3].k) AS drivers FROM i""",
    "dominance_rules": f"WITH {_SCORE}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, listing_id) AS place FROM b2) WHERE place <= 24) SELECT a.listing_id AS winner, b.listing_id AS loser FROM t a JOIN t b ON a.source_id = b.source_id AND a.listing_id <> b.listing_id WHERE {_DOM}",
    "swap_opportunities": f"""WITH {_SEASONS}, x AS (SELECT player_id, season, fantasy_points_ppr AS v, row_number() OVER w AS rank, lag(player_id) OVER w AS next_better, lag(fantasy_points_ppr) OVER w - fantasy_points_ppr AS gain FROM s WHERE position IS NOT NULL AND fantasy_points_ppr IS NOT NULL AND NOT isnan(fantasy_points_ppr)
      WINDOW w AS (PARTITION BY season, position ORDER BY fantasy_points_ppr DESC, player_id)) SELECT player_id, season, CAST(rank - 1 AS INTEGER) AS better, next_better, round(gain, 6) AS gain FROM x WHERE rank > 1""",
    "specialists_retained": f"WITH {_LIST}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, position ORDER BY mean DESC, listing_id) AS r FROM li) SELECT listing_id FROM r WHERE position NOT IN ('K','DST') OR r <= {TEAMS * 2}",
}
