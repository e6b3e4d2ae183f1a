"""Title odds of the candidates of a board by paired scenarios, and how far the evidence ranks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import decision as D
from draftloom.operators import season
from draftloom.plans.board import CURVE, _scored, availability
from draftloom.session import stage

c = F.col
R = lambda x, n=6: F.round(x, n)
SCENARIOS, CANDIDATES, SEED = 10_000, 5, 20260801
# fixed values: strength of the prior at one over the number of teams, and the z of a sequence of looks
PRIOR, Z = 15_000.0, 2.75
TASKS = 40
# twice as many as are drafted: who stands later on the board is not drafted in any scenario
POOL = 2 * 12 * 16


def _board(spark: SparkSession, d: str) -> DataFrame:
    """The board of the source with most usable listings."""
    board = stage(_scored(spark, d), "odds-board")
    largest = board.groupBy("source_id").count().orderBy(c("count").desc(), "source_id").limit(1).select("source_id")
    return board.join(F.broadcast(largest), "source_id")


def _runs(spark: SparkSession, d: str, weekly: bool = False, scenarios: int = SCENARIOS) -> DataFrame:
    """The best five of the board, each drafted in the same scenarios."""
    one = _board(spark, d)
    # listings without a market stand behind all that have one
    center = F.coalesce("adp", F.lit(400.0))
    all_ = one.select(c("listing_id").cast("string").alias("key"), "position", "mean", "floor", "ceiling", center.alias("center"), S.interpolate(center, CURVE).alias("spread"), "score")
    top = all_.orderBy(c("score").desc(), "key").limit(CANDIDATES)
    pool = all_.orderBy("center", "key").limit(POOL).unionByName(top).dropDuplicates(["key"]).toPandas()
    best = [r[0] for r in top.select("key").collect()]
    worlds = spark.range(0, scenarios, 1, TASKS).withColumnRenamed("id", "scenario")
    return season.title_runs(pool, best, worlds, season.League(), SEED, weekly)


def _pairs(runs: DataFrame) -> DataFrame:
    """Every two candidates over the scenarios they share: mean difference and its error."""
    a, b = runs.select("scenario", c("candidate").alias("a"), c("won").alias("wa")), runs.select("scenario", c("candidate").alias("b"), c("won").alias("wb"))
    x = a.join(b, "scenario").where("a <> b").withColumn("diff", c("wa") - c("wb"))
    return x.groupBy("a", "b").agg(F.avg("diff").alias("mean"), (F.stddev_samp("diff") / F.sqrt(F.count(F.lit(1)))).alias("error"), F.count(F.lit(1)).alias("n"))


def title_odds(spark: SparkSession, d: str) -> DataFrame:
    """Wins, raw and calibrated probability with its interval, and regular-season wins of each candidate."""
    runs = _runs(spark, d)
    t = runs.groupBy("candidate").agg(F.count(F.lit(1)).alias("scenarios"), F.sum("won").alias("titles"), F.avg("wins").alias("wins"))
    p = (c("titles") + PRIOR / season.League().teams) / (c("scenarios") + PRIOR)
    error = F.sqrt(F.greatest(F.lit(1e-6), p * (1 - p) / c("scenarios")))
    return t.select("candidate", "scenarios", "titles", R("wins", 4).alias("wins"), R(c("titles") / c("scenarios")).alias("raw"), R(p).alias("probability"), R(S.clamp(p - 1.96 * error)).alias("low"), R(S.clamp(p + 1.96 * error)).alias("high"))


def evidence_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by title odds, in groups the evidence cannot tell apart: a group ends where its leader is ahead of the
    next candidate by more than Z errors of their paired difference. ``eliminated``: the best one is ahead by that much;
    ``unresolved``: neither ahead nor behind."""
    runs = stage(_runs(spark, d), "odds-runs")
    odds = runs.groupBy("candidate").agg(F.avg("won").alias("raw"))
    place = F.row_number().over(Window.orderBy(c("raw").desc(), "candidate"))  # as many rows as candidates
    order = odds.withColumn("place", place)
    pairs = _pairs(runs).withColumn("ahead", c("mean") > Z * F.greatest(c("error"), F.lit(1e-12)))
    lead = order.where("place = 1").select(c("candidate").alias("a"))
    against = pairs.join(lead, "a").select(c("b").alias("candidate"), c("mean").alias("behind"), c("error"), c("ahead").alias("eliminated"))
    rows = order.join(against, "candidate", "left")

    def groups(g):  # noqa: ANN001, ANN202 - one small board
        g = g.sort_values("place")
        group, leader = 0, None
        for i, name in zip(g.index, g["candidate"]):
            if leader is None or bool(ahead.get((leader, name), False)):
                group, leader = group + 1, name
            g.loc[i, "tier"] = group
        return g[["candidate", "place", "raw", "behind", "error", "eliminated", "tier"]].astype({"tier": int})

    ahead = {(r["a"], r["b"]): r["ahead"] for r in pairs.select("a", "b", "ahead").limit(CANDIDATES * CANDIDATES).collect()}
    out = rows.withColumn("tier", F.lit(0)).groupBy().applyInPandas(groups, "candidate string, place int, raw double, behind double, error double, eliminated boolean, tier int")
    return out.select("candidate", "place", "tier", R("raw").alias("raw"), R("behind").alias("behind"), R("error", 8).alias("error"), F.coalesce("eliminated", F.lit(False)).alias("eliminated"), (~F.coalesce("eliminated", F.lit(False)) & (c("place") > 1)).alias("unresolved"))


def ranking_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Whether the leader may be shown as such at each stage of the evidence, with the wider z of an early look."""
    runs = stage(_runs(spark, d), "odds-runs")
    looks = F.broadcast(spark.createDataFrame([(n,) for n in (1000, 2500, 5000, 10_000)], "look int"))
    seen = runs.crossJoin(looks).where("scenario < look")
    odds = seen.groupBy("look", "candidate").agg(F.avg("won").alias("raw"))
    lead = odds.groupBy("look").agg(F.min_by("candidate", F.struct((-c("raw")).alias("o"), "candidate")).alias("leader"))
    mine = seen.select("look", "scenario", c("candidate").alias("leader"), c("won").alias("w")).join(lead, ["look", "leader"])
    x = mine.join(seen, ["look", "scenario"]).where("candidate <> leader").withColumn("diff", c("w") - c("won"))
    z = Z / F.sqrt(c("look") / float(SCENARIOS))
    g = x.groupBy("look", "leader", "candidate").agg(F.avg("diff").alias("mean"), (F.stddev_samp("diff") / F.sqrt(F.count(F.lit(1)))).alias("error"))
    g = g.withColumn("out", c("mean") > z * F.greatest(c("error"), F.lit(1e-12)))
    return g.groupBy("look", "leader").agg(F.count_if("out").alias("eliminated"), F.count_if(~c("out")).alias("unresolved"), F.every("out").alias("ready"))


def weekly_title_odds(spark: SparkSession, d: str) -> DataFrame:
    """Title odds with line-ups set week by week from the players active that week, in 2,000 scenarios (the reference's
    weekly model is not its default either)."""
    runs = _runs(spark, d, True, 2000)
    return runs.groupBy("candidate").agg(F.count(F.lit(1)).alias("scenarios"), F.sum("won").alias("titles"), R(F.avg("wins"), 4).alias("wins"))


def draft_rollout(spark: SparkSession, d: str) -> DataFrame:
    """Beam search over the next two own picks for the best 18 of the board: mean roster value and the usual path."""
    league = season.League()
    one = _board(spark, d).select(c("listing_id").cast("string").alias("key"), "position", c("o_mean").alias("value"), "adp", "score")
    top = one.orderBy(c("score").desc(), "key").limit(18)
    now, after = 40, [57, 64]
    chance = [availability(c("position"), c("adp"), F.lit(float(p)), F.lit(float(now + 1))).alias(f"s{i}") for i, p in enumerate(after)]
    # the ten best of each position that are not on the list of candidates anyway
    few = D.top_k(one.where(c("position").isin("QB", "RB", "WR", "TE")), ["position"], [c("value").desc(), c("key")], 10).select(*one.columns)
    pool = few.unionByName(top).dropDuplicates(["key"]).select("key", "position", "value", *chance).toPandas()
    out = season.rollouts(pool, [], top.select(c("key").alias("candidate")).repartition(6), after, league, seed=SEED)
    return out.select("candidate", R("score").alias("score"), "step", "pick_no", "key", R("share").alias("share"))


QUERIES = {f.__name__: f for f in (title_odds, weekly_title_odds, draft_rollout, evidence_ranking, ranking_readiness)}
ORACLE: dict[str, str] = {}
