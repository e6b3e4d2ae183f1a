"""Gates and audits: is a candidate model better than its baseline, in every slice, within its error, and safely so?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.operators import decision as D
from draftloom.operators import ranks
from draftloom.plans.temporal import _SEASONS, _seasons
from draftloom.session import read, stage

c = F.col
R = lambda x, n=6: F.round(x, n)
# fixed values: least rows of a slice by how many keys it has
LEAST = {0: 50, 1: 25, 2: 10}
Z = 1.96


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Weeks with a projection and an outcome, and as baseline the mean outcome of the position in earlier seasons."""
    x = read(spark, d, "player_weeks").where("player_id <> '00-0000000' and position is not null and season is not null and projected is not null and not isnan(projected) and fantasy_points is not null and not isnan(fantasy_points) and abs(fantasy_points) < 100")
    x = x.select("week_row_id", "player_id", "season", "week", F.upper(F.trim("position")).alias("position"), "projected", c("fantasy_points").alias("actual"))
    s = x.groupBy("position", "season").agg(F.sum("actual").alias("s"), F.count(F.lit(1)).alias("n"))
    # as many rows as positions and seasons
    w = Window.partitionBy("position").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    base = s.select("position", "season", (F.sum("s").over(w) / F.sum("n").over(w)).alias("baseline")).where("baseline is not null")
    return x.join(base, ["position", "season"])


def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Candidate against baseline over all, by season, by position and by both: errors, their difference with an interval
    that takes a player's rows as one cluster, and whether the slice passes. Slices of too few rows are left out."""
    x = _evidence(spark, d).withColumn("a", F.abs(c("projected") - c("actual"))).withColumn("b", F.abs(c("baseline") - c("actual")))
    keys = ["season", "position"]
    per = x.groupBy(*keys, "player_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    sets = [[], ["season"], ["position"], keys]
    # clusters first by player within the slice, then over the slice: sums of squares and products are all it needs
    out = None
    for s in sets:
        k = per.groupBy(*s, "player_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n")).withColumn("e", c("a") - c("b"))
        g = k.groupBy(*s).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("players"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(c("e") * c("e")).alias("ee"), F.sum(c("e") * c("n")).alias("en"), F.sum(c("n") * c("n")).alias("nn")).where(c("rows") >= LEAST[len(s)])
        delta = (c("sa") - c("sb")) / c("rows")
        error = F.sqrt(F.greatest(F.lit(0.0), c("ee") - 2 * delta * c("en") + delta * delta * c("nn"))) / c("rows")
        row = g.select(*[(c(x) if x in s else F.lit(None).cast("string" if x == "position" else "int")).alias(x) for x in keys], "rows", "players", (c("sa") / c("rows")).alias("mae"), (c("sb") / c("rows")).alias("baseline_mae"), delta.alias("delta"), error.alias("error"))
        out = row if out is None else out.unionByName(row)
    return out.select(*keys, "rows", "players", R("mae").alias("mae"), R("baseline_mae").alias("baseline_mae"), R("delta").alias("delta"), R(c("delta") - Z * c("error")).alias("low"), R(c("delta") + Z * c("error")).alias("high"), (c("delta") + Z * c("error") < 0).alias("passes"))


def gate_errors(spark: SparkSession, d: str) -> DataFrame:
    """What forbids a promotion outright: rows met twice, and features that were known only after the cutoff."""
    x = read(spark, d, "player_examples")
    twice = x.groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("n")).groupBy("season").agg(F.sum(F.when(c("n") > 1, c("n") - 1).otherwise(0)).alias("duplicates"))
    leak = x.groupBy("season").agg(F.count_if(c("feature_cutoff_season") >= c("season")).alias("leaks"), F.count(F.lit(1)).alias("rows"))
    return leak.join(twice, "season").select("season", "rows", "duplicates", "leaks", ((c("duplicates") == 0) & (c("leaks") == 0)).alias("clean"))


def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Per position and season: the mean difference of absolute errors and how often the candidate is nearer."""
    x = _evidence(spark, d).withColumn("e", F.abs(c("projected") - c("actual")) - F.abs(c("baseline") - c("actual")))
    return x.groupBy("position", "season").agg(F.count(F.lit(1)).alias("rows"), R(F.avg("e")).alias("delta"), R(F.avg((c("e") < 0).cast("double"))).alias("nearer"))


def safety_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Positions where the candidate is no worse over all, and in no season by more than two per cent."""
    x = _evidence(spark, d).withColumn("a", F.abs(c("projected") - c("actual"))).withColumn("b", F.abs(c("baseline") - c("actual")))
    f = x.groupBy("position", "season").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return f.groupBy("position").agg((F.sum("a") <= F.sum("b")).alias("overall"), F.bool_and(c("a") <= c("b") * 1.02).alias("every_season"), F.count(F.lit(1)).alias("seasons"))


def range_checklist(spark: SparkSession, d: str) -> DataFrame:
    """Whether a position's range may be shown: enough rows, coverage near the nominal 80 %, both sides missed alike."""
    x = _evidence(spark, d).withColumn("r", c("actual") - c("projected"))
    q = ranks.quantiles(x, ["position"], "r", [0.1, 0.9]).drop("n")
    y = x.join(F.broadcast(q), "position").groupBy("position", "season").agg(F.count(F.lit(1)).alias("rows"), F.avg((c("r") < c("q")[0] - 1e-9).cast("double")).alias("below"), F.avg((c("r") > c("q")[1] + 1e-9).cast("double")).alias("above"))
    inside = 1 - c("below") - c("above")
    return y.select("position", "season", "rows", R(inside).alias("coverage"), ((c("rows") >= 30) & inside.between(0.75, 0.85) & (F.abs(c("below") - c("above")) <= 0.05)).alias("passes"))


def zero_outcome_audit(spark: SparkSession, d: str) -> DataFrame:
    """Newcomers against the rest: how often nothing came of a projection, and how much it promised too much."""
    rookies = read(spark, d, "players").where("rookie_season is not null").groupBy("player_id").agg(F.min("rookie_season").alias("first"))
    x = _evidence(spark, d).join(rookies, "player_id").withColumn("rookie", c("season") == c("first"))
    return x.groupBy("position", "rookie").agg(F.count(F.lit(1)).alias("rows"), R(F.avg((c("actual") <= 0).cast("double"))).alias("zeros"), R(F.avg(c("projected") - c("actual"))).alias("optimism"))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Evidence of all seasons but the last, and of the last."""
    x = _evidence(spark, d)
    last = x.agg(F.max("season").alias("last"))
    y = x.crossJoin(F.broadcast(last))
    return y.where("season < last"), y.where("season = last")


def calibration_policies(spark: SparkSession, d: str) -> DataFrame:
    """Four ways to mend projections, fitted per position on earlier seasons and tried on the last; the best of each."""
    train, test = _split(spark, d)
    off = ranks.quantiles(train.withColumn("r", c("actual") - c("projected")), ["position"], "r", [0.5]).select("position", c("q")[0].alias("offset"))
    ratio = ranks.quantiles(train.where("projected > 1").withColumn("r", c("actual") / c("projected")), ["position"], "r", [0.5]).select("position", c("q")[0].alias("ratio"))
    line = train.groupBy("position").agg(F.regr_slope("actual", "projected").alias("slope"), F.regr_intercept("actual", "projected").alias("intercept"))
    x = test
    for fitted in (off, ratio, line):
        x = x.join(F.broadcast(fitted), "position")
    ways = {"identity": c("projected"), "additive": c("projected") + c("offset"), "multiplicative": c("projected") * c("ratio"), "affine": c("intercept") + c("slope") * c("projected")}
    g = x.groupBy("position").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.abs(w - c("actual"))).alias(k) for k, w in ways.items()])
    best = F.array_min(F.array(*[F.struct(R(k, 9).alias("m"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(ways)]))
    return g.select("position", "rows", *[R(k).alias(k) for k in ways], best["k"].alias("best"))


KNOTS = [0.05, 0.25, 0.5, 0.75, 0.95]


def quantile_map(spark: SparkSession, d: str) -> DataFrame:
    """Projections of the last season mapped through five knots: the quantile of earlier projections to that of outcomes."""
    train, test = _split(spark, d)
    p = ranks.quantiles(train, ["position"], "projected", KNOTS, "p").drop("n")
    a = ranks.quantiles(train, ["position"], "actual", KNOTS, "a").drop("n")
    x = test.join(F.broadcast(p), "position").join(F.broadcast(a), "position")
    v = c("projected")
    out = F.when(v <= c("p")[0], c("a")[0])
    for i in range(1, len(KNOTS)):
        width = F.nullif(c("p")[i] - c("p")[i - 1], F.lit(0.0))
        out = out.when(v <= c("p")[i], c("a")[i - 1] + F.coalesce((v - c("p")[i - 1]) / width, F.lit(0.0)) * (c("a")[i] - c("a")[i - 1]))
    return x.select("week_row_id", R(out.otherwise(c("a")[len(KNOTS) - 1])).alias("mapped"))


def draftable_objective(spark: SparkSession, d: str) -> DataFrame:
    """The error that counts: three quarters of it over the players a league drafts, a quarter over the rest."""
    s = _seasons(spark, d).where("position is not null and fantasy_points_ppr is not null and not isnan(fantasy_points_ppr)").select("player_id", "season", "position", c("fantasy_points_ppr").alias("actual"))
    before = s.select("player_id", (c("season") + 1).alias("season"), c("actual").alias("projected"))
    x = s.join(before, ["player_id", "season"])
    top = D.top_k(x, ["season", "position"], [c("projected").desc(), c("player_id")], 12).select("player_id", "season", F.lit(True).alias("drafted"))
    y = x.join(top, ["player_id", "season"], "left").withColumn("e", F.abs(c("projected") - c("actual")))
    g = y.groupBy("season").agg(F.avg(F.when(c("drafted"), c("e"))).alias("a"), F.avg(F.when(c("drafted").isNull(), c("e"))).alias("b"), F.count(F.lit(1)).alias("rows"))
    return g.select("season", "rows", R("a").alias("drafted"), R("b").alias("rest"), R(0.75 * c("a") + 0.25 * F.coalesce("b", c("a"))).alias("objective"))


GRID = [round(0.1 * i, 1) for i in range(11)]


def shrinkage_search(spark: SparkSession, d: str) -> DataFrame:
    """The pull toward the baseline that would have erred least in earlier seasons, and what it errs in the last: one pass
    with an average per step of the grid."""
    train, test = _split(spark, d)
    at = lambda w: F.avg(F.abs(c("projected") * (1 - w) + c("baseline") * w - c("actual")))
    fit = train.groupBy("position").agg(*[at(w).alias(f"t{i}") for i, w in enumerate(GRID)])
    best = F.array_min(F.array(*[F.struct(R(f"t{i}", 9).alias("m"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(GRID)]))
    fit = fit.select("position", best["w"].alias("pull"), best["m"].alias("train_mae"))
    x = test.join(F.broadcast(fit), "position").withColumn("w", c("pull"))
    return x.groupBy("position", "pull", "train_mae").agg(R(F.avg(F.abs(c("projected") * (1 - c("w")) + c("baseline") * c("w") - c("actual")))).alias("test_mae")).select("position", "pull", R("train_mae").alias("train_mae"), "test_mae")


def policy_utility(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours on a board, two by two: how often choosing by floor or by ceiling changes the choice, and what it costs."""
    known = lambda v: F.when(~F.isnan(v), c(v))
    x = read(spark, d, "source_listings").where("position is not null").select("listing_id", "source_id", F.upper(F.trim("position")).alias("position"), known("mean").alias("mean"), known("floor").alias("floor"), known("ceiling").alias("ceiling")).where("mean is not null and floor is not null and ceiling is not null")
    x = ranks.placed(x, ["source_id", "position"], [c("mean").desc(), c("listing_id")])
    p = x.groupBy("source_id", "position", F.floor((c("place") - 1) / 2).alias("pair")).agg(F.min_by(F.struct("mean", "floor", "ceiling"), "place").alias("a"), F.max_by(F.struct("mean", "floor", "ceiling"), "place").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    stable, upside = c("b.floor") > c("a.floor"), c("b.ceiling") > c("a.ceiling")
    cost = c("a.mean") - c("b.mean")
    return p.groupBy("source_id").agg(F.count(F.lit(1)).alias("pairs"), R(F.avg(stable.cast("double"))).alias("stable_changes"), R(F.avg(upside.cast("double"))).alias("upside_changes"), R(F.avg(F.when(stable, cost).otherwise(0.0))).alias("stable_cost"), R(F.avg(F.when(upside, cost).otherwise(0.0))).alias("upside_cost"))


def pairwise_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Weights that say which of two neighbouring players of a season outscored the other a year later, fitted on the
    differences of their features over all seasons but the last, with the accuracy in the last. No pairs: no rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    s = _seasons(spark, d).where("position is not null and fantasy_points_ppr is not null and not isnan(fantasy_points_ppr)")
    now = s.select("player_id", "season", "position", c("fantasy_points_ppr").alias("points"), c("games").cast("double").alias("games"), F.coalesce(c("targets").cast("double"), F.lit(0.0)).alias("targets"))
    later = s.select("player_id", (c("season") - 1).alias("season"), c("fantasy_points_ppr").alias("after"))
    x = ranks.placed(now.join(later, ["player_id", "season"]), ["season", "position"], [c("points").desc(), c("player_id")])
    fields = ["points", "games", "targets", "after"]
    nxt = x.select("season", "position", (c("place") - 1).alias("place"), *[c(f).alias(f"n_{f}") for f in fields])
    pairs = x.join(nxt, ["season", "position", "place"]).where("after <> n_after")
    # every second pair the other way round, so that the label does not follow from the order
    sign = F.when(F.pmod("place", F.lit(2)) == 0, 1.0).otherwise(-1.0)
    diff = pairs.select("season", *[(sign * (c(f) - c(f"n_{f}"))).alias(f"d_{f}") for f in fields]).withColumn("label", (c("d_after") > 0).cast("double"))
    diff = stage(diff, "pairs")
    last = diff.agg(F.max("season")).first()[0]
    names = ["d_points", "d_games", "d_targets"]
    train = diff.where(c("season") < F.lit(last)) if last is not None else diff
    if last is None or train.select("label").distinct().count() < 2:
        return spark.createDataFrame([], "feature string, weight double, accuracy double, pairs long")
    assemble = VectorAssembler(inputCols=names, outputCol="x")
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.01, fitIntercept=False, maxIter=100).fit(assemble.transform(train))
    seen = model.transform(assemble.transform(diff.where(c("season") == F.lit(last))))
    score = seen.agg(F.avg((c("prediction") == c("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("pairs"), F.avg(vector_to_array("probability")[1]).alias("p"))
    weights = spark.createDataFrame(list(zip(names, [float(w) for w in model.coefficients])), "feature string, weight double")
    return weights.crossJoin(F.broadcast(score)).select("feature", R("weight", 9).alias("weight"), R("accuracy").alias("accuracy"), "pairs")


def hindsight_history(spark: SparkSession, d: str) -> DataFrame:
    """Recommended against actual: per team and season the best of its players by last season's points, who was best in the
    end, and whether the season is over (provisional for the newest)."""
    s = _seasons(spark, d).where("recent_team is not null and fantasy_points_ppr is not null and not isnan(fantasy_points_ppr)").select("player_id", "season", c("recent_team").alias("team"), c("fantasy_points_ppr").alias("points"))
    before = s.select("player_id", (c("season") + 1).alias("season"), c("points").alias("was"))
    x = s.join(before, ["player_id", "season"], "left")
    newest = s.agg(F.max("season").alias("newest"))
    order = lambda v: F.struct((-v).alias("o"), c("player_id").alias("p"))
    g = x.groupBy("team", "season").agg(F.min(F.when(c("was").isNotNull(), order(c("was"))))["p"].alias("recommended"), F.min(order(c("points")))["p"].alias("best"))
    y = g.join(s.select("season", c("player_id").alias("recommended"), c("points").alias("got")), ["season", "recommended"], "left").join(s.select("season", c("player_id").alias("best"), c("points").alias("could")), ["season", "best"], "left").crossJoin(F.broadcast(newest))
    status = F.when(c("recommended").isNull(), "none").when(c("season") == c("newest"), "provisional").otherwise("final")
    return y.select("team", "season", "recommended", "best", R(c("could") - c("got")).alias("regret"), status.alias("status"))


_EV = """x0 AS (SELECT week_row_id, player_id, season, week, upper(trim(position)) AS position, projected, fantasy_points AS actual FROM player_weeks WHERE player_id <> '00-0000000' AND position IS NOT NULL AND season IS NOT NULL AND projected IS NOT NULL AND NOT isnan(projected) AND fantasy_points IS NOT NULL AND NOT isnan(fantasy_points) AND abs(fantasy_points) < 100),
 s0 AS (SELECT position, season, sum(actual) AS s, count(*) AS n FROM x0 GROUP BY 1, 2), b0 AS (SELECT position, season, sum(s) OVER w / sum(n) OVER w AS baseline FROM s0 WINDOW w AS (PARTITION BY position ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 ev AS (SELECT x0.*, baseline, abs(projected - actual) AS a, abs(baseline - actual) AS b FROM x0 JOIN b0 USING (position, season) WHERE baseline IS NOT NULL)"""
_TT = f"{_EV}, la AS (SELECT max(season) AS last FROM ev), tr AS (SELECT ev.* FROM ev, la WHERE season < last), te AS (SELECT ev.* FROM ev, la WHERE season = last)"


def _slice(keys: list[str]) -> str:
    k = "".join(f"{x}, " for x in keys)
    null = {"season": "CAST(NULL AS INTEGER)", "position": "CAST(NULL AS VARCHAR)"}
    cols = ", ".join(f"{x if x in keys else null[x]} AS {x}" for x in ("season", "position"))
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {cols}, CAST(sum(n) AS BIGINT) AS rows, count(*) AS players, sum(a) AS sa, sum(b) AS sb, sum((a - b) * (a - b)) AS ee, sum((a - b) * n) AS en, sum(n * n) AS nn FROM (SELECT {k}player_id, sum(a) AS a, sum(b) AS b, count(*) AS n FROM ev GROUP BY {k}player_id) {by} HAVING sum(n) >= {LEAST[len(keys)]}"""


_WAYS = {"identity": "projected", "additive": "projected + o", "multiplicative": "projected * q", "affine": "i + sl * projected"}

QUERIES = {f.__name__: f for f in (promotion_gate, gate_errors, paired_delta, safety_acceptance, range_checklist, zero_outcome_audit, calibration_policies, quantile_map, draftable_objective, shrinkage_search, policy_utility, pairwise_logistic, hindsight_history)}
ORACLE = {
    "promotion_gate": f"""WITH {_EV}, g AS ({' UNION ALL '.join(_slice(k) for k in ([], ['season'], ['position'], ['season', 'position']))}), d AS (SELECT *, (sa - sb) / rows AS delta FROM g), e AS (SELECT *, sqrt(greatest(0, ee - 2 * delta * en + delta * delta * nn)) / rows AS error FROM d)
      SELECT season, position, rows, players, round(sa / rows, 6) AS mae, round(sb / rows, 6) AS baseline_mae, round(delta, 6) AS delta, round(delta - {Z}::DOUBLE * error, 6) AS low, round(delta + {Z}::DOUBLE * error, 6) AS high, delta + {Z}::DOUBLE * error < 0 AS passes FROM e""",
    "gate_errors": "WITH t AS (SELECT season, CAST(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicates FROM (SELECT player_id, season, count(*) AS n FROM player_examples GROUP BY 1, 2) GROUP BY 1), l AS (SELECT season, count(*) FILTER (feature_cutoff_season >= season) AS leaks, count(*) AS rows FROM player_examples GROUP BY 1) SELECT season, rows, duplicates, leaks, duplicates = 0 AND leaks = 0 AS clean FROM l JOIN t USING (season)",
    "paired_delta": f"WITH {_EV} SELECT position, season, count(*) AS rows, round(avg(a - b), 6) AS delta, round(avg(CAST(a < b AS DOUBLE)), 6) AS nearer FROM ev GROUP BY 1, 2",
    "safety_acceptance": f"WITH {_EV}, f AS (SELECT position, season, sum(a) AS a, sum(b) AS b FROM ev GROUP BY 1, 2) SELECT position, sum(a) <= sum(b) AS overall, bool_and(a <= b * 1.02::DOUBLE) AS every_season, count(*) AS seasons FROM f GROUP BY 1",
    "range_checklist": f"""WITH {_EV}, q AS (SELECT position, quantile_cont(actual - projected, [0.1, 0.9]) AS q FROM ev GROUP BY 1), y AS (SELECT position, season, count(*) AS rows, avg(CAST(actual - projected < q[1] - 1e-9::DOUBLE AS DOUBLE)) AS below, avg(CAST(actual - projected > q[2] + 1e-9::DOUBLE AS DOUBLE)) AS above FROM ev JOIN q USING (position) GROUP BY 1, 2)
      SELECT position, season, rows, round(1 - below - above, 6) AS coverage, rows >= 30 AND 1 - below - above BETWEEN 0.75::DOUBLE AND 0.85::DOUBLE AND abs(below - above) <= 0.05::DOUBLE AS passes FROM y""",
    "zero_outcome_audit": f"WITH {_EV}, r AS (SELECT player_id, min(rookie_season) AS first FROM players WHERE rookie_season IS NOT NULL GROUP BY 1) SELECT position, season = first AS rookie, count(*) AS rows, round(avg(CAST(actual <= 0 AS DOUBLE)), 6) AS zeros, round(avg(projected - actual), 6) AS optimism FROM ev JOIN r USING (player_id) GROUP BY 1, 2",
    "calibration_policies": f"""WITH {_TT}, o AS (SELECT position, quantile_cont(actual - projected, 0.5) AS o FROM tr GROUP BY 1), q AS (SELECT position, quantile_cont(actual / projected, 0.5) AS q FROM tr WHERE projected > 1 GROUP BY 1), l AS (SELECT position, regr_slope(actual, projected) AS sl, regr_intercept(actual, projected) AS i FROM tr GROUP BY 1),
      g AS (SELECT position, count(*) AS rows, {', '.join(f'avg(abs({w} - actual)) AS {k}' for k, w in _WAYS.items())} FROM te JOIN o USING (position) JOIN q USING (position) JOIN l USING (position) GROUP BY 1)
      SELECT position, rows, {', '.join(f'round({k}, 6) AS {k}' for k in _WAYS)}, list_sort([{', '.join(f"{{'m': round({k}, 9), 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(_WAYS))}])[1].k AS best FROM g""",
    "quantile_map": f"""WITH {_TT}, k AS (SELECT position, quantile_cont(projected, {KNOTS}) AS p, quantile_cont(actual, {KNOTS}) AS a FROM tr GROUP BY 1)
      SELECT week_row_id, round(CASE WHEN projected <= p[1] THEN k.a[1] {' '.join(f'WHEN projected <= p[{i + 1}] THEN k.a[{i}] + coalesce((projected - p[{i}]) / nullif(p[{i + 1}] - p[{i}], 0), 0) * (k.a[{i + 1}] - k.a[{i}])' for i in range(1, 5))} ELSE k.a[5] END, 6) AS mapped FROM te JOIN k USING (position)""",
    "draftable_objective": f"""WITH {_SEASONS}, z AS (SELECT player_id, season, position, fantasy_points_ppr AS actual FROM s WHERE position IS NOT NULL AND fantasy_points_ppr IS NOT NULL AND NOT isnan(fantasy_points_ppr)), x AS (SELECT n.player_id, n.season, n.position, n.actual, b.actual AS projected FROM z n JOIN z b ON b.player_id = n.player_id AND b.season = n.season - 1),
      y AS (SELECT *, abs(projected - actual) AS e, row_number() OVER (PARTITION BY season, position ORDER BY projected DESC, player_id) <= 12 AS drafted FROM x), g AS (SELECT season, avg(e) FILTER (drafted) AS a, avg(e) FILTER (NOT drafted) AS b, count(*) AS rows FROM y GROUP BY 1)
      SELECT season, rows, round(a, 6) AS drafted, round(b, 6) AS rest, round(0.75::DOUBLE * a + 0.25::DOUBLE * coalesce(b, a), 6) AS objective FROM g""",
    "shrinkage_search": f"""WITH {_TT}, f AS (SELECT position, list_sort([{', '.join(f"{{'m': round(avg(abs(projected * (1 - {w}::DOUBLE) + baseline * {w}::DOUBLE - actual)), 9), 'i': {i}, 'w': {w}::DOUBLE}}" for i, w in enumerate(GRID))}])[1] AS t FROM tr GROUP BY 1)
      SELECT position, t.w AS pull, round(t.m, 6) AS train_mae, round(avg(abs(projected * (1 - t.w) + baseline * t.w - actual)), 6) AS test_mae FROM te JOIN f USING (position) GROUP BY position, t.w, t.m""",
    "policy_utility": """WITH x AS (SELECT source_id, upper(trim(position)) AS position, mean, floor, ceiling, row_number() OVER (PARTITION BY source_id, upper(trim(position)) ORDER BY mean DESC, listing_id) - 1 AS k FROM source_listings WHERE position IS NOT NULL AND mean IS NOT NULL AND NOT isnan(mean) AND floor IS NOT NULL AND NOT isnan(floor) AND ceiling IS NOT NULL AND NOT isnan(ceiling)),
      p AS (SELECT a.source_id, a.mean - b.mean AS cost, b.floor > a.floor AS st, b.ceiling > a.ceiling AS up FROM x a JOIN x b ON a.source_id = b.source_id AND a.position = b.position AND a.k % 2 = 0 AND b.k = a.k + 1)
      SELECT source_id, count(*) AS pairs, round(avg(CAST(st AS DOUBLE)), 6) AS stable_changes, round(avg(CAST(up AS DOUBLE)), 6) AS upside_changes, round(avg(CASE WHEN st THEN cost ELSE 0 END), 6) AS stable_cost, round(avg(CASE WHEN up THEN cost ELSE 0 END), 6) AS upside_cost FROM p GROUP BY 1""",
    "hindsight_history": f"""WITH {_SEASONS}, z AS (SELECT player_id, season, recent_team AS team, fantasy_points_ppr AS points FROM s WHERE recent_team IS NOT NULL AND fantasy_points_ppr IS NOT NULL AND NOT isnan(fantasy_points_ppr)), x AS (SELECT z.*, b.points AS was FROM z LEFT JOIN z b ON b.player_id = z.player_id AND b.season = z.season - 1),
      k AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY was DESC NULLS LAST, player_id) AS rw, row_number() OVER (PARTITION BY team, season ORDER BY points DESC, player_id) AS rp FROM x), a AS (SELECT team, season, player_id AS best, points AS could FROM k WHERE rp = 1), r AS (SELECT team, season, player_id AS recommended, points AS got FROM k WHERE rw = 1 AND was IS NOT NULL)
      SELECT a.team, a.season, recommended, best, round(could - got, 6) AS regret, CASE WHEN recommended IS NULL THEN 'none' WHEN a.season = (SELECT max(season) FROM z) THEN 'provisional' ELSE 'final' END AS status FROM a LEFT JOIN r ON r.team = a.team AND r.season = a.season""",
}
