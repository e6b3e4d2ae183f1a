"""Queries of derived columns, lookups and smaller aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import ranks
from draftloom.operators import resample as B
from draftloom.plans.temporal import _SEASONS, _seasons
from draftloom.session import read, stage

c = F.col
R = lambda x, n=6: F.round(x, n)


def draft_picks_valid(spark: SparkSession, d: str) -> DataFrame:
    """Roster draft picks within range, and how often each is claimed."""
    p = read(spark, d, "players").where(c("draft_round").between(1, 7) & c("draft_pick").between(1, 300))
    return p.groupBy("rookie_season", "draft_pick").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("player_id").alias("players"))


def catalog_indexes(spark: SparkSession, d: str) -> DataFrame:
    """A JSON catalogue keyed by id, exploded into its lookup keys; a key of two entries is dropped."""
    entry = F.to_json(F.map_from_arrays(F.array(c("player_id")), F.array(F.struct("name", "team"))))
    blob = read(spark, d, "players").where("name is not null").select(entry.alias("j"))
    x = blob.select(F.explode(F.from_json("j", "map<string, struct<name: string, team: string>>")).alias("id", "v")).select("id", S.ascii_key(c("v.name")).alias("nk")).distinct()
    n = x.groupBy("nk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return n.where("n = 1").select("nk", "id")


def scoring_bucket(spark: SparkSession, d: str) -> DataFrame:
    r = c("l_discount") * 10
    return read(spark, d, "lineitem").groupBy(F.when(r >= 0.75, "ppr").when(r >= 0.25, "half").otherwise("standard").alias("format")).agg(F.count(F.lit(1)).alias("n"))


def one_hot_position(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "player_examples").select("example_id", *[(F.coalesce(c("position") == p, F.lit(False))).cast("int").alias(p.lower()) for p in ("QB", "RB", "WR", "TE", "K")])


def normalized_pick(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "players").where("draft_pick is not null").select("roster_row_id", R(c("draft_pick") * 12 / 32.0).alias("pick12"), R(1 / F.sqrt(F.greatest(F.lit(1), c("draft_pick")).cast("double"))).alias("capital"))


def activity_status(spark: SparkSession, d: str) -> DataFrame:
    """Observed, inactive or unknown, from what the week and the season say."""
    w = read(spark, d, "player_weeks").select("week_row_id", "player_id", "season", c("fantasy_points").alias("fp"))
    s = _seasons(spark, d).select("player_id", "season", "games")
    status = F.when(c("fp").isNotNull() & ~F.isnan("fp"), "observed").when(c("games") == 0, "inactive").otherwise("unknown")
    return w.join(s, ["player_id", "season"], "left").select("week_row_id", status.alias("status"))


def implied_points(spark: SparkSession, d: str) -> DataFrame:
    """Signed line and total of a game to the points of both sides."""
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), (F.max("l_quantity") - F.min("l_quantity")).alias("line"))
    side = F.explode(F.array(F.struct(F.lit("home").alias("side"), (c("total") / 2 + c("line") / 2).alias("points")), F.struct(F.lit("away").alias("side"), (c("total") / 2 - c("line") / 2).alias("points"))))
    return g.select("l_orderkey", side.alias("x")).select("l_orderkey", "x.side", "x.points")


def regressed_edge(spark: SparkSession, d: str) -> DataFrame:
    """An edge over the group's median, shrunk to a fifth by reliability and capped at 12."""
    p = read(spark, d, "part")
    base = ranks.quantiles(p, ["p_type"], "p_retailprice", [0.5]).select("p_type", c("q")[0].alias("base"))
    reliability = S.clamp(1 - c("p_size") / 50.0 * 0.75, 0.5, 1.0)
    edge = F.greatest(F.lit(0.0), c("p_retailprice") - c("base"))
    return p.join(base, "p_type").select("p_partkey", R(c("base") + F.least(F.lit(12.0), edge * 0.2 * reliability)).alias("value"))


def range_and_risk(spark: SparkSession, d: str) -> DataFrame:
    """Floor and ceiling from a position's residual quantiles, and the risk their width implies."""
    x = read(spark, d, "player_weeks").where("projected is not null and not isnan(projected) and fantasy_points is not null and not isnan(fantasy_points) and abs(fantasy_points) < 100 and position is not null")
    q = ranks.quantiles(x.select(F.upper("position").alias("pos"), (c("fantasy_points") - c("projected")).alias("r")), ["pos"], "r", [0.1, 0.9]).drop("n")
    y = x.join(q, F.upper("position") == c("pos")).withColumn("low", F.greatest(F.lit(0.0), c("projected") + c("q")[0])).withColumn("high", F.least(c("projected") * 3 + 10, c("projected") + c("q")[1]))
    return y.select("week_row_id", R("low").alias("low"), R("high").alias("high"), R(S.clamp((c("high") - c("low")) / (2 * F.greatest(F.lit(0.1), c("projected"))), 0.05, 0.95)).alias("risk"))


def projection_driver(spark: SparkSession, d: str) -> DataFrame:
    """The first usable of projection, points and nought, and why."""
    good = lambda x: c(x).isNotNull() & ~F.isnan(x) & (c(x) > 0) & (c(x) < 100)
    return read(spark, d, "player_weeks").select("week_row_id", F.when(good("projected"), c("projected")).when(good("fantasy_points"), c("fantasy_points")).otherwise(0.0).alias("value"), F.when(good("projected"), "projection").when(good("fantasy_points"), "points").otherwise("nothing usable").alias("driver"))


def lifecycle_features(spark: SparkSession, d: str) -> DataFrame:
    # fixed values: peak ages by position
    peak = F.when(c("position") == "RB", 25.0).when(c("position") == "WR", 27.0).when(c("position") == "QB", 31.0).otherwise(28.0)
    age = F.when(~F.isnan("age"), c("age"))
    return read(spark, d, "player_examples").select("example_id", R(age - peak).alias("past_peak"), (c("experience") == 0).alias("rookie"), F.least(c("experience"), F.lit(8)).alias("experience_capped"))


def role_sample_weights(spark: SparkSession, d: str) -> DataFrame:
    depth = F.when(~F.isnan("depth_rank"), c("depth_rank"))
    return read(spark, d, "player_examples").groupBy(F.when(depth <= 1, 4).when(depth <= 2, 2).otherwise(1).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def direct_season_total(spark: SparkSession, d: str) -> DataFrame:
    """Lagged points a game times lagged games, pulled to the position's mean by experience."""
    x = read(spark, d, "player_examples")
    clean = lambda n: F.when(~F.isnan(n), c(n))
    total = S.weighted_present([clean("fantasy_points_ppr_lag1"), clean("fantasy_points_ppr_lag2")], [0.7, 0.3])
    prior = x.groupBy("position").agg(F.avg(F.when(~F.isnan("target_ppr_total"), c("target_ppr_total"))).alias("prior"))
    trust = c("experience") / (c("experience") + 2.0)
    return x.join(prior, "position").select("example_id", R(trust * F.coalesce(total, c("prior")) + (1 - trust) * c("prior"), 7).alias("total"))


def three_way_left(spark: SparkSession, d: str) -> DataFrame:
    """Listings by name to roster, to seasons: nothing is lost on the way."""
    l = read(spark, d, "source_listings").select("listing_id", S.ascii_key(c("name")).alias("nk"))
    p = read(spark, d, "players").where("name is not null").groupBy(S.ascii_key(c("name")).alias("nk")).agg(F.min("player_id").alias("player_id"))
    s = _seasons(spark, d).groupBy("player_id").agg(F.max("season").alias("last_season"), F.sum("games").alias("games"))
    return l.join(p, "nk", "left").join(s, "player_id", "left").select("listing_id", "player_id", "last_season", "games")


def adp_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """How many listings of a source lie within max(4, a quarter) of each listing's market position.

    Bands are counted by places, not by pairs: how many listings stand up to the band's upper end and before its lower
    one, and who stands there. The band is closed, within rounding.
    """
    adp = F.when(~F.isnan("adp") & (c("adp") > 0), c("adp"))
    x = read(spark, d, "source_listings").select("listing_id", "source_id", adp.alias("a")).where("a is not null").withColumn("band", F.greatest(F.lit(4.0), c("a") * 0.25))
    # at one value: lower ends before listings before upper ends
    points = F.array(*[F.struct(v.alias("v"), F.lit(k).alias("kind"), F.lit(w).alias("w")) for v, k, w in ((c("a") - c("band") - 1e-9, 0, 0), (c("a"), 1, 1), (c("a") + c("band") + 1e-9, 2, 0))])
    every = x.select("listing_id", "source_id", F.explode(points).alias("p")).select("listing_id", "source_id", "p.*")
    run = stage(ranks.cumulative(every, ["source_id"], [c("v"), c("kind"), c("listing_id")], {"n": c("w")}), "bands")
    ends = run.groupBy("listing_id", "source_id").agg(F.max(F.when(c("kind") == 0, c("n_upto"))).alias("before"), F.max(F.when(c("kind") == 2, c("n_upto"))).alias("upto"))
    place = run.where("kind = 1").select("source_id", c("n_upto").alias("place"), c("v").alias("b"))
    low = ends.join(place, (ends["source_id"] == place["source_id"]) & (c("place") == c("before") + 1)).select("listing_id", ends["source_id"].alias("s"), (c("upto") - c("before")).alias("n"), "upto", c("b").alias("nearest_low"))
    return low.join(place, (c("s") == c("source_id")) & (c("place") == c("upto"))).select("listing_id", "n", "nearest_low", c("b").alias("nearest_high"))


def position_competition(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "player_examples").where("team is not null")
    return x.groupBy("team", "season", "position").agg(F.count_if(F.coalesce(c("depth_rank") <= 3, F.lit(False))).alias("rivals"), F.countDistinct("player_id").alias("players"), F.max("experience").alias("oldest"))


def wide_summary(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "player_seasons")
    return x.groupBy("season", "position").agg(F.count(F.lit(1)).alias("n"), R(F.avg("games")).alias("mean_games"), R(F.median("games")).alias("median_games"), F.countDistinct("player_id").alias("players"), F.max("version_no").alias("versions"), F.min_by("player_id", F.struct("recorded_at", "stat_row_id")).alias("first_player"))


def opponent_allowed_prior(spark: SparkSession, d: str) -> DataFrame:
    """What each team's opponents of a season had allowed on average in the season before."""
    w = read(spark, d, "player_weeks").where("fantasy_points is not null and not isnan(fantasy_points) and abs(fantasy_points) < 100 and team is not null and opponent_team is not null")
    allowed = w.groupBy(c("opponent_team").alias("opponent"), (c("season") + 1).alias("season")).agg(F.avg("fantasy_points").alias("allowed"))
    games = w.select("team", c("opponent_team").alias("opponent"), "season", "week").distinct()
    j = games.join(allowed, ["opponent", "season"], "left")
    return j.groupBy("team", "season").agg(R(F.avg("allowed"), 8).alias("schedule"), R(F.avg(c("allowed").isNotNull().cast("double")), 8).alias("coverage"))


def status_rates(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "player_weeks").groupBy("season").pivot("outcome_status", ["active-observed", "inactive-or-unavailable", "unknown-activity"]).agg(F.count(F.lit(1)))
    n = [F.coalesce(c(f"`{k}`"), F.lit(0)) for k in ("active-observed", "inactive-or-unavailable", "unknown-activity")]
    return t.select("season", *[x.alias(a) for x, a in zip(n, ("active", "inactive", "unknown"))], R(n[0] / (n[0] + n[1] + n[2]), 9).alias("active_rate"))


def letter_grades(spark: SparkSession, d: str) -> DataFrame:
    pct = F.percent_rank().over(Window.partitionBy("season").orderBy("score"))
    s = _seasons(spark, d).where("recent_team is not null").groupBy("recent_team", "season").agg(F.round(F.sum("fantasy_points_ppr"), 6).alias("score"))
    steps = [(0.9, "A"), (0.7, "B"), (0.4, "C"), (0.15, "D")]
    return s.select("recent_team", "season", S.grade(pct, steps, "E").alias("grade"))


def random_split_blend(spark: SparkSession, d: str) -> DataFrame:
    """Repeated keyed half splits: the mean error of a blend on the held-out half, per weight."""
    x = read(spark, d, "player_examples").where("target_ppr_total is not null and not isnan(target_ppr_total) and fantasy_points_ppr_lag1 is not null and not isnan(fantasy_points_ppr_lag1)").select("example_id", c("target_ppr_total").alias("y"), c("fantasy_points_ppr_lag1").alias("a"))
    s = x.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(4)))).where(B.uniform(61, c("split"), [c("example_id")]) >= 0.5)
    w = s.withColumn("w", F.explode(F.array(*[F.lit(i / 10) for i in range(11)])))
    return w.groupBy("split", "w").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.abs(c("w") * c("a") + (1 - c("w")) * 90.0 - c("y"))), 8).alias("mae"))


def shrunken_offset(spark: SparkSession, d: str) -> DataFrame:
    """The prior season's median residual of a position, shrunk by how many rows it rests on."""
    x = read(spark, d, "player_examples").where("target_ppr_total is not null and not isnan(target_ppr_total) and fantasy_points_ppr_lag1 is not null and not isnan(fantasy_points_ppr_lag1)")
    m = x.groupBy("position", (c("season") + 1).alias("season")).agg(F.median(c("target_ppr_total") - c("fantasy_points_ppr_lag1")).alias("m"), F.count(F.lit(1)).alias("n"))
    return m.select("position", "season", "n", R(S.clamp(c("m") * c("n") / (c("n") + 25.0), -34.0, 595.0), 8).alias("offset"))


def feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    cols = ("age", "depth_rank", "games_lag1", "games_lag2", "target_share", "target_ppr_total")
    x = read(spark, d, "player_examples")
    known = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), (c(n).isNotNull() & ~F.isnan(n)).cast("double").alias("k")) for n in cols]))
    return x.select("season", known.alias("x")).groupBy("season", "x.feature").agg(R(F.avg("x.k"), 9).alias("coverage"))


def ranking_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """Two orderings of a position against each other: place in each, and how far apart."""
    s = _seasons(spark, d).select("player_id", "season", "position", "fantasy_points", "fantasy_points_ppr")
    w = Window.partitionBy("season", "position")
    r = s.withColumn("a", F.row_number().over(w.orderBy(c("fantasy_points_ppr").desc_nulls_last(), "player_id"))).withColumn("b", F.row_number().over(w.orderBy(c("fantasy_points").desc_nulls_last(), "player_id")))
    return r.select("player_id", "season", "a", "b", (c("a") - c("b")).alias("delta"))


_OK = "target_ppr_total IS NOT NULL AND NOT isnan(target_ppr_total) AND fantasy_points_ppr_lag1 IS NOT NULL AND NOT isnan(fantasy_points_ppr_lag1)"
_PTS = "fantasy_points IS NOT NULL AND NOT isnan(fantasy_points) AND abs(fantasy_points) < 100"
_KEY = "regexp_replace(regexp_replace(lower(strip_accents(name)), '\\s+(jr|sr|ii|iii|iv|v)\\.?$', ''), '[^a-z0-9]', '', 'g')"


def _split_sql() -> str:
    from draftloom.plans.simulations import _chain, _finish

    keys, last = _chain(61, "split", ["example_id"], "k", "b", "split, example_id, y, a")
    return f"""WITH b AS (SELECT split, example_id, target_ppr_total AS y, fantasy_points_ppr_lag1 AS a FROM player_examples, range(5) s(split) WHERE {_OK}), {keys}, {_finish('f', last, 'split, example_id, y, a', 'u')}
      SELECT CAST(split AS INTEGER) AS split, i / 10.0::DOUBLE AS w, count(*) AS n, round(avg(abs(i / 10.0::DOUBLE * a + (1 - i / 10.0::DOUBLE) * 90 - y)), 8) AS mae FROM ft, range(11) w(i) WHERE u >= 0.5 GROUP BY 1, 2"""


QUERIES = {f.__name__: f for f in (draft_picks_valid, catalog_indexes, scoring_bucket, one_hot_position, normalized_pick, activity_status, implied_points, regressed_edge, range_and_risk, projection_driver, lifecycle_features, role_sample_weights, direct_season_total, three_way_left, adp_neighbourhood, position_competition, wide_summary, opponent_allowed_prior, status_rates, letter_grades, random_split_blend, shrunken_offset, feature_coverage, ranking_disagreement)}
ORACLE = {
    "draft_picks_valid": "SELECT rookie_season, draft_pick, count(*) AS claims, count(DISTINCT player_id) AS players FROM players WHERE draft_round BETWEEN 1 AND 7 AND draft_pick BETWEEN 1 AND 300 GROUP BY 1, 2",
    "catalog_indexes": f"SELECT nk, min(player_id) AS id FROM (SELECT DISTINCT player_id, {_KEY} AS nk FROM players WHERE name IS NOT NULL) GROUP BY 1 HAVING count(*) = 1",
    "scoring_bucket": "SELECT CASE WHEN l_discount * 10 >= 0.75::DOUBLE THEN 'ppr' WHEN l_discount * 10 >= 0.25::DOUBLE THEN 'half' ELSE 'standard' END AS format, count(*) AS n FROM lineitem GROUP BY 1",
    "one_hot_position": "SELECT example_id, " + ", ".join(f"CAST(coalesce(position = '{p}', false) AS INTEGER) AS {p.lower()}" for p in ("QB", "RB", "WR", "TE", "K")) + " FROM player_examples",
    "normalized_pick": "SELECT roster_row_id, round(draft_pick * 12 / 32.0::DOUBLE, 6) AS pick12, round(1 / sqrt(greatest(1, draft_pick)::DOUBLE), 6) AS capital FROM players WHERE draft_pick IS NOT NULL",
    "activity_status": f"WITH {_SEASONS} SELECT week_row_id, CASE WHEN w.fantasy_points IS NOT NULL AND NOT isnan(w.fantasy_points) THEN 'observed' WHEN s.games = 0 THEN 'inactive' ELSE 'unknown' END AS status FROM player_weeks w LEFT JOIN s ON s.player_id = w.player_id AND s.season = w.season",
    "implied_points": "WITH g AS (SELECT l_orderkey, sum(l_quantity) AS t, max(l_quantity) - min(l_quantity) AS l FROM lineitem GROUP BY 1) SELECT l_orderkey, 'home' AS side, t / 2 + l / 2 AS points FROM g UNION ALL SELECT l_orderkey, 'away', t / 2 - l / 2 FROM g",
    "regressed_edge": "WITH b AS (SELECT *, median(p_retailprice) OVER (PARTITION BY p_type) AS b FROM part) SELECT p_partkey, round(b + least(12, greatest(0, p_retailprice - b) * 0.2::DOUBLE * least(greatest(1 - p_size / 50.0::DOUBLE * 0.75::DOUBLE, 0.5::DOUBLE), 1)), 6) AS value FROM b",
    "range_and_risk": f"""WITH x AS (SELECT *, upper(position) AS pos FROM player_weeks WHERE projected IS NOT NULL AND NOT isnan(projected) AND {_PTS} AND position IS NOT NULL), q AS (SELECT pos, quantile_cont(fantasy_points - projected, [0.1, 0.9]) AS q FROM x GROUP BY 1),
      y AS (SELECT week_row_id, projected, greatest(0, projected + q[1]) AS low, least(projected * 3 + 10, projected + q[2]) AS high FROM x JOIN q USING (pos)) SELECT week_row_id, round(low, 6) AS low, round(high, 6) AS high, round(least(greatest((high - low) / (2 * greatest(0.1::DOUBLE, projected)), 0.05::DOUBLE), 0.95::DOUBLE), 6) AS risk FROM y""",
    "projection_driver": """WITH g AS (SELECT *, coalesce(NOT isnan(projected) AND projected > 0 AND projected < 100, false) AS a, coalesce(NOT isnan(fantasy_points) AND fantasy_points > 0 AND fantasy_points < 100, false) AS b FROM player_weeks)
      SELECT week_row_id, CAST(CASE WHEN a THEN projected WHEN b THEN fantasy_points ELSE 0 END AS DOUBLE) AS value, CASE WHEN a THEN 'projection' WHEN b THEN 'points' ELSE 'nothing usable' END AS driver FROM g""",
    "lifecycle_features": "SELECT example_id, round(CASE WHEN NOT isnan(age) THEN age END - CAST(CASE position WHEN 'RB' THEN 25 WHEN 'WR' THEN 27 WHEN 'QB' THEN 31 ELSE 28 END AS DOUBLE), 6) AS past_peak, experience = 0 AS rookie, least(experience, 8) AS experience_capped FROM player_examples",
    "role_sample_weights": "SELECT CAST(CASE WHEN NOT isnan(depth_rank) AND depth_rank <= 1 THEN 4 WHEN NOT isnan(depth_rank) AND depth_rank <= 2 THEN 2 ELSE 1 END AS INTEGER) AS weight, count(*) AS n FROM player_examples GROUP BY 1",
    "direct_season_total": """WITH p AS (SELECT position, avg(target_ppr_total) FILTER (NOT isnan(target_ppr_total)) AS prior FROM player_examples GROUP BY 1), x AS (SELECT example_id, position, experience, CASE WHEN NOT isnan(fantasy_points_ppr_lag1) THEN fantasy_points_ppr_lag1 END AS a, CASE WHEN NOT isnan(fantasy_points_ppr_lag2) THEN fantasy_points_ppr_lag2 END AS b FROM player_examples),
      t AS (SELECT *, (coalesce(a * 0.7::DOUBLE, 0) + coalesce(b * 0.3::DOUBLE, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.7::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END, 0) AS total, experience / (experience + 2.0::DOUBLE) AS tr FROM x)
      SELECT example_id, round(tr * coalesce(total, prior) + (1 - tr) * prior, 7) AS total FROM t JOIN p USING (position)""",
    "three_way_left": f"""WITH {_SEASONS}, l AS (SELECT listing_id, {_KEY} AS nk FROM source_listings), p AS (SELECT {_KEY} AS nk, min(player_id) AS player_id FROM players WHERE name IS NOT NULL GROUP BY 1), t AS (SELECT player_id, max(season) AS last_season, CAST(sum(games) AS BIGINT) AS games FROM s GROUP BY 1)
      SELECT listing_id, p.player_id, last_season, games FROM l LEFT JOIN p ON l.nk = p.nk LEFT JOIN t ON t.player_id = p.player_id""",
    "adp_neighbourhood": """WITH x AS (SELECT listing_id, source_id, adp AS a FROM source_listings WHERE adp IS NOT NULL AND NOT isnan(adp) AND adp > 0)
      SELECT x.listing_id, count(*) AS n, min(y.a) AS nearest_low, max(y.a) AS nearest_high FROM x JOIN x y ON x.source_id = y.source_id AND abs(x.a - y.a) <= greatest(4, x.a * 0.25::DOUBLE) + 1e-9::DOUBLE GROUP BY 1""",
    "position_competition": "SELECT team, season, position, count(*) FILTER (depth_rank <= 3) AS rivals, count(DISTINCT player_id) AS players, max(experience) AS oldest FROM player_examples WHERE team IS NOT NULL GROUP BY 1, 2, 3",
    "wide_summary": "SELECT season, position, count(*) AS n, round(avg(games), 6) AS mean_games, round(median(games), 6) AS median_games, count(DISTINCT player_id) AS players, max(version_no) AS versions, arg_min(player_id, {'a': recorded_at, 'b': stat_row_id}) AS first_player FROM player_seasons GROUP BY 1, 2",
    "opponent_allowed_prior": f"""WITH w AS (SELECT * FROM player_weeks WHERE {_PTS} AND team IS NOT NULL AND opponent_team IS NOT NULL), a AS (SELECT opponent_team AS opponent, season + 1 AS season, avg(fantasy_points) AS allowed FROM w GROUP BY 1, 2), g AS (SELECT DISTINCT team, opponent_team AS opponent, season, week FROM w)
      SELECT team, season, round(avg(allowed), 8) AS schedule, round(avg(CAST(allowed IS NOT NULL AS DOUBLE)), 8) AS coverage FROM g LEFT JOIN a USING (opponent, season) GROUP BY 1, 2""",
    "status_rates": "SELECT season, count(*) FILTER (outcome_status = 'active-observed') AS active, count(*) FILTER (outcome_status = 'inactive-or-unavailable') AS inactive, count(*) FILTER (outcome_status = 'unknown-activity') AS unknown, round(count(*) FILTER (outcome_status = 'active-observed') / count(*) FILTER (outcome_status IN ('active-observed', 'inactive-or-unavailable', 'unknown-activity')), 9) AS active_rate FROM player_weeks GROUP BY 1",
    "letter_grades": f"""WITH {_SEASONS}, t AS (SELECT recent_team, season, round(sum(fantasy_points_ppr), 6) AS score FROM s WHERE recent_team IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, percent_rank() OVER (PARTITION BY season ORDER BY score) AS p FROM t)
      SELECT recent_team, season, CASE WHEN p >= 0.9::DOUBLE THEN 'A' WHEN p >= 0.7::DOUBLE THEN 'B' WHEN p >= 0.4::DOUBLE THEN 'C' WHEN p >= 0.15::DOUBLE THEN 'D' ELSE 'E' END AS grade FROM p""",
    "random_split_blend": _split_sql(),
    "shrunken_offset": f"WITH m AS (SELECT position, season + 1 AS season, median(target_ppr_total - fantasy_points_ppr_lag1) AS m, count(*) AS n FROM player_examples WHERE {_OK} GROUP BY 1, 2) SELECT position, season, n, round(least(greatest(m * n / (n + 25.0::DOUBLE), -34), 595), 8) AS offset FROM m",
    "feature_coverage": "SELECT season, feature, round(avg(CAST(k AS DOUBLE)), 9) AS coverage FROM (" + " UNION ALL ".join(f"SELECT season, '{n}' AS feature, {n} IS NOT NULL AND NOT isnan({n}) AS k FROM player_examples" for n in ("age", "depth_rank", "games_lag1", "games_lag2", "target_share", "target_ppr_total")) + ") GROUP BY 1, 2",
    "ranking_disagreement": f"WITH {_SEASONS}, r AS (SELECT player_id, season, CAST(row_number() OVER (PARTITION BY season, position ORDER BY fantasy_points_ppr DESC NULLS LAST, player_id) AS INTEGER) AS a, CAST(row_number() OVER (PARTITION BY season, position ORDER BY fantasy_points DESC NULLS LAST, player_id) AS INTEGER) AS b FROM s) SELECT player_id, season, a, b, a - b AS delta FROM r",
}
