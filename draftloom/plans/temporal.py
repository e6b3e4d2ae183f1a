"""Queries over time: lags, bounds, recency, runs, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import temporal as T
from draftloom.session import read

c = F.col
R = lambda x, n=6: F.round(x, n)


def _seasons(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of every player-season."""
    return T.keep_last(read(spark, d, "player_seasons"), ["player_id", "season"], [c("version_no"), c("recorded_at"), c("stat_row_id")])


def _years(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("season")).agg(F.avg("l_extendedprice").alias("points"), F.count(F.lit(1)).alias("games"))


def latest_player_seasons(spark: SparkSession, d: str) -> DataFrame:
    return _seasons(spark, d).select("player_id", "season", "version_no", "games", "stat_row_id")


def season_lag_join(spark: SparkSession, d: str) -> DataFrame:
    return T.season_lags(_seasons(spark, d).select("player_id", "season", "games"), ["player_id"], "season", ["games"]).select("player_id", "season", "games_lag1", "games_lag2", "games_lag3")


def ewma_present_lags(spark: SparkSession, d: str) -> DataFrame:
    lag = T.season_lags(_years(spark, d), ["l_partkey"], "season", ["points"])
    # fixed values: weights of the last three seasons
    x = S.weighted_present([c("points_lag1"), c("points_lag2"), c("points_lag3")], [0.60, 0.27, 0.13])
    return lag.select("l_partkey", "season", R(x, 8).alias("ewma"), R(F.coalesce(c("points_lag1") - c("points_lag2"), F.lit(0.0)), 8).alias("trend"))


def per_game_rates(spark: SparkSession, d: str) -> DataFrame:
    return _seasons(spark, d).select("player_id", "season", R(S.per_game(c("fantasy_points_ppr"), c("games").cast("double"))).alias("ppg"))


def asof_last_before_cutoff(spark: SparkSession, d: str) -> DataFrame:
    bound = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return T.latest_before(read(spark, d, "events"), ["user_id"], "ts", bound, [c("event_id")], ["event_id", "event_type", "value"]).select("user_id", "event_id", "event_type", "value")


def first_snapshot_per_season(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("season", F.year("o_orderdate"))
    return T.first_per(o, ["o_custkey", "season"], [c("o_orderdate"), c("o_orderkey")], ["o_orderkey", "o_totalprice"])


def latest_eligible_per_series(spark: SparkSession, d: str) -> DataFrame:
    """Latest event per user and type before the cutoff that is not older than 72 hours."""
    cut = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    fresh = read(spark, d, "events").where((c("ts") <= cut) & (c("ts") >= F.to_timestamp_ntz(F.lit("2024-01-17 00:00:00"))))
    best = fresh.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return best


def history_weighted_theta(spark: SparkSession, d: str) -> DataFrame:
    y = read(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.avg("o_totalprice").alias("v"))
    return T.history_weighted(y, "o_custkey", "season", "v", 0.65).select("o_custkey", "season", "seasons", R("history", 7).alias("history"))


def tenure_islands(spark: SparkSession, d: str) -> DataFrame:
    return T.tenure(read(spark, d, "orders").withColumn("season", F.year("o_orderdate")), ["o_custkey"], "season")


def last_k_vs_rest(spark: SparkSession, d: str) -> DataFrame:
    return T.last_k_split(read(spark, d, "events"), "user_id", [c("ts").desc(), c("event_id").desc()], "value").select("user_id", *[R(x, 7).alias(x) for x in ("recent", "rest", "change")])


def keep_last_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return T.keep_last(read(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [c("ts"), c("event_id")]).select("user_id", "event_type", "event_id", "value")


def corrected_player_weeks(spark: SparkSession, d: str) -> DataFrame:
    """The last loaded row of every resolved player-game."""
    w = read(spark, d, "player_weeks").where(c("player_id") != "00-0000000")
    best = w.groupBy("player_id", "season", "week").agg(F.max_by(F.struct("week_row_id", "fantasy_points"), F.struct("loaded_at", "week_row_id")).alias("b"), F.count(F.lit(1)).alias("loads"))
    return best.select("player_id", "season", "week", "loads", "b.week_row_id")


def unpivot_sides(spark: SparkSession, d: str) -> DataFrame:
    """One game row as two team rows, and what each team allowed."""
    sides = F.inline(F.array(F.struct(c("l_suppkey").alias("team"), c("l_partkey").alias("opponent"), c("l_quantity").alias("points"), c("l_tax").alias("allowed")), F.struct(c("l_partkey").alias("team"), c("l_suppkey").alias("opponent"), c("l_tax").alias("points"), c("l_quantity").alias("allowed"))))
    return read(spark, d, "lineitem").select(sides).groupBy("team").agg(F.count(F.lit(1)).alias("games"), R(F.sum("points"), 4).alias("points"), R(F.sum("allowed"), 4).alias("allowed"))


def team_totals_returning_share(spark: SparkSession, d: str) -> DataFrame:
    """What share of last season's team total the players still there hold."""
    s = _seasons(spark, d).where("recent_team is not null").select("player_id", "season", "recent_team", "fantasy_points_ppr", "games")
    totals = s.groupBy("recent_team", "season").agg(F.sum("fantasy_points_ppr").alias("total"), F.max("games").alias("games"))
    now = s.select("player_id", c("season").alias("now"), c("recent_team").alias("now_team"))
    kept = s.join(now, "player_id").where((c("now") == c("season") + 1) & (c("now_team") == c("recent_team"))).groupBy("recent_team", "season").agg(F.sum("fantasy_points_ppr").alias("kept"))
    return totals.join(kept, ["recent_team", "season"], "left").select("recent_team", "season", "games", R(S.clamp(F.coalesce("kept", F.lit(0.0)) / F.nullif(F.col("total"), F.lit(0.0))), 7).alias("returning_share"))


def rollup_min_weeks_array(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    out = w.groupBy("l_partkey", "season").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("weeks"), F.array_join(F.transform(F.array_sort(F.collect_list("week")), lambda x: x.cast("string")), ",").alias("list"))
    return out.where("weeks >= 4")


def weighted_ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    share = c("l_discount") + 0.01
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(R(F.sum("l_quantity") / F.sum(c("l_quantity") / share), 8).alias("share"))


def distinct_week_shares(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("day", F.dayofyear("ts"))
    kinds = ("click", "view", "purchase")
    return e.groupBy("user_id").agg(F.countDistinct("day").alias("days"), *[R(F.countDistinct(F.when(c("event_type") == k, c("day"))) / F.greatest(F.lit(1), F.max("day")), 8).alias(k) for k in kinds])


def group_exclusion_zero_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rows of suppliers and weeks whose rate of zero outcomes is not suspiciously high."""
    x = read(spark, d, "lineitem").withColumn("season", F.year("l_shipdate")).withColumn("month", F.month("l_shipdate"))
    zero = F.avg((c("l_discount") < 0.03).cast("double"))
    good = x.groupBy("l_suppkey", "season", "month").agg(zero.alias("rate"), F.count(F.lit(1)).alias("n")).where("rate <= 0.65")
    return good.select("l_suppkey", "season", "month", "n", R("rate", 8).alias("rate"))


def debut_season(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "player_weeks").where(c("player_id") != "00-0000000")
    first = w.groupBy("player_id").agg(F.min("season").alias("debut"))
    return w.select("player_id", "season").distinct().join(first, "player_id").select("player_id", "season", (c("season") == c("debut")).alias("rookie"))


def empirical_shrink_predict(spark: SparkSession, d: str) -> DataFrame:
    """Recency-weighted rate pulled to the overall mean by the games behind it."""
    lag = T.season_lags(_seasons(spark, d).select("player_id", "season", "games", (c("fantasy_points_ppr") / F.greatest(F.lit(1), c("games"))).alias("rate")), ["player_id"], "season", ["rate", "games"])
    # fixed values: weights of the last three seasons
    rate = S.weighted_present([c("rate_lag1"), c("rate_lag2"), c("rate_lag3")], [0.60, 0.27, 0.13])
    games = F.coalesce("games_lag1", F.lit(0)) + F.coalesce("games_lag2", F.lit(0)) + F.coalesce("games_lag3", F.lit(0))
    trust = games / (games + 12.0)
    return lag.select("player_id", "season", R(S.clamp(trust * F.coalesce(rate, F.lit(6.0)) + (1 - trust) * 6.0, -2.0, 35.0), 8).alias("predicted"))


def season_ratio_shrink(spark: SparkSession, d: str) -> DataFrame:
    """Player factor against projections, shrunk to 1 and kept within .65 and 1.45."""
    w = read(spark, d, "player_weeks").where((c("player_id") != "00-0000000") & c("projected").isNotNull() & ~F.isnan("projected") & c("fantasy_points").isNotNull() & ~F.isnan("fantasy_points") & (F.abs("fantasy_points") < 100))
    y = w.groupBy("player_id", "season").agg(F.sum("projected").alias("p"), F.sum("fantasy_points").alias("a"), F.count(F.lit(1)).alias("weeks"))
    weight = F.pow(F.lit(0.7), (F.lit(2025) - c("season")).cast("double"))
    t = y.groupBy("player_id").agg(F.sum(weight * c("a")).alias("a"), F.sum(weight * c("p")).alias("p"), (F.sum("p") / F.sum("weeks")).alias("mean"))
    e = 6 * F.greatest(F.lit(1.0), c("mean"))
    return t.select("player_id", R(S.clamp((c("a") + e) / (c("p") + e), 0.65, 1.45), 8).alias("factor"))


_SEASONS = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY version_no DESC, recorded_at DESC, stat_row_id DESC) AS rn FROM player_seasons) WHERE rn = 1)"
_YEARS = "y AS (SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS season, avg(l_extendedprice) AS points FROM lineitem GROUP BY 1, 2)"


def _lags(table: str, key: str, value: str) -> str:
    joins = " ".join(f"LEFT JOIN {table} b{k} ON b{k}.{key} = a.{key} AND b{k}.season = a.season - {k}" for k in (1, 2, 3))
    return f"SELECT a.{key}, a.season, {', '.join(f'b{k}.{value} AS {value}{k}' for k in (1, 2, 3))} FROM {table} a {joins}"


def _ewma(v: str) -> str:
    top = " + ".join(f"coalesce({v}{k} * {w}::DOUBLE, 0)" for k, w in ((1, 0.6), (2, 0.27), (3, 0.13)))
    low = " + ".join(f"CASE WHEN {v}{k} IS NULL THEN 0 ELSE {w}::DOUBLE END" for k, w in ((1, 0.6), (2, 0.27), (3, 0.13)))
    return f"({top}) / nullif({low}, 0)"


QUERIES = {f.__name__: f for f in (latest_player_seasons, season_lag_join, ewma_present_lags, per_game_rates, asof_last_before_cutoff, first_snapshot_per_season, latest_eligible_per_series, history_weighted_theta, tenure_islands, last_k_vs_rest, keep_last_dedupe, corrected_player_weeks, unpivot_sides, team_totals_returning_share, rollup_min_weeks_array, weighted_ratio_of_sums, distinct_week_shares, group_exclusion_zero_rate, debut_season, empirical_shrink_predict, season_ratio_shrink)}
ORACLE = {
    "latest_player_seasons": f"WITH {_SEASONS} SELECT player_id, season, version_no, games, stat_row_id FROM s",
    "season_lag_join": f"WITH {_SEASONS}, l AS ({_lags('s', 'player_id', 'games')}) SELECT player_id, season, games1 AS games_lag1, games2 AS games_lag2, games3 AS games_lag3 FROM l",
    "ewma_present_lags": f"WITH {_YEARS}, l AS ({_lags('y', 'l_partkey', 'points')}) SELECT l_partkey, season, round({_ewma('points')}, 8) AS ewma, round(coalesce(points1 - points2, 0), 8) AS trend FROM l",
    "per_game_rates": f"WITH {_SEASONS} SELECT player_id, season, round(fantasy_points_ppr / greatest(1, games), 6) AS ppg FROM s",
    "asof_last_before_cutoff": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts < TIMESTAMP '2024-01-15') WHERE rn = 1",
    "first_snapshot_per_season": "SELECT o_custkey, season, o_orderkey, o_totalprice FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS season, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "latest_eligible_per_series": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-20') WHERE rn = 1",
    "history_weighted_theta": """WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
      SELECT a.o_custkey, a.season, count(*) AS seasons, round(sum(pow(0.65::DOUBLE, a.season - b.season) * b.v) / sum(pow(0.65::DOUBLE, a.season - b.season)), 7) AS history FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.season < a.season GROUP BY 1, 2""",
    "tenure_islands": """WITH y AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders), r AS (SELECT *, season - row_number() OVER (PARTITION BY o_custkey ORDER BY season) AS run FROM y)
      SELECT o_custkey, season, CAST(row_number() OVER (PARTITION BY o_custkey, run ORDER BY season) AS INTEGER) AS tenure FROM r""",
    "last_k_vs_rest": """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
      SELECT user_id, round(avg(value) FILTER (n <= 6), 7) AS recent, round(avg(value) FILTER (n > 6), 7) AS rest, round(avg(value) FILTER (n <= 6) - avg(value) FILTER (n > 6), 7) AS change FROM r GROUP BY 1""",
    "keep_last_dedupe": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "corrected_player_weeks": "SELECT player_id, season, week, loads, week_row_id FROM (SELECT *, count(*) OVER (PARTITION BY player_id, season, week) AS loads, row_number() OVER (PARTITION BY player_id, season, week ORDER BY loaded_at DESC NULLS LAST, week_row_id DESC) AS rn FROM player_weeks WHERE player_id <> '00-0000000') WHERE rn = 1",
    "unpivot_sides": "WITH t AS (SELECT l_suppkey AS team, l_quantity AS points, l_tax AS allowed FROM lineitem UNION ALL SELECT l_partkey, l_tax, l_quantity FROM lineitem) SELECT team, count(*) AS games, round(sum(points), 4) AS points, round(sum(allowed), 4) AS allowed FROM t GROUP BY 1",
    "team_totals_returning_share": f"""WITH {_SEASONS}, t AS (SELECT recent_team, season, sum(fantasy_points_ppr) AS total, max(games) AS games FROM s WHERE recent_team IS NOT NULL GROUP BY 1, 2),
      k AS (SELECT a.recent_team, a.season, sum(a.fantasy_points_ppr) AS kept FROM s a JOIN s b ON a.player_id = b.player_id AND b.season = a.season + 1 AND b.recent_team = a.recent_team GROUP BY 1, 2)
      SELECT recent_team, season, games, round(CASE WHEN total <> 0 THEN least(greatest(coalesce(kept, 0) / total, 0), 1) ELSE 0 END, 7) AS returning_share FROM t LEFT JOIN k USING (recent_team, season)""",
    "rollup_min_weeks_array": """WITH w AS (SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS season, month(l_shipdate) AS week, count(*) AS n FROM lineitem GROUP BY ALL)
      SELECT l_partkey, season, CAST(sum(n) AS BIGINT) AS n, count(*) AS weeks, string_agg(CAST(week AS VARCHAR), ',' ORDER BY week) AS list FROM w GROUP BY 1, 2 HAVING count(*) >= 4""",
    "weighted_ratio_of_sums": "SELECT l_suppkey, round(sum(l_quantity) / sum(l_quantity / (l_discount + 0.01::DOUBLE)), 8) AS share FROM lineitem GROUP BY 1",
    "distinct_week_shares": "WITH e AS (SELECT *, dayofyear(ts) AS day FROM events) SELECT user_id, count(DISTINCT day) AS days, " + ", ".join(f"round(count(DISTINCT day) FILTER (event_type = '{k}') / greatest(1, max(day)), 8) AS {k}" for k in ("click", "view", "purchase")) + " FROM e GROUP BY 1",
    "group_exclusion_zero_rate": "SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS season, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS n, round(avg(CAST(l_discount < 0.03::DOUBLE AS DOUBLE)), 8) AS rate FROM lineitem GROUP BY 1, 2, 3 HAVING avg(CAST(l_discount < 0.03::DOUBLE AS DOUBLE)) <= 0.65",
    "debut_season": "WITH w AS (SELECT DISTINCT player_id, season FROM player_weeks WHERE player_id <> '00-0000000') SELECT player_id, season, season = min(season) OVER (PARTITION BY player_id) AS rookie FROM w",
    "empirical_shrink_predict": f"""WITH {_SEASONS}, r AS (SELECT player_id, season, games, fantasy_points_ppr / greatest(1, games) AS rate FROM s), a AS ({_lags('r', 'player_id', 'rate')}), b AS ({_lags('r', 'player_id', 'games')}),
      j AS (SELECT a.*, coalesce(games1, 0) + coalesce(games2, 0) + coalesce(games3, 0) AS g FROM a JOIN b USING (player_id, season))
      SELECT player_id, season, round(least(greatest(g / (g + 12.0::DOUBLE) * coalesce({_ewma('rate')}, 6) + (1 - g / (g + 12.0::DOUBLE)) * 6, -2), 35), 8) AS predicted FROM j""",
    "season_ratio_shrink": """WITH y AS (SELECT player_id, season, sum(projected) AS p, sum(fantasy_points) AS a, count(*) AS w FROM player_weeks WHERE player_id <> '00-0000000' AND projected IS NOT NULL AND NOT isnan(projected) AND fantasy_points IS NOT NULL AND NOT isnan(fantasy_points) AND abs(fantasy_points) < 100 GROUP BY 1, 2),
      t AS (SELECT player_id, sum(pow(0.7::DOUBLE, 2025 - season) * a) AS a, sum(pow(0.7::DOUBLE, 2025 - season) * p) AS p, 6 * greatest(1, sum(p) / sum(w)) AS e FROM y GROUP BY 1)
      SELECT player_id, round(least(greatest((a + e) / (p + e), 0.65::DOUBLE), 1.45::DOUBLE), 8) AS factor FROM t""",
}
