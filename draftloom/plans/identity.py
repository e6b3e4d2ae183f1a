"""Queries on identities, sets and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import identity as I
from draftloom.session import read

c = F.col


def name_key_first_last():  # noqa: ANN201
    """initial:surname of a plain name."""
    words = F.split(F.regexp_replace(F.lower(c("name")), r"\s+(jr|sr|ii|iii|iv|v)\.?$", ""), " ")
    return F.concat(F.substring(words[0], 1, 1), F.lit(":"), F.element_at(words, -1))


def identity_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Seasons' names to roster ids: by id, then by unique name and position, then by unique initial and surname."""
    roster = read(spark, d, "players").where(c("name").isNotNull()).select("player_id", S.ascii_key(c("name")).alias("nk"), name_key_first_last().alias("ik"), F.upper("position").alias("position"))
    roster = roster.groupBy("player_id").agg(F.max(F.struct("nk", "ik", "position")).alias("x")).select("player_id", "x.*").withColumn("np", F.concat_ws("|", "nk", "position"))
    seen = read(spark, d, "source_listings").where(c("name").isNotNull()).select("listing_id", S.ascii_key(c("name")).alias("snk"), name_key_first_last().alias("sik"), F.upper("position").alias("sp"))
    seen = seen.withColumn("snp", F.concat_ws("|", "snk", "sp"))
    return I.cascade(seen, roster, "listing_id", "player_id", [("name_position", "snp", "np"), ("name", "snk", "nk"), ("initial_surname", "sik", "ik")])


def identity_ambiguous_fail_closed(spark: SparkSession, d: str) -> DataFrame:
    return I.fail_closed(read(spark, d, "part"), "p_name", "p_brand")


def alias_first_wins(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.explode(F.array(F.struct(c("p_partkey").cast("string").alias("alias"), F.lit(0).alias("kind")), F.struct(F.concat_ws(":", "p_brand", c("p_size").cast("string")).alias("alias"), F.lit(1).alias("kind")))).alias("a"))
    return I.first_writer(p.select("p_partkey", "a.*"), "alias", ["kind", "p_partkey"], "p_partkey")


def strongest_record_merge(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return I.strongest(e, "user_id", [(c("event_type") == "purchase").cast("int"), c("value"), c("ts"), c("event_id")], ["event_id", "event_type", "value"])


def greedy_union_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """Listings in order, each source player and each name once."""
    x = read(spark, d, "source_listings").where("name is not null").select("listing_id", S.ascii_key(c("name")).alias("nk"), F.concat("source_id", F.lit(":"), c("source_player_id")).alias("bk"))
    return I.greedy_union(x, "listing_id", "nk", "bk").select("listing_id")


def zero_row_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """Roster players without any season get a row of zeros."""
    roster = read(spark, d, "players").select("player_id", c("rookie_season").alias("season")).where("season is not null").distinct()
    seen = read(spark, d, "player_seasons").select("player_id", "season", c("games").cast("long").alias("games")).groupBy("player_id", "season").agg(F.max("games").alias("games"))
    missing = roster.join(seen.select("player_id").distinct(), "player_id", "left_anti").select("player_id", "season", F.lit(0).cast("long").alias("games"))
    return seen.withColumn("synthetic", F.lit(False)).unionByName(missing.withColumn("synthetic", F.lit(True)))


def bounded_population(spark: SparkSession, d: str) -> DataFrame:
    """Every example once, with the season's total or nought."""
    total = read(spark, d, "player_seasons").groupBy("player_id", "season").agg(F.max("fantasy_points_ppr").alias("total"))
    return read(spark, d, "player_examples").select("example_id", "player_id", "season").join(total, ["player_id", "season"], "left").select("example_id", F.coalesce("total", F.lit(0.0)).alias("total"))


def salted_hash_join(spark: SparkSession, d: str) -> DataFrame:
    """A join of two tables that show each other only salted digests of their keys."""
    digest = lambda x: F.sha2(F.concat(F.lit("salt-1"), F.lit("|"), x.cast("string")), 256)
    a = read(spark, d, "customer").select(digest(c("c_custkey")).alias("h"), "c_mktsegment")
    b = read(spark, d, "orders").select(digest(c("o_custkey")).alias("h"), "o_totalprice")
    return a.join(b, "h").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def set_churn(spark: SparkSession, d: str) -> DataFrame:
    """Players a team kept, added and lost from one season to the next."""
    r = read(spark, d, "player_seasons").where("recent_team is not null").groupBy(c("recent_team").alias("team"), "season").agg(F.collect_set("player_id").alias("now"))
    b = r.select("team", (c("season") + 1).alias("season"), c("now").alias("before"))
    return r.join(b, ["team", "season"]).select("team", "season", F.size(F.array_intersect("now", "before")).alias("kept"), F.size(F.array_except("now", "before")).alias("added"), F.size(F.array_except("before", "now")).alias("lost"))


def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "player_seasons").select("player_id", "season", "games")
    b = read(spark, d, "player_examples").select("player_id", "season", "age")
    return a.unionByName(b, allowMissingColumns=True).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count("games").alias("games"), F.count("age").alias("ages"))


def index_intersection(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "player_seasons").select("player_id").intersect(read(spark, d, "player_examples").select("player_id")).intersect(read(spark, d, "players").select("player_id"))


def full_outer_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Roster and seen teams merged, live values first."""
    p = read(spark, d, "players").groupBy("player_id").agg(F.max_by("team", F.struct("updated_at", "roster_row_id")).alias("roster_team"))
    s = read(spark, d, "player_seasons").groupBy("player_id").agg(F.max_by("recent_team", F.struct("season", "version_no", "recorded_at", "stat_row_id")).alias("seen_team"))
    return p.join(s, "player_id", "full").select("player_id", F.coalesce("roster_team", "seen_team").alias("team"), c("seen_team").isNull().alias("unseen"))


def common_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Players that all three outside sources list."""
    x = read(spark, d, "source_listings").where("name is not null").select(S.ascii_key(c("name")).alias("nk"), "source_id").distinct()
    return x.groupBy("nk").agg(F.count(F.lit(1)).alias("sources")).where("sources = 3").select("nk")


def decision_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return I.adjacent_pairs(p, ["p_type"], [c("p_retailprice").desc(), c("p_partkey")], "p_partkey", "p_retailprice", 0.5)


def position_canonical(spark: SparkSession, d: str) -> DataFrame:
    up = F.upper(F.trim("position"))
    canon = F.when(up.isin("D/ST", "DEF"), "DST").when(up == "PK", "K").when(up.isin("FB", "HB"), "RB").otherwise(up)
    return read(spark, d, "player_weeks").groupBy(canon.alias("position")).agg(F.count(F.lit(1)).alias("n"))


def stable_identity(spark: SparkSession, d: str) -> DataFrame:
    pid = c("player_id")
    kind = F.when(pid.rlike(r"^00-\d{7}$"), "gsis").when(pid.startswith("ESPN:"), "espn").otherwise("name")
    return read(spark, d, "players").select("roster_row_id", F.when(kind == "name", F.concat(F.lit("NAME:"), S.ascii_key(c("name")))).otherwise(pid).alias("identity"), kind.alias("kind"))


def search_board(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "players").where(F.lower(F.concat_ws(" ", "name", "team")).contains("gra")).select("roster_row_id", "name", "team")


_KEY = "regexp_replace(regexp_replace(lower(strip_accents({0})), '\\s+(jr|sr|ii|iii|iv|v)\\.?$', ''), '[^a-z0-9]', '', 'g')"
_INIT = "concat(substr(split_part(regexp_replace(lower({0}), '\\s+(jr|sr|ii|iii|iv|v)\\.?$', ''), ' ', 1), 1, 1), ':', list_last(string_split(regexp_replace(lower({0}), '\\s+(jr|sr|ii|iii|iv|v)\\.?$', ''), ' ')))"


def _method(rank: int, name: str, lk: str, rk: str) -> str:
    return f"""SELECT a.listing_id, b.player_id, '{name}' AS method, {rank} AS rank FROM (SELECT {lk} AS k, min(listing_id) AS listing_id FROM seen WHERE {lk} IS NOT NULL GROUP BY 1 HAVING count(*) = 1) a
      JOIN (SELECT {rk} AS k, min(player_id) AS player_id FROM roster WHERE {rk} IS NOT NULL GROUP BY 1 HAVING count(*) = 1) b USING (k)"""


QUERIES = {f.__name__: f for f in (identity_cascade, identity_ambiguous_fail_closed, alias_first_wins, strongest_record_merge, greedy_union_two_keys, zero_row_synthesis, bounded_population, salted_hash_join, set_churn, union_missing_columns, index_intersection, full_outer_catalog, common_cohort, decision_pairs, position_canonical, stable_identity, search_board)}
ORACLE = {
    "identity_cascade": f"""WITH roster AS (SELECT player_id, x.nk, x.ik, x.p AS position, concat_ws('|', x.nk, x.p) AS np FROM (SELECT player_id, max({{'nk': {_KEY.format("name")}, 'ik': {_INIT.format("name")}, 'p': upper(position)}}) AS x FROM players WHERE name IS NOT NULL GROUP BY 1)),
      seen AS (SELECT listing_id, {_KEY.format("name")} AS snk, {_INIT.format("name")} AS sik, concat_ws('|', {_KEY.format("name")}, upper(position)) AS snp FROM source_listings WHERE name IS NOT NULL),
      m AS ({_method(0, "name_position", "snp", "np")} UNION ALL {_method(1, "name", "snk", "nk")} UNION ALL {_method(2, "initial_surname", "sik", "ik")})
      SELECT listing_id, arg_min(player_id, rank) AS player_id, arg_min(method, rank) AS method FROM m GROUP BY 1""",
    "identity_ambiguous_fail_closed": "SELECT p_name, count(*) AS claims, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS resolved FROM part GROUP BY 1",
    "alias_first_wins": "WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS alias, 0 AS kind, p_partkey FROM part UNION ALL SELECT concat(p_brand, ':', p_size), 1, p_partkey FROM part) SELECT alias, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY kind, p_partkey) AS rn FROM a) WHERE rn = 1",
    "strongest_record_merge": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, value DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "zero_row_synthesis": """WITH s AS (SELECT player_id, season, CAST(max(games) AS BIGINT) AS games FROM player_seasons GROUP BY 1, 2)
      SELECT *, false AS synthetic FROM s UNION ALL SELECT DISTINCT player_id, rookie_season, CAST(0 AS BIGINT), true FROM players WHERE rookie_season IS NOT NULL AND player_id NOT IN (SELECT player_id FROM s)""",
    "bounded_population": "SELECT example_id, coalesce(total, 0) AS total FROM player_examples LEFT JOIN (SELECT player_id, season, max(fantasy_points_ppr) AS total FROM player_seasons GROUP BY 1, 2) USING (player_id, season)",
    "salted_hash_join": "SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON sha256('salt-1|' || c_custkey) = sha256('salt-1|' || o_custkey) GROUP BY 1",
    "set_churn": """WITH r AS (SELECT DISTINCT recent_team AS team, season, player_id FROM player_seasons WHERE recent_team IS NOT NULL), t AS (SELECT DISTINCT team, season FROM r),
      p AS (SELECT a.team, a.season FROM t a JOIN t b ON a.team = b.team AND b.season = a.season - 1)
      SELECT p.team, p.season, CAST(count(*) FILTER (n IS NOT NULL AND b IS NOT NULL) AS INTEGER) AS kept, CAST(count(*) FILTER (b IS NULL) AS INTEGER) AS added, CAST(count(*) FILTER (n IS NULL) AS INTEGER) AS lost
      FROM p JOIN (SELECT coalesce(x.team, y.team) AS team, coalesce(x.season, y.season + 1) AS season, x.player_id AS n, y.player_id AS b FROM r x FULL JOIN r y ON x.team = y.team AND x.season = y.season + 1 AND x.player_id = y.player_id) USING (team, season) GROUP BY 1, 2""",
    "union_missing_columns": "SELECT season, count(*) AS n, count(games) AS games, count(age) AS ages FROM (SELECT season, games, NULL AS age FROM player_seasons UNION ALL SELECT season, NULL, age FROM player_examples) GROUP BY 1",
    "index_intersection": "SELECT player_id FROM player_seasons INTERSECT SELECT player_id FROM player_examples INTERSECT SELECT player_id FROM players",
    "full_outer_catalog": """WITH p AS (SELECT player_id, team FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY updated_at DESC, roster_row_id DESC) AS rn FROM players) WHERE rn = 1),
      s AS (SELECT player_id, recent_team, true AS seen FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, version_no DESC, recorded_at DESC, stat_row_id DESC) AS rn FROM player_seasons) WHERE rn = 1)
      SELECT player_id, coalesce(team, recent_team) AS team, recent_team IS NULL AS unseen FROM p FULL JOIN s USING (player_id)""",
    "common_cohort": f"SELECT nk FROM (SELECT DISTINCT {_KEY.format('name')} AS nk, source_id FROM source_listings WHERE name IS NOT NULL) GROUP BY 1 HAVING count(*) = 3",
    "decision_pairs": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) - 1 AS n FROM part)
      SELECT a.p_type, a.p_partkey AS first, b.p_partkey AS second, a.p_retailprice AS first_value, b.p_retailprice AS second_value FROM r a JOIN r b ON a.p_type = b.p_type AND a.n % 2 = 0 AND b.n = a.n + 1 AND abs(a.p_retailprice - b.p_retailprice) <= 0.5""",
    "position_canonical": "SELECT CASE WHEN u IN ('D/ST', 'DEF') THEN 'DST' WHEN u = 'PK' THEN 'K' WHEN u IN ('FB', 'HB') THEN 'RB' ELSE u END AS position, count(*) AS n FROM (SELECT upper(trim(position)) AS u FROM player_weeks) GROUP BY 1",
    "stable_identity": f"SELECT roster_row_id, CASE WHEN regexp_matches(player_id, '^00-\\d{{7}}$') OR player_id LIKE 'ESPN:%' THEN player_id ELSE concat('NAME:', {_KEY.format('name')}) END AS identity, CASE WHEN regexp_matches(player_id, '^00-\\d{{7}}$') THEN 'gsis' WHEN player_id LIKE 'ESPN:%' THEN 'espn' ELSE 'name' END AS kind FROM players",
    "search_board": "SELECT roster_row_id, name, team FROM players WHERE contains(lower(concat_ws(' ', name, team)), 'gra')",
}
