"""Ordering, frontier, identity and audit details of the board and its feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import decision as D
from draftloom.operators import ranks
from draftloom.plans.board import _LIST, _listings
from draftloom.plans.temporal import _SEASONS, _seasons
from draftloom.session import read

c = F.col
R = lambda x, n=6: F.round(x, n)
CORE = ("QB", "RB", "WR", "TE")


def excluded_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of weeks that can be used: weeks in which more than a third of the outcomes are nought are left out whole."""
    x = read(spark, d, "player_weeks").where("fantasy_points is not null and not isnan(fantasy_points) and season is not null and week is not null")
    bad = x.groupBy("season", "week").agg(F.avg((c("fantasy_points") == 0).cast("double")).alias("zeros")).where(c("zeros") > 1.0 / 3).select("season", "week")
    return x.join(F.broadcast(bad), ["season", "week"], "left_anti").select("week_row_id", "season", "week")


def board_final_order(spark: SparkSession, d: str) -> DataFrame:
    """The whole board's order: decided listings by their rank, the rest after them by mean, then name, then id."""
    known = lambda v: F.when(~F.isnan(v), c(v))
    x = read(spark, d, "source_listings").select("listing_id", F.when(known("adp").between(1, 100), known("adp")).alias("decision"), known("mean").alias("mean"), "name")
    return ranks.placed(x, [], [c("decision").asc_nulls_last(), c("mean").desc_nulls_last(), c("name").asc_nulls_last(), c("listing_id")]).select("listing_id", "place")


def standings(spark: SparkSession, d: str) -> DataFrame:
    """Teams of a season by wins, ties, points and name, from the totals of their players week by week."""
    x = read(spark, d, "player_weeks").where("team is not null and opponent_team is not null and season is not null and week is not null and fantasy_points is not null and not isnan(fantasy_points) and abs(fantasy_points) < 100")
    g = x.groupBy("season", "week", "team").agg(F.round(F.sum("fantasy_points")).alias("points"), F.min("opponent_team").alias("opponent"))
    o = g.select("season", "week", c("team").alias("opponent"), c("points").alias("against"))
    t = g.join(o, ["season", "week", "opponent"]).groupBy("season", "team").agg(F.count_if(c("points") > c("against")).alias("wins"), F.count_if(c("points") == c("against")).alias("ties"), F.sum("points").alias("points"))
    # a season has as many rows as teams
    w = Window.partitionBy("season").orderBy(c("wins").desc(), c("ties").desc(), c("points").desc(), "team")
    return t.select("season", "team", "wins", "ties", "points", F.row_number().over(w).alias("place"))


def rollout_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Eighteen candidates of each source by an ordered union of pickers: the best of each core position, the best eight,
    two more of each position, the best ceiling and the best range of each, then the rest by mean; each once."""
    x = _listings(spark, d).where(c("position").isin(*CORE))
    by = lambda k: [c(k).desc(), c("listing_id")]
    range_ = x.withColumn("asym", c("ceiling") + 0.5 * (c("ceiling") - c("mean"))).withColumn("raw", c("mean") + c("floor") + c("ceiling"))
    pick = lambda rows, n, keep: rows.select("source_id", "listing_id", "mean", F.lit(n).alias("picker"), keep.alias("within"))
    at = ["source_id", "position"]
    first = D.top_k(x, at, by("mean"), 1)
    top = D.top_k(x, ["source_id"], by("mean"), 8)
    two = D.top_k(x, at, by("mean"), 2)
    asym, raw = D.top_k(range_, at, by("asym"), 1), D.top_k(range_, at, by("raw"), 1)
    rest = D.top_k(x, ["source_id"], by("mean"), 18)
    parts = [pick(first, 0, -c("mean")), pick(top, 1, -c("mean")), pick(two, 2, -c("mean")), pick(raw, 3, -c("mean")), pick(asym, 4, -c("mean")), pick(rest, 5, -c("mean"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.groupBy("source_id", "listing_id").agg(F.min(F.struct("picker", "within")).alias("o"))
    return D.top_k(once, ["source_id"], [c("o.picker"), c("o.within"), c("listing_id")], 18).select("source_id", "listing_id", c("o.picker").alias("picker"), "place")


def canonical_json_digest(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of a record's JSON with its keys in order: the same record gives the same digest however it was written."""
    x = read(spark, d, "players").select("roster_row_id", F.coalesce("player_id", F.lit("")).alias("player_id"), F.coalesce(c("rookie_season").cast("string"), F.lit("")).alias("rookie"), F.coalesce("team", F.lit("")).alias("team"))
    return x.select("roster_row_id", F.sha2(F.to_json(F.struct(*[c(k) for k in sorted(("team", "player_id", "rookie"))])), 256).alias("digest"))


def mulberry(seed: Column, k: Column) -> Column:
    """Draw k (from 1) of the 32-bit stream of a seed: its state is the seed plus k steps, so any draw is made alone."""
    mask = F.lit(S.MASK).cast("long")
    state = (seed.cast("long") + S.mul32(k.cast("long"), 0x6D2B79F5)).bitwiseAND(mask)
    t = S.let(state, lambda a: S.mul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long"))))
    t = S.let(t, lambda a: a.bitwiseXOR((a + S.mul32(a.bitwiseXOR(F.shiftright(a, 7)), a.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask)))
    return S.let(t, lambda a: a.bitwiseXOR(F.shiftright(a, 14))) / 4294967296.0


def mulberry_stream(spark: SparkSession, d: str) -> DataFrame:
    """Twenty draws of the stream of every part's key."""
    x = read(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"))
    return x.select("p_partkey", "k", R(mulberry(c("p_partkey"), c("k")), 12).alias("u"))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_entities(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their entities replaced, the ampersand last so that nothing is replaced twice."""
    text = c("text")
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.length(text).alias("length"), F.md5(text).alias("digest"))


def repeated_absence(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of weeks in a row that a player was not active, per season."""
    x = read(spark, d, "player_weeks").where("player_id <> '00-0000000' and season is not null and week is not null and outcome_status is not null")
    w = x.groupBy("player_id", "season", "week").agg(F.bool_and(c("outcome_status") != "active-observed").alias("out")).where("out")
    at = Window.partitionBy("player_id", "season").orderBy("week")
    run = w.withColumn("island", c("week") - F.row_number().over(at)).groupBy("player_id", "season", "island").agg(F.count(F.lit(1)).alias("n"))
    return run.groupBy("player_id", "season").agg(F.max("n").alias("longest"), F.sum("n").alias("weeks"))


def vacated_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of a team's targets of the season before that belonged to players who are on it no more."""
    s = _seasons(spark, d).where("recent_team is not null").select("player_id", "season", c("recent_team").alias("team"), F.coalesce("targets", F.lit(0)).alias("targets"))
    now = s.select("player_id", "season", "team", F.lit(1).alias("stays"))
    before = s.select("player_id", (c("season") + 1).alias("season"), "team", "targets")
    teams = s.select("season", "team").distinct()
    x = before.join(teams, ["season", "team"]).join(now, ["player_id", "season", "team"], "left")
    g = x.groupBy("team", "season").agg(F.sum(F.when(c("stays").isNull(), c("targets")).otherwise(0)).alias("gone"), F.sum("targets").alias("all"), F.count_if(c("stays").isNull()).alias("left"))
    return g.select("team", "season", "left", R(F.when(c("all") > 0, c("gone") / c("all"))).alias("vacated"))


def team_tie_break(spark: SparkSession, d: str) -> DataFrame:
    """Listings matched by name and position; of several players the one on the listed team, if only one is; a player that
    two listings of a source claim goes to neither."""
    key = S.ascii_key(c("name"))
    p = read(spark, d, "players").where("name is not null and player_id is not null and player_id <> '00-0000000'").groupBy("player_id").agg(F.min(key).alias("nk"), F.min(F.upper("position")).alias("pos"), F.min(F.upper("team")).alias("p_team")).where("nk <> ''")
    x = read(spark, d, "source_listings").where("name is not null and position is not null").select("listing_id", "source_id", key.alias("nk"), F.upper("position").alias("pos"), F.upper("team").alias("team")).where("nk <> ''")
    m = x.join(p, ["nk", "pos"]).groupBy("listing_id", "source_id").agg(F.count(F.lit(1)).alias("n"), F.min("player_id").alias("only"), F.count_if(c("team") == c("p_team")).alias("same"), F.min(F.when(c("team") == c("p_team"), c("player_id"))).alias("by_team"))
    one = m.withColumn("player_id", F.when(c("n") == 1, c("only")).when(c("same") == 1, c("by_team"))).where("player_id is not null")
    claims = one.groupBy("source_id", "player_id").agg(F.count(F.lit(1)).alias("claims"))
    return one.join(claims, ["source_id", "player_id"]).where("claims = 1").select("listing_id", "player_id", F.when(c("n") == 1, "name").otherwise("team").alias("method"))


def snapshot_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Whether a source's snapshot is sound: rows, identities, repeats, and the share of noughts and of missing means."""
    known = F.when(~F.isnan("mean"), c("mean"))
    x = read(spark, d, "source_listings").groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source_player_id").alias("identities"), F.avg((F.coalesce(known, F.lit(0.0)) == 0).cast("double")).alias("zero"), F.avg(known.isNull().cast("double")).alias("missing"), F.countDistinct("team").alias("teams"))
    return x.select("source_id", "rows", "identities", "teams", R("zero").alias("zero"), R("missing").alias("missing"))


def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How far off the order was: last season's points against this one's, by season and position; was the first the first?"""
    s = _seasons(spark, d).where("position is not null and fantasy_points_ppr is not null and not isnan(fantasy_points_ppr)").select("player_id", "season", "position", c("fantasy_points_ppr").alias("actual"))
    x = s.join(s.select("player_id", (c("season") + 1).alias("season"), c("actual").alias("was")), ["player_id", "season"])
    group = ["season", "position"]
    a = ranks.placed(x, group, [c("actual").desc(), c("player_id")], "ra")
    b = ranks.placed(x, group, [c("was").desc(), c("player_id")], "rb").select(*group, "player_id", "rb")
    j = a.join(b, [*group, "player_id"])
    return j.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.abs(c("ra") - c("rb")))).alias("rank_mae"), F.bool_or((c("ra") == 1) & (c("rb") == 1)).alias("top"))


def move_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether a player changed teams since the season before, is new, or stands first or low on the depth chart."""
    x = read(spark, d, "player_examples").where("player_id is not null and season is not null")
    last = x.where("team is not null").groupBy("player_id", (c("season") + 1).alias("season")).agg(F.min("team").alias("was"))
    rank = F.when(~F.isnan("depth_rank"), c("depth_rank"))
    y = x.join(last, ["player_id", "season"], "left")
    return y.select("example_id", (c("team").isNotNull() & c("was").isNotNull() & (c("team") != c("was"))).alias("moved"), (c("experience") == 0).alias("rookie"), F.coalesce(rank == 1, F.lit(False)).alias("first"), F.coalesce(rank > 3, F.lit(False)).alias("deep"))


def rate_features(spark: SparkSession, d: str) -> DataFrame:
    """Rates whose denominators may be nought: per game, per target and per touch; null where there is nothing to divide by."""
    s = _seasons(spark, d)
    known = lambda v: F.when(~F.isnan(v), c(v))
    touches = F.coalesce("carries", F.lit(0)) + F.coalesce("targets", F.lit(0))
    per = lambda a, b: R(F.try_divide(a, F.when(b > 0, b)))
    return s.select("player_id", "season", per(known("fantasy_points_ppr"), c("games")).alias("per_game"), per(c("targets"), c("games")).alias("targets_per_game"), per(known("fantasy_points_ppr"), touches).alias("per_touch"), per(c("targets"), touches).alias("target_part"))


def catalog_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Four ways to find a player: by id, by name, by name and team, by initial and surname; a key of two players finds none."""
    x = read(spark, d, "players").where("player_id is not null and player_id <> '00-0000000' and name is not null").select("player_id", S.ascii_key(c("name")).alias("nk"), F.coalesce(F.upper("team"), F.lit("")).alias("team"), F.lower(S.fold(c("name"))).alias("plain"))
    words = F.split(F.trim("plain"), r"\s+")
    short = F.concat(F.substring(words[0], 1, 1), F.lit(":"), F.regexp_replace(F.element_at(words, -1), "[^a-z]", ""))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("id", c("player_id")), ("name", c("nk")), ("team", F.concat("nk", F.lit("|"), "team")), ("short", short))])
    e = x.select("player_id", F.explode(kinds).alias("k")).select("player_id", "k.kind", "k.key")
    g = e.groupBy("kind", "key").agg(F.countDistinct("player_id").alias("n"), F.min("player_id").alias("player_id"))
    return g.where("n = 1").select("kind", "key", "player_id")


def pasted_picks(spark: SparkSession, d: str) -> DataFrame:
    """Pick rows read from pasted text: round, number, name, position and team of every line that is one."""
    x = read(spark, d, "players").where("draft_round is not null and draft_pick is not null and name is not null and team is not null and position is not null and name not like '%,%'")
    line = F.concat(F.lit("Round "), c("draft_round").cast("string"), F.lit(", Pick "), c("draft_pick").cast("string"), F.lit("\n"), c("name"), F.lit(", "), F.upper("position"), F.lit(" ("), F.upper("team"), F.lit(")\nview profile"))
    text = x.select("roster_row_id", line.alias("t"))
    at = r"Round (\d+), Pick (\d+)\n([^,\n]+), ([A-Z/]+) \(([A-Z0-9]+)\)"
    return text.select("roster_row_id", F.regexp_extract("t", at, 1).try_cast("int").alias("round"), F.regexp_extract("t", at, 2).try_cast("int").alias("pick"), F.regexp_extract("t", at, 3).alias("name"), F.regexp_extract("t", at, 4).alias("position"), F.regexp_extract("t", at, 5).alias("team"))


_KEY = "regexp_replace(regexp_replace(lower(strip_accents(name)), '\\s+(jr|sr|ii|iii|iv|v)\\.?$', ''), '[^a-z0-9]', '', 'g')"
_FP = "fantasy_points IS NOT NULL AND NOT isnan(fantasy_points)"


def _mul(a: str, b: str) -> str:
    return f"((((({a}) & 65535) * ({b})) + ((((({a}) >> 16) * ({b})) & 65535) * 65536)) & 4294967295)"


def _rep(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def _pick(n: int, src: str, part: str, order: str, k: int) -> str:
    return f"SELECT source_id, listing_id, {n} AS picker, -mean AS within FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order} DESC, listing_id) AS rn FROM {src}) WHERE rn <= {k}"


QUERIES = {f.__name__: f for f in (excluded_weeks, board_final_order, standings, rollout_frontier, canonical_json_digest, mulberry_stream, html_entities, repeated_absence, vacated_share, team_tie_break, snapshot_metrics, rank_metrics, move_flags, rate_features, catalog_lookups, pasted_picks)}
ORACLE = {
    "excluded_weeks": f"WITH x AS (SELECT * FROM player_weeks WHERE {_FP} AND season IS NOT NULL AND week IS NOT NULL), b AS (SELECT season, week FROM x GROUP BY 1, 2 HAVING avg(CAST(fantasy_points = 0 AS DOUBLE)) > 1.0::DOUBLE / 3) SELECT week_row_id, season, week FROM x ANTI JOIN b USING (season, week)",
    "board_final_order": "WITH x AS (SELECT listing_id, name, CASE WHEN NOT isnan(adp) AND adp BETWEEN 1 AND 100 THEN adp END AS dec, CASE WHEN NOT isnan(mean) THEN mean END AS m FROM source_listings) SELECT listing_id, CAST(row_number() OVER (ORDER BY dec NULLS LAST, m DESC NULLS LAST, name NULLS LAST, listing_id) AS INTEGER) AS place FROM x",
    "standings": f"""WITH x AS (SELECT * FROM player_weeks WHERE team IS NOT NULL AND opponent_team IS NOT NULL AND season IS NOT NULL AND week IS NOT NULL AND {_FP} AND abs(fantasy_points) < 100), g AS (SELECT season, week, team, round(sum(fantasy_points)) AS points, min(opponent_team) AS opponent FROM x GROUP BY 1, 2, 3),
      t AS (SELECT g.season, g.team, count(*) FILTER (g.points > o.points) AS wins, count(*) FILTER (g.points = o.points) AS ties, sum(g.points) AS points FROM g JOIN g o ON o.season = g.season AND o.week = g.week AND o.team = g.opponent GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY wins DESC, ties DESC, points DESC, team) AS INTEGER) AS place FROM t""",
    "rollout_frontier": f"""WITH {_LIST}, x AS (SELECT *, ceiling + 0.5::DOUBLE * (ceiling - mean) AS asym, mean + floor + ceiling AS raw FROM li WHERE position IN {CORE}),
      e AS ({_pick(0, 'x', 'source_id, position', 'mean', 1)} UNION ALL {_pick(1, 'x', 'source_id', 'mean', 8)} UNION ALL {_pick(2, 'x', 'source_id, position', 'mean', 2)} UNION ALL {_pick(3, 'x', 'source_id, position', 'raw', 1)} UNION ALL {_pick(4, 'x', 'source_id, position', 'asym', 1)} UNION ALL {_pick(5, 'x', 'source_id', 'mean', 18)}),
      o AS (SELECT source_id, listing_id, picker, within FROM (SELECT *, row_number() OVER (PARTITION BY source_id, listing_id ORDER BY picker, within) AS k FROM e) WHERE k = 1), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY picker, within, listing_id) AS INTEGER) AS place FROM o) SELECT source_id, listing_id, picker, place FROM p WHERE place <= 18""",
    "canonical_json_digest": """SELECT roster_row_id, sha256('{"player_id":"' || coalesce(player_id, '') || '","rookie":"' || coalesce(CAST(rookie_season AS VARCHAR), '') || '","team":"' || coalesce(team, '') || '"}') AS digest FROM players""",
    "mulberry_stream": f"""WITH a AS (SELECT p_partkey, CAST(k AS BIGINT) AS k FROM part, range(1, 21) t(k)), b AS (SELECT p_partkey, k, (p_partkey + {_mul('k', str(0x6D2B79F5))}) & 4294967295 AS s FROM a), e AS (SELECT p_partkey, k, {_mul('xor(s, s >> 15)', 's | 1')} AS t FROM b), f AS (SELECT p_partkey, k, xor(t, (t + {_mul('xor(t, t >> 7)', 't | 61')}) & 4294967295) AS t FROM e)
      SELECT p_partkey, CAST(k AS INTEGER) AS k, round(xor(t, t >> 14) / 4294967296.0::DOUBLE, 12) AS u FROM f""",
    "html_entities": f"SELECT doc_id, CAST(length({_rep('text')}) AS INTEGER) AS length, md5({_rep('text')}) AS digest FROM documents WHERE text IS NOT NULL",
    "repeated_absence": """WITH w AS (SELECT player_id, season, week FROM player_weeks WHERE player_id <> '00-0000000' AND season IS NOT NULL AND week IS NOT NULL AND outcome_status IS NOT NULL GROUP BY 1, 2, 3 HAVING bool_and(outcome_status <> 'active-observed')),
      i AS (SELECT *, week - row_number() OVER (PARTITION BY player_id, season ORDER BY week) AS island FROM w), r AS (SELECT player_id, season, count(*) AS n FROM i GROUP BY player_id, season, island) SELECT player_id, season, max(n) AS longest, CAST(sum(n) AS BIGINT) AS weeks FROM r GROUP BY 1, 2""",
    "vacated_share": f"""WITH {_SEASONS}, z AS (SELECT player_id, season, recent_team AS team, coalesce(targets, 0) AS targets FROM s WHERE recent_team IS NOT NULL), t AS (SELECT DISTINCT season, team FROM z), x AS (SELECT b.team, b.season + 1 AS season, b.targets, n.player_id IS NULL AS gone FROM z b JOIN t ON t.season = b.season + 1 AND t.team = b.team LEFT JOIN z n ON n.player_id = b.player_id AND n.season = b.season + 1 AND n.team = b.team)
      SELECT team, season, count(*) FILTER (gone) AS "left", round(CASE WHEN sum(targets) > 0 THEN sum(CASE WHEN gone THEN targets ELSE 0 END) / sum(targets) END, 6) AS vacated FROM x GROUP BY 1, 2""",
    "team_tie_break": f"""WITH p AS (SELECT * FROM (SELECT player_id, min({_KEY}) AS nk, min(upper(position)) AS pos, min(upper(team)) AS p_team FROM players WHERE name IS NOT NULL AND player_id IS NOT NULL AND player_id <> '00-0000000' GROUP BY 1) WHERE nk <> ''), x AS (SELECT listing_id, source_id, {_KEY} AS nk, upper(position) AS pos, upper(team) AS team FROM source_listings WHERE name IS NOT NULL AND position IS NOT NULL),
      m AS (SELECT listing_id, source_id, count(*) AS n, min(player_id) AS o, count(*) FILTER (team = p_team) AS same, min(player_id) FILTER (team = p_team) AS bt FROM x JOIN p USING (nk, pos) GROUP BY 1, 2), a AS (SELECT *, CASE WHEN n = 1 THEN o WHEN same = 1 THEN bt END AS player_id FROM m)
      SELECT listing_id, player_id, CASE WHEN n = 1 THEN 'name' ELSE 'team' END AS method FROM (SELECT *, count(*) OVER (PARTITION BY source_id, player_id) AS claims FROM a WHERE player_id IS NOT NULL) WHERE claims = 1""",
    "snapshot_metrics": "WITH x AS (SELECT *, CASE WHEN NOT isnan(mean) THEN mean END AS m FROM source_listings) SELECT source_id, count(*) AS rows, count(DISTINCT source_player_id) AS identities, count(DISTINCT team) AS teams, round(avg(CAST(coalesce(m, 0) = 0 AS DOUBLE)), 6) AS zero, round(avg(CAST(m IS NULL AS DOUBLE)), 6) AS missing FROM x GROUP BY 1",
    "rank_metrics": f"""WITH {_SEASONS}, z AS (SELECT player_id, season, position, fantasy_points_ppr AS v FROM s WHERE position IS NOT NULL AND fantasy_points_ppr IS NOT NULL AND NOT isnan(fantasy_points_ppr)), x AS (SELECT a.player_id, a.season, a.position, row_number() OVER (PARTITION BY a.season, a.position ORDER BY a.v DESC, a.player_id) AS ra, row_number() OVER (PARTITION BY a.season, a.position ORDER BY b.v DESC, a.player_id) AS rb FROM z a JOIN z b ON b.player_id = a.player_id AND b.season = a.season - 1)
      SELECT season, position, count(*) AS n, round(avg(abs(ra - rb)), 6) AS rank_mae, bool_or(ra = 1 AND rb = 1) AS top FROM x GROUP BY 1, 2""",
    "move_flags": """WITH l AS (SELECT player_id, season + 1 AS season, min(team) AS was FROM player_examples WHERE player_id IS NOT NULL AND season IS NOT NULL AND team IS NOT NULL GROUP BY 1, 2)
      SELECT example_id, e.team IS NOT NULL AND was IS NOT NULL AND e.team <> was AS moved, experience = 0 AS rookie, coalesce(NOT isnan(depth_rank) AND depth_rank = 1, false) AS first, coalesce(NOT isnan(depth_rank) AND depth_rank > 3, false) AS deep FROM player_examples e LEFT JOIN l ON l.player_id = e.player_id AND l.season = e.season WHERE e.player_id IS NOT NULL AND e.season IS NOT NULL""",
    "rate_features": f"""WITH {_SEASONS}, x AS (SELECT *, CASE WHEN NOT isnan(fantasy_points_ppr) THEN fantasy_points_ppr END AS v, coalesce(carries, 0) + coalesce(targets, 0) AS touches FROM s)
      SELECT player_id, season, round(v / CASE WHEN games > 0 THEN games END, 6) AS per_game, round(targets / CASE WHEN games > 0 THEN games END, 6) AS targets_per_game, round(v / CASE WHEN touches > 0 THEN touches END, 6) AS per_touch, round(targets / CASE WHEN touches > 0 THEN touches END, 6) AS target_part FROM x""",
    "catalog_lookups": f"""WITH x AS (SELECT player_id, {_KEY} AS nk, coalesce(upper(team), '') AS team, string_split_regex(trim(lower(strip_accents(name))), '\\s+') AS w FROM players WHERE player_id IS NOT NULL AND player_id <> '00-0000000' AND name IS NOT NULL),
      e AS (SELECT player_id, 'id' AS kind, player_id AS key FROM x UNION ALL SELECT player_id, 'name', nk FROM x UNION ALL SELECT player_id, 'team', nk || '|' || team FROM x UNION ALL SELECT player_id, 'short', substr(w[1], 1, 1) || ':' || regexp_replace(w[len(w)], '[^a-z]', '', 'g') FROM x) SELECT kind, key, min(player_id) AS player_id FROM e GROUP BY 1, 2 HAVING count(DISTINCT player_id) = 1""",
    "pasted_picks": "SELECT roster_row_id, draft_round AS round, draft_pick AS pick, name, upper(position) AS position, upper(team) AS team FROM players WHERE draft_round IS NOT NULL AND draft_pick IS NOT NULL AND name IS NOT NULL AND team IS NOT NULL AND position IS NOT NULL AND name NOT LIKE '%,%'",
}
