"""Loading and joining dimensions: season files, depth charts, team seasons, rosters, enrichment and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import temporal as T
from draftloom.plans.feeds import _scratch
from draftloom.plans.temporal import _SEASONS, _seasons
from draftloom.session import read
from draftloom.sources import readers

c = F.col
R = lambda x, n=6: F.round(x, n)
SKILL = ("QB", "RB", "WR", "TE", "K")
# fixed values: club codes that changed or are written in two ways
CLUBS = {"OAK": "LV", "SD": "LAC", "STL": "LA", "LAR": "LA", "JAC": "JAX", "WSH": "WAS", "ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU"}


def club(code: Column) -> Column:
    """A club's present code."""
    up = F.upper(F.trim(code))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CLUBS.items() for x in kv]), up), up)


def season_files_load(spark: SparkSession, d: str) -> DataFrame:
    """Season totals written as one CSV per season and loaded by a glob: cast, positions kept, the last row per key."""
    path = _scratch(spark, "seasons")
    x = read(spark, d, "player_seasons").select("stat_row_id", "player_id", "position", "season", "version_no", "games", c("season").alias("s"))
    x.repartition("s").write.partitionBy("s").option("header", True).csv(path)
    rows = readers.read_seasons(spark, f"{path}/s=*/*.csv", "stat_row_id bigint, player_id string, position string, season int, version_no int, games int, absent double", ["player_id", "season"])
    rows = rows.withColumn("position", F.upper(F.trim("position"))).where(c("position").isin(*SKILL))
    return T.keep_last(rows, ["player_id", "season"], [c("version_no"), c("stat_row_id")]).select("player_id", "season", "position", "version_no", "games", c("absent").isNull().alias("absent"))


def players_dimension(spark: SparkSession, d: str) -> DataFrame:
    """One row per player: the newest extract, without the placeholder and without ids that two names share."""
    x = read(spark, d, "players").where(c("player_id").isNotNull() & (c("player_id") != "00-0000000"))
    names = x.where("name is not null").groupBy("player_id").agg(F.countDistinct(S.ascii_key(c("name"))).alias("k")).where("k > 1").select("player_id")
    return T.keep_last(x.join(names, "player_id", "left_anti"), ["player_id"], [c("updated_at"), c("roster_row_id")]).select("player_id", "roster_row_id", F.upper("position").alias("position"), "team")


def pick_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """Draft picks claimed by exactly one player, rounds 1 to 7 and picks 1 to 300 only; how many claims broke the rule."""
    x = read(spark, d, "players").where("draft_pick is not null and rookie_season is not null")
    g = x.groupBy("rookie_season", "draft_pick").agg(F.countDistinct("player_id").alias("players"), F.min("player_id").alias("player_id"), F.bool_and(c("draft_round").between(1, 7) & c("draft_pick").between(1, 300)).alias("valid"))
    return g.groupBy("rookie_season").agg(F.count_if((c("players") == 1) & c("valid")).alias("unique"), F.count_if((c("players") > 1) | ~F.coalesce("valid", F.lit(False))).alias("broken"))


def depth_charts(spark: SparkSession, d: str) -> DataFrame:
    """Depth charts of two schemas (plain and gzip) read back as one; the best rank of each player and team."""
    x = read(spark, d, "player_examples").where("player_id is not null and depth_rank is not null and not isnan(depth_rank)").select("player_id", "team", c("depth_rank").cast("int").alias("rank"), "season", c("cutoff_at").cast("string").alias("dt"))
    a, b = _scratch(spark, "depth-old"), _scratch(spark, "depth-new")
    x.where("season < 2018").select(c("player_id").alias("gsis_id"), F.pmod("season", F.lit(18)).alias("week"), c("rank").alias("depth_team"), c("team").alias("club_code")).write.option("header", True).csv(a)
    x.where("season >= 2018").select(c("player_id").alias("gsis_id"), "dt", c("rank").alias("pos_rank"), "team").write.option("header", True).option("compression", "gzip").csv(b)
    return readers.read_depth_charts(spark, [a, b]).groupBy("player_id", "team").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("rows"))


def team_defence(spark: SparkSession, d: str) -> DataFrame:
    """Points of a made-up defence per team and season, from points allowed: sums per game, a pseudo-player as its key."""
    x = read(spark, d, "player_weeks").where("opponent_team is not null and fantasy_points is not null and not isnan(fantasy_points) and abs(fantasy_points) < 100")
    game = x.groupBy(c("opponent_team").alias("team"), "season", "week").agg(F.sum("fantasy_points").alias("allowed"))
    # fixed values: points for points allowed
    points = S.ladder(c("allowed"), [(0, 10.0), (6, 7.0), (13, 4.0), (20, 1.0), (27, 0.0), (34, -1.0)], -4.0)
    g = game.groupBy("team", "season").agg(F.count(F.lit(1)).alias("games"), F.sum(points).alias("points"))
    return g.select(F.concat(F.lit("DST:"), club(c("team"))).alias("player_id"), "team", "season", "games", R("points").alias("points"))


def season_summary_rows(spark: SparkSession, d: str) -> DataFrame:
    """Summary rows (week 0) of a gzip file of weeks and summaries, each key once; a key met twice is left out."""
    path = _scratch(spark, "ngs")
    x = read(spark, d, "player_weeks").where("player_id <> '00-0000000'")
    total = x.groupBy("player_id", "season").agg(F.sum(F.coalesce("targets", F.lit(0))).alias("targets")).withColumn("week", F.lit(0))
    x.select("player_id", "season", c("targets").cast("long").alias("targets"), "week").unionByName(total).write.option("header", True).option("compression", "gzip").csv(path)
    back = readers.read_csv_union(spark, [path], ["player_id", "week"], "player_id string, season int, targets long, week int")
    zero = back.where("week = 0").groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("n"), F.max("targets").alias("targets"))
    return zero.where("n = 1").select("player_id", "season", "targets")


def projection_rows(spark: SparkSession, d: str) -> DataFrame:
    """Projections shaped from a feed: one season, known positions, a team; the scoring column by format; the last of a key."""
    x = read(spark, d, "player_weeks").where("team is not null and season = 2024").withColumn("position", F.upper(F.trim("position"))).where(c("position").isin(*SKILL))
    forms = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), p.alias("points")) for f, p in (("standard", c("fantasy_points")), ("half", (c("fantasy_points") + c("fantasy_points_ppr")) / 2), ("ppr", c("fantasy_points_ppr")))]))
    last = T.keep_last(x, ["player_id"], [c("loaded_at"), c("week_row_id")])
    return last.select("player_id", forms.alias("f")).select("player_id", "f.format", R("f.points").alias("points")).where("points is not null and not isnan(points)")


def file_series(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots grouped by the stem of their file name, numbered in the order they were published."""
    x = read(spark, d, "stats_files").where("file_name is not null").withColumn("stem", F.regexp_replace(F.regexp_replace("file_name", r"\.[A-Za-z]+$", ""), r"[_\-]?\d+", ""))
    return x.select("file_id", "stem", F.row_number().over(Window.partitionBy("stem").orderBy("published_at", "file_id")).alias("n"))


def feed_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A feed published with its digest and read back only if it is what the manifest says."""
    path = _scratch(spark, "feed")
    digest, n = readers.write_manifest(read(spark, d, "players").select("roster_row_id", "player_id", "team"), path)
    return readers.read_verified(spark, path, digest, n).groupBy("team").agg(F.count(F.lit(1)).alias("n"))


def kicker_points(spark: SparkSession, d: str) -> DataFrame:
    """Points for kicks by distance: the field goals of an order's lines, the distance their quantity."""
    # fixed values: 3 below 40, 4 below 50, 5 from 50; a miss costs one
    made = S.ladder(c("l_quantity"), [(39, 3.0), (49, 4.0)], 5.0)
    x = read(spark, d, "lineitem").groupBy(c("l_orderkey").alias("kicker")).agg(F.sum(F.when(c("l_returnflag") == "R", -1.0).otherwise(made)).alias("points"), F.count_if(c("l_returnflag") != "R").alias("made"))
    return x.select("kicker", "points", "made")


def defence_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of a defence from its counts, points allowed joined with nought where unknown."""
    n = read(spark, d, "lineitem").groupBy(c("l_suppkey").alias("team")).agg(*[F.count_if(x).alias(k) for k, x in (("sacks", c("l_quantity") > 40), ("picks", c("l_quantity") < 3), ("fumbles", c("l_discount") > 0.09), ("touchdowns", c("l_tax") > 0.07), ("safeties", c("l_discount") == 0.05))])
    allowed = read(spark, d, "supplier").where("s_acctbal > 0").select(c("s_suppkey").alias("team"), F.floor(c("s_acctbal") / 300).alias("allowed"))
    # fixed values: what each count is worth
    worth = c("sacks") + 2.0 * c("picks") + 2.0 * c("fumbles") + 6.0 * c("touchdowns") + 2.0 * c("safeties")
    x = n.join(allowed, "team", "left").withColumn("allowed", F.coalesce("allowed", F.lit(0)))
    return x.select("team", R(worth + S.ladder(c("allowed"), [(0, 10.0), (6, 7.0), (13, 4.0), (20, 1.0), (27, 0.0), (34, -1.0)], -4.0)).alias("points"))


def stat_line_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of a stat line by a league's weights; a missing count is nought."""
    # fixed values: a tenth of a point a carry and a half a target, by format one, a half or nothing a reception
    k = lambda n: F.coalesce(c(n).cast("double"), F.lit(0.0))
    base = 0.1 * k("carries") + 0.5 * k("targets")
    return read(spark, d, "player_weeks").select("week_row_id", *[R(base + w * k("receptions")).alias(n) for n, w in (("standard", 0.0), ("half", 0.5), ("ppr", 1.0))])


def live_risk(spark: SparkSession, d: str) -> DataFrame:
    """The larger of a week's own risk and 0.8 for any designation; availability does not look at designations."""
    x = read(spark, d, "player_weeks").where("projected is not null and not isnan(projected) and projected > 0")
    own = S.clamp(F.lit(4.0) / (2 * c("projected")), 0.05, 0.95)
    marked = c("outcome_status").isNotNull() & (c("outcome_status") != "active-observed")
    return x.select("week_row_id", R(F.greatest(own, F.when(marked, 0.8).otherwise(0.0))).alias("risk"), R(1 - own).alias("availability"))


def range_scaling(spark: SparkSession, d: str) -> DataFrame:
    """A player's own spread against the position's, kept within .65 to 1.5; 1 with fewer than eight weeks."""
    x = read(spark, d, "player_weeks").where("player_id <> '00-0000000' and position is not null and fantasy_points is not null and not isnan(fantasy_points) and abs(fantasy_points) < 100").withColumn("position", F.upper(F.trim("position")))
    p = x.groupBy("position").agg(F.stddev_pop("fantasy_points").alias("all"))
    own = x.groupBy("player_id", "position").agg(F.stddev_pop("fantasy_points").alias("own"), F.count(F.lit(1)).alias("n"))
    return own.join(F.broadcast(p), "position").select("player_id", "position", "n", R(F.when((c("n") >= 8) & (c("all") > 0), S.clamp(c("own") / c("all"), 0.65, 1.5)).otherwise(1.0)).alias("scale"))


def roster_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Players to predict: on a team, in the listed positions, and seen in the season before the last or later."""
    last = _seasons(spark, d).groupBy("player_id").agg(F.max("season").alias("last_season"))
    newest = _seasons(spark, d).agg(F.max("season").alias("newest"))
    p = players_dimension(spark, d).where("team is not null and trim(team) <> ''").where(c("position").isin(*SKILL))
    return p.join(last, "player_id").crossJoin(F.broadcast(newest)).where(c("last_season") >= c("newest") - 1).select("player_id", "team", "last_season")


def snap_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Shares that can be one: above nought and at most 1.01; how many of each season are left out."""
    x = read(spark, d, "player_weeks")
    ok = c("target_share").isNotNull() & ~F.isnan("target_share") & (c("target_share") > 0) & (c("target_share") <= 1.01)
    return x.groupBy("season").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def merge_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Two seasons of a player side by side, columns told apart by suffix, kept where both hold and the later is better."""
    x = _seasons(spark, d).select("player_id", "season", "games", "fantasy_points_ppr")
    a, b = x.select("player_id", c("season").alias("season_x"), c("games").alias("games_x"), c("fantasy_points_ppr").alias("points_x")), x.select("player_id", (c("season") - 1).alias("season_x"), c("games").alias("games_y"), c("fantasy_points_ppr").alias("points_y"))
    return a.join(b, ["player_id", "season_x"]).where((c("games_x") >= 8) & (c("games_y") >= 8) & (c("points_y") > c("points_x"))).select("player_id", "season_x", "games_x", "games_y", R(c("points_y") - c("points_x")).alias("gain"))


def three_frame_join(spark: SparkSession, d: str) -> DataFrame:
    """Three frames joined on their row id, columns told apart by suffix."""
    x = read(spark, d, "player_examples")
    frame = lambda col, s: x.select("example_id", c(col).alias(f"value_{s}"))
    return frame("games_lag1", "a").join(frame("age", "b"), "example_id").join(frame("depth_rank", "c"), "example_id").select("example_id", *[F.when(~F.isnan(f"value_{s}"), c(f"value_{s}")).alias(f"value_{s}") for s in "abc"])


def multi_source_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Every player of the roster with the newest season, the newest week and the best listing known of them."""
    p = players_dimension(spark, d).select("player_id", "team")
    s = T.keep_last(_seasons(spark, d), ["player_id"], [c("season")]).select("player_id", "season", "games")
    w = T.keep_last(read(spark, d, "player_weeks").where("player_id <> '00-0000000'"), ["player_id"], [c("season"), c("week"), c("loaded_at"), c("week_row_id")]).select("player_id", "week", "opponent_team")
    names = read(spark, d, "players").where("name is not null").groupBy("player_id").agg(F.min(S.ascii_key(c("name"))).alias("nk"))
    best = read(spark, d, "source_listings").where("name is not null and mean is not null and not isnan(mean)").groupBy(S.ascii_key(c("name")).alias("nk")).agg(F.max("mean").alias("best"))
    return p.join(s, "player_id", "left").join(w, "player_id", "left").join(names, "player_id", "left").join(best, "nk", "left").select("player_id", "team", "season", "games", "week", "opponent_team", R("best").alias("best"))


def half_format(spark: SparkSession, d: str) -> DataFrame:
    """The format between two: ids that both have, the midpoint, captured when the later of both was."""
    x = read(spark, d, "player_weeks").where("player_id <> '00-0000000'")
    ok = lambda v: c(v).isNotNull() & ~F.isnan(v)
    std = x.where(ok("fantasy_points")).groupBy("player_id", "season", "week").agg(F.max("fantasy_points").alias("a"), F.max("loaded_at").alias("ta"))
    ppr = x.where(ok("fantasy_points_ppr")).groupBy("player_id", "season", "week").agg(F.max("fantasy_points_ppr").alias("b"), F.max("loaded_at").alias("tb"))
    return std.join(ppr, ["player_id", "season", "week"]).select("player_id", "season", "week", R((c("a") + c("b")) / 2, 4).alias("half"), F.date_format(F.greatest("ta", "tb"), "yyyy-MM-dd HH:mm:ss").alias("captured_at"))


def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A table with the keys of a second replaced by it; replaced rows keep their outcome but take the declared position."""
    old = _seasons(spark, d).select("player_id", "season", c("position"), "games")
    declared = players_dimension(spark, d).select("player_id", c("position").alias("declared"))
    new = old.join(declared, "player_id").where("declared is not null and (position is null or upper(position) <> declared)").select("player_id", "season", c("declared").alias("position"), "games", F.lit(True).alias("replaced"))
    kept = old.join(new.select("player_id", "season"), ["player_id", "season"], "left_anti").withColumn("replaced", F.lit(False))
    return kept.unionByName(new)


def position_supplement(spark: SparkSession, d: str) -> DataFrame:
    """A feed completed by a second for the positions of which it has fewer than 20."""
    x = read(spark, d, "source_listings").select("listing_id", "source_id", F.upper(F.trim("position")).alias("position")).where("position is not null")
    first, second = (x.join(F.broadcast(x.agg(f("source_id").alias("source_id"))), "source_id") for f in (F.min, F.max))
    full = first.groupBy("position").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("position")
    return first.unionByName(second.join(full, "position", "left_anti").select(*first.columns)).select("listing_id", "position").distinct()


def object_merge(spark: SparkSession, d: str) -> DataFrame:
    """Objects merged by precedence: a later object's keys win where they have a value."""
    known = lambda v: F.when(~F.isnan(v), c(v)).cast("string")
    x = read(spark, d, "source_listings")
    base = F.map_from_arrays(F.array(F.lit("team"), F.lit("mean"), F.lit("adp")), F.array(F.lit("FA"), F.lit("0"), F.lit("999")))
    own = F.map_filter(F.map_from_arrays(F.array(F.lit("team"), F.lit("mean"), F.lit("adp")), F.array(c("team"), F.floor(known("mean").cast("double")).cast("string"), F.floor(known("adp").cast("double")).cast("string"))), lambda k, v: v.isNotNull())
    merged = F.map_zip_with(base, own, lambda k, a, b: F.coalesce(b, a))
    return x.select("listing_id", *[merged[k].alias(k) for k in ("team", "mean", "adp")])


def unicode_name_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys of names that keep every script's letters, beside the folded ones: where the two differ."""
    x = read(spark, d, "source_listings").where("name is not null").select("listing_id", S.unicode_key(c("name")).alias("wide"), S.ascii_key(c("name")).alias("folded"))
    return x.select("listing_id", "wide", "folded", (c("wide") != c("folded")).alias("differ"))


def club_codes(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "player_weeks").where("team is not null").select("team")
    old = F.array(*[F.lit(k) for k in CLUBS], F.lit(None).cast("string"))
    # each team as it stands, and a former code for every row, so that the table is used
    both = x.select(F.explode(F.array(c("team"), F.coalesce(F.get(old, F.pmod(F.length("team") + F.ascii("team"), F.lit(len(CLUBS) + 1))), F.lit(" jac ")))).alias("code"))
    return both.groupBy(c("code"), club(c("code")).alias("club")).agg(F.count(F.lit(1)).alias("n"))


def height_inches(spark: SparkSession, d: str) -> DataFrame:
    """Heights written as feet and inches ("6-2", "5'11") in inches; anything else is null."""
    text = F.concat((F.lit(5) + F.pmod(c("p_size"), F.lit(3))).cast("string"), F.when(c("p_partkey") % 2 == 0, "-").when(c("p_partkey") % 3 == 0, "'").otherwise("/"), F.pmod(c("p_size"), F.lit(13)).cast("string"))
    feet, inches = F.regexp_extract("h", r"^\s*(\d)[-'](\d{1,2})\s*$", 1), F.regexp_extract("h", r"^\s*(\d)[-'](\d{1,2})\s*$", 2)
    good = (feet != "") & (inches.try_cast("int") < 12)
    return read(spark, d, "part").select("p_partkey", text.alias("h")).select("p_partkey", F.when(good, feet.try_cast("int") * 12 + inches.try_cast("int")).alias("inches"))


def late_picks(spark: SparkSession, d: str) -> DataFrame:
    """Picks carry their number: of several snapshots the last one seen holds; how old it was, and whether that is stale."""
    x = read(spark, d, "events").select(c("user_id").alias("draft"), F.pmod("event_id", F.lit(20)).alias("pick_no"), "event_id", "ts")
    last = x.groupBy("draft", "pick_no").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("superseded"))
    end = x.groupBy("draft").agg(F.max("ts").alias("end"))
    age = F.unix_timestamp("end") - F.unix_timestamp("ts")
    limit = F.when(age > 72 * 3600, "72h").when(age > 24 * 3600, "24h").when(age > 120, "120s").otherwise("fresh")
    return last.join(end, "draft").select("draft", "pick_no", "event_id", (c("superseded") - 1).alias("superseded"), limit.alias("age"))


def heartbeat_stale(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the beats of a session: silent for longer than 30 s, and for how long at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return read(spark, d, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count_if(c("gap") > 30).alias("stale"), F.max("gap").alias("longest"))


def draft_state_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each draft: bad or repeated pick numbers, picks without a player, players not in the catalogue."""
    picks = read(spark, d, "lineitem").select(c("l_suppkey").alias("draft"), F.when(c("l_orderkey") % 997 != 0, c("l_linenumber")).otherwise(-1).alias("pick_no"), F.when(c("l_partkey") % 89 != 0, c("l_partkey")).alias("player"))
    known = read(spark, d, "part").where("p_size > 1").select(c("p_partkey").alias("player"), F.lit(True).alias("known"))
    x = picks.join(known, "player", "left")
    n = x.groupBy("draft", "pick_no").agg(F.count(F.lit(1)).alias("k"), F.count_if(c("player").isNull()).alias("empty"), F.count_if(c("player").isNotNull() & c("known").isNull()).alias("unknown"))
    g = n.groupBy("draft").agg(F.sum(F.when(c("pick_no") < 1, c("k")).otherwise(0)).alias("invalid"), F.sum(F.when(c("pick_no") >= 1, c("k") - 1).otherwise(0)).alias("repeated"), F.sum("empty").alias("empty"), F.sum("unknown").alias("unknown"))
    return g.select("draft", "invalid", "repeated", "empty", "unknown", ((c("invalid") + c("repeated") + c("empty") + c("unknown")) == 0).alias("valid"))


_KEY = "regexp_replace(regexp_replace(lower(strip_accents(name)), '\\s+(jr|sr|ii|iii|iv|v)\\.?$', ''), '[^a-z0-9]', '', 'g')"
_CLUB = "(CASE upper(trim({0})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLUBS.items()) + " ELSE upper(trim({0})) END)"
_DIM = f"""pl AS (SELECT * FROM players WHERE player_id IS NOT NULL AND player_id <> '00-0000000'), amb AS (SELECT player_id FROM pl WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_KEY}) > 1),
 dim AS (SELECT player_id, roster_row_id, upper(position) AS position, team FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY updated_at DESC NULLS LAST, roster_row_id DESC) AS rn FROM pl WHERE player_id NOT IN (SELECT player_id FROM amb)) WHERE rn = 1)"""
_ALLOWED = "(CASE WHEN {0} <= 0 THEN 10.0 WHEN {0} <= 6 THEN 7.0 WHEN {0} <= 13 THEN 4.0 WHEN {0} <= 20 THEN 1.0 WHEN {0} <= 27 THEN 0.0 WHEN {0} <= 34 THEN -1.0 ELSE -4.0 END)::DOUBLE"
_OK = "{0} IS NOT NULL AND NOT isnan({0})"
_CODES = ", ".join(f"'{k}'" for k in CLUBS)

QUERIES = {f.__name__: f for f in (season_files_load, players_dimension, pick_uniqueness, depth_charts, team_defence, season_summary_rows, projection_rows, file_series, feed_manifest, kicker_points, defence_points, stat_line_points, live_risk, range_scaling, roster_eligible, snap_sanity, merge_suffixes, three_frame_join, multi_source_enrichment, half_format, keyed_upsert, position_supplement, object_merge, unicode_name_key, club_codes, height_inches, late_picks, heartbeat_stale, draft_state_errors)}
ORACLE = {
    "season_files_load": f"SELECT player_id, season, position, version_no, games, true AS absent FROM (SELECT player_id, season, upper(trim(position)) AS position, version_no, games, row_number() OVER (PARTITION BY player_id, season ORDER BY version_no DESC, stat_row_id DESC) AS rn FROM player_seasons WHERE upper(trim(position)) IN {SKILL}) WHERE rn = 1",
    "players_dimension": f"WITH {_DIM} SELECT player_id, roster_row_id, position, team FROM dim",
    "pick_uniqueness": "WITH g AS (SELECT rookie_season, draft_pick, count(DISTINCT player_id) AS players, bool_and(draft_round BETWEEN 1 AND 7 AND draft_pick BETWEEN 1 AND 300) AS valid FROM players WHERE draft_pick IS NOT NULL AND rookie_season IS NOT NULL GROUP BY 1, 2) SELECT rookie_season, count(*) FILTER (players = 1 AND valid) AS \"unique\", count(*) FILTER (players > 1 OR NOT coalesce(valid, false)) AS broken FROM g GROUP BY 1",
    "depth_charts": "SELECT player_id, team, CAST(min(CAST(trunc(depth_rank) AS INTEGER)) AS INTEGER) AS rank, count(*) AS rows FROM player_examples WHERE player_id IS NOT NULL AND depth_rank IS NOT NULL AND NOT isnan(depth_rank) AND season IS NOT NULL GROUP BY 1, 2",
    "team_defence": f"""WITH g AS (SELECT opponent_team AS team, season, week, sum(fantasy_points) AS allowed FROM player_weeks WHERE opponent_team IS NOT NULL AND {_OK.format('fantasy_points')} AND abs(fantasy_points) < 100 GROUP BY 1, 2, 3)
      SELECT concat('DST:', {_CLUB.format('team')}) AS player_id, team, season, count(*) AS games, round(sum({_ALLOWED.format('allowed')}), 6) AS points FROM g GROUP BY team, season""",
    "season_summary_rows": "WITH w AS (SELECT player_id, season, week, targets FROM player_weeks WHERE player_id <> '00-0000000'), z AS (SELECT player_id, season, CAST(targets AS BIGINT) AS targets FROM w WHERE week = 0 UNION ALL SELECT player_id, season, CAST(sum(coalesce(targets, 0)) AS BIGINT) FROM w GROUP BY 1, 2) SELECT player_id, season, max(targets) AS targets FROM z GROUP BY 1, 2 HAVING count(*) = 1",
    "projection_rows": f"""WITH x AS (SELECT *, upper(trim(position)) AS p FROM player_weeks WHERE team IS NOT NULL AND season = 2024), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY loaded_at DESC NULLS LAST, week_row_id DESC) AS rn FROM x WHERE p IN {SKILL}) WHERE rn = 1),
      f AS (SELECT player_id, 'standard' AS format, fantasy_points AS points FROM l UNION ALL SELECT player_id, 'half', (fantasy_points + fantasy_points_ppr) / 2 FROM l UNION ALL SELECT player_id, 'ppr', fantasy_points_ppr FROM l) SELECT player_id, format, round(points, 6) AS points FROM f WHERE {_OK.format('points')}""",
    "file_series": "WITH x AS (SELECT file_id, published_at, regexp_replace(regexp_replace(file_name, '\\.[A-Za-z]+$', ''), '[_\\-]?\\d+', '', 'g') AS stem FROM stats_files WHERE file_name IS NOT NULL) SELECT file_id, stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY published_at NULLS FIRST, file_id) AS INTEGER) AS n FROM x",
    "feed_manifest": "SELECT team, count(*) AS n FROM players GROUP BY 1",
    "kicker_points": "SELECT l_orderkey AS kicker, sum(CASE WHEN l_returnflag = 'R' THEN -1.0 WHEN l_quantity <= 39 THEN 3.0 WHEN l_quantity <= 49 THEN 4.0 ELSE 5.0 END)::DOUBLE AS points, count(*) FILTER (l_returnflag <> 'R') AS made FROM lineitem GROUP BY 1",
    "defence_points": f"""WITH n AS (SELECT l_suppkey AS team, count(*) FILTER (l_quantity > 40) AS sacks, count(*) FILTER (l_quantity < 3) AS picks, count(*) FILTER (l_discount > 0.09::DOUBLE) AS fumbles, count(*) FILTER (l_tax > 0.07::DOUBLE) AS tds, count(*) FILTER (l_discount = 0.05::DOUBLE) AS safeties FROM lineitem GROUP BY 1),
      a AS (SELECT n.*, coalesce(floor(s_acctbal / 300), 0) AS allowed FROM n LEFT JOIN supplier ON s_suppkey = team AND s_acctbal > 0) SELECT team, round(sacks + 2.0 * picks + 2.0 * fumbles + 6.0 * tds + 2.0 * safeties + {_ALLOWED.format('allowed')}, 6) AS points FROM a""",
    "stat_line_points": "SELECT week_row_id, " + ", ".join(f"round(0.1::DOUBLE * coalesce(carries, 0) + 0.5::DOUBLE * coalesce(targets, 0) + {w}::DOUBLE * coalesce(receptions, 0), 6) AS {n}" for n, w in (("standard", 0.0), ("half", 0.5), ("ppr", 1.0))) + " FROM player_weeks",
    "live_risk": f"WITH x AS (SELECT *, least(greatest(4.0::DOUBLE / (2 * projected), 0.05::DOUBLE), 0.95::DOUBLE) AS own FROM player_weeks WHERE {_OK.format('projected')} AND projected > 0) SELECT week_row_id, round(greatest(own, CASE WHEN outcome_status IS NOT NULL AND outcome_status <> 'active-observed' THEN 0.8::DOUBLE ELSE 0 END), 6) AS risk, round(1 - own, 6) AS availability FROM x",
    "range_scaling": f"""WITH x AS (SELECT player_id, upper(trim(position)) AS position, fantasy_points AS v FROM player_weeks WHERE player_id <> '00-0000000' AND position IS NOT NULL AND {_OK.format('fantasy_points')} AND abs(fantasy_points) < 100), p AS (SELECT position, stddev_pop(v) AS a FROM x GROUP BY 1), o AS (SELECT player_id, position, stddev_pop(v) AS own, count(*) AS n FROM x GROUP BY 1, 2)
      SELECT player_id, position, n, round(CASE WHEN n >= 8 AND a > 0 THEN least(greatest(own / a, 0.65::DOUBLE), 1.5::DOUBLE) ELSE 1 END, 6) AS scale FROM o JOIN p USING (position)""",
    "roster_eligible": f"WITH {_SEASONS}, {_DIM}, l AS (SELECT player_id, max(season) AS last_season FROM s GROUP BY 1) SELECT player_id, team, last_season FROM dim JOIN l USING (player_id) WHERE team IS NOT NULL AND trim(team) <> '' AND position IN {SKILL} AND last_season >= (SELECT max(season) FROM s) - 1",
    "snap_sanity": f"SELECT season, count(*) FILTER ({_OK.format('target_share')} AND target_share > 0 AND target_share <= 1.01::DOUBLE) AS kept, count(*) FILTER (NOT ({_OK.format('target_share')} AND target_share > 0 AND target_share <= 1.01::DOUBLE)) AS dropped FROM player_weeks GROUP BY 1",
    "merge_suffixes": f"WITH {_SEASONS} SELECT a.player_id, a.season AS season_x, a.games AS games_x, b.games AS games_y, round(b.fantasy_points_ppr - a.fantasy_points_ppr, 6) AS gain FROM s a JOIN s b ON a.player_id = b.player_id AND b.season = a.season + 1 WHERE a.games >= 8 AND b.games >= 8 AND b.fantasy_points_ppr > a.fantasy_points_ppr",
    "three_frame_join": "SELECT example_id, " + ", ".join(f"CASE WHEN NOT isnan({k}) THEN {k} END AS value_{s}" for k, s in (("games_lag1", "a"), ("age", "b"), ("depth_rank", "c"))) + " FROM player_examples",
    "multi_source_enrichment": f"""WITH {_SEASONS}, {_DIM}, l AS (SELECT * FROM (SELECT player_id, season, games, row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS k FROM s) WHERE k = 1), w AS (SELECT * FROM (SELECT player_id, week, opponent_team, row_number() OVER (PARTITION BY player_id ORDER BY season DESC NULLS LAST, week DESC NULLS LAST, loaded_at DESC NULLS LAST, week_row_id DESC) AS k FROM player_weeks WHERE player_id <> '00-0000000') WHERE k = 1),
      n AS (SELECT player_id, min({_KEY}) AS nk FROM players WHERE name IS NOT NULL GROUP BY 1), b AS (SELECT {_KEY} AS nk, max(mean) AS best FROM source_listings WHERE name IS NOT NULL AND {_OK.format('mean')} GROUP BY 1)
      SELECT dim.player_id, dim.team, l.season, l.games, w.week, w.opponent_team, round(best, 6) AS best FROM dim LEFT JOIN l ON l.player_id = dim.player_id LEFT JOIN w ON w.player_id = dim.player_id LEFT JOIN n ON n.player_id = dim.player_id LEFT JOIN b ON b.nk = n.nk""",
    "half_format": f"""WITH a AS (SELECT player_id, season, week, max(fantasy_points) AS a, max(loaded_at) AS ta FROM player_weeks WHERE player_id <> '00-0000000' AND {_OK.format('fantasy_points')} GROUP BY 1, 2, 3), b AS (SELECT player_id, season, week, max(fantasy_points_ppr) AS b, max(loaded_at) AS tb FROM player_weeks WHERE player_id <> '00-0000000' AND {_OK.format('fantasy_points_ppr')} GROUP BY 1, 2, 3)
      SELECT player_id, season, week, round((a + b) / 2, 4) AS half, strftime(greatest(ta, tb), '%Y-%m-%d %H:%M:%S') AS captured_at FROM a JOIN b USING (player_id, season, week)""",
    "keyed_upsert": f"""WITH {_SEASONS}, {_DIM}, n AS (SELECT s.player_id, s.season, dim.position, s.games FROM s JOIN dim USING (player_id) WHERE dim.position IS NOT NULL AND (s.position IS NULL OR upper(s.position) <> dim.position))
      SELECT player_id, season, position, games, false AS replaced FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.player_id = s.player_id AND n.season = s.season) UNION ALL SELECT player_id, season, position, games, true FROM n""",
    "position_supplement": """WITH x AS (SELECT listing_id, source_id, upper(trim(position)) AS position FROM source_listings WHERE position IS NOT NULL), m AS (SELECT min(source_id) AS a, max(source_id) AS b FROM x), f AS (SELECT x.* FROM x, m WHERE source_id = a), k AS (SELECT position FROM f GROUP BY 1 HAVING count(*) >= 20)
      SELECT listing_id, position FROM f UNION SELECT listing_id, position FROM x, m WHERE source_id = b AND position NOT IN (SELECT position FROM k)""",
    "object_merge": "SELECT listing_id, coalesce(team, 'FA') AS team, coalesce(CASE WHEN NOT isnan(mean) THEN CAST(CAST(floor(mean) AS BIGINT) AS VARCHAR) END, '0') AS mean, coalesce(CASE WHEN NOT isnan(adp) THEN CAST(CAST(floor(adp) AS BIGINT) AS VARCHAR) END, '999') AS adp FROM source_listings",
    "unicode_name_key": f"WITH x AS (SELECT listing_id, regexp_replace(lower(name), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS wide, {_KEY} AS folded FROM source_listings WHERE name IS NOT NULL) SELECT *, wide <> folded AS differ FROM x",
    "club_codes": f"""WITH x AS (SELECT team FROM player_weeks WHERE team IS NOT NULL), b AS (SELECT team AS code FROM x UNION ALL SELECT coalesce([{_CODES}, NULL][(length(team) + ascii(team)) % {len(CLUBS) + 1} + 1], ' jac ') FROM x) SELECT code, {_CLUB.format('code')} AS club, count(*) AS n FROM b GROUP BY 1, 2""",
    "height_inches": "SELECT p_partkey, CAST(CASE WHEN (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_size % 13 < 12 THEN (5 + p_size % 3) * 12 + p_size % 13 END AS INTEGER) AS inches FROM part",
    "late_picks": """WITH x AS (SELECT user_id AS draft, event_id % 20 AS pick_no, event_id, ts FROM events), l AS (SELECT draft, pick_no, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, count(*) - 1 AS superseded FROM x GROUP BY 1, 2), e AS (SELECT draft, max(ts) AS e FROM x GROUP BY 1), a AS (SELECT l.*, floor(epoch(e)) - floor(epoch(ts)) AS age FROM l JOIN e USING (draft))
      SELECT draft, pick_no, event_id, superseded, CASE WHEN age > 259200 THEN '72h' WHEN age > 86400 THEN '24h' WHEN age > 120 THEN '120s' ELSE 'fresh' END AS age FROM a""",
    "heartbeat_stale": "WITH x AS (SELECT user_id, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events) SELECT user_id, count(*) FILTER (gap > 30) AS stale, max(gap) AS longest FROM x GROUP BY 1",
    "draft_state_errors": """WITH x AS (SELECT l_suppkey AS draft, CASE WHEN l_orderkey % 997 <> 0 THEN l_linenumber ELSE -1 END AS pick_no, CASE WHEN l_partkey % 89 <> 0 THEN l_partkey END AS player FROM lineitem), k AS (SELECT p_partkey FROM part WHERE p_size > 1),
      n AS (SELECT draft, pick_no, count(*) AS k, count(*) FILTER (player IS NULL) AS empty, count(*) FILTER (player IS NOT NULL AND p_partkey IS NULL) AS unknown FROM x LEFT JOIN k ON p_partkey = player GROUP BY 1, 2),
      g AS (SELECT draft, CAST(sum(CASE WHEN pick_no < 1 THEN k ELSE 0 END) AS BIGINT) AS invalid, CAST(sum(CASE WHEN pick_no >= 1 THEN k - 1 ELSE 0 END) AS BIGINT) AS repeated, CAST(sum(empty) AS BIGINT) AS empty, CAST(sum(unknown) AS BIGINT) AS unknown FROM n GROUP BY 1) SELECT *, invalid + repeated + empty + unknown = 0 AS valid FROM g""",
}
