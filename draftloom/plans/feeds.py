"""Queries on sources, sinks, text, streams and fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftloom.operators import models as M
from draftloom.operators import season
from draftloom.plans.temporal import _seasons
from draftloom.session import read, shared_dir
from draftloom.sources import readers
from draftloom.streaming import picks as P

c = F.col
R = lambda x, n=6: F.round(x, n)


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/draftloom/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """player_seasons written as gzip CSV by season and read back as one typed table."""
    path = _scratch(spark, "csv")
    rows = read(spark, d, "player_seasons").select("stat_row_id", "player_id", "season", "games", "player_display_name")
    rows.write.option("header", True).option("compression", "gzip").option("escape", '"').csv(path)
    back = readers.read_csv_union(spark, [path], ["player_id", "season"], "stat_row_id long, player_id string, season int, games int, player_display_name string")
    return back.select("stat_row_id", "player_id", "season", "games", "player_display_name")


def json_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "jsonl")
    read(spark, d, "players").select("roster_row_id", "player_id", "name", "team").write.json(path)
    return readers.read_json_lines(spark, path, "roster_row_id long, player_id string, name string, team string")


def json_tree_keys(spark: SparkSession, d: str) -> DataFrame:
    """A tree season/position of JSON files, its keys taken from the path."""
    path = _scratch(spark, "tree")
    read(spark, d, "player_seasons").select("stat_row_id", "games", c("season").alias("s"), c("position").alias("p")).write.partitionBy("s", "p").json(path)
    return readers.read_tree(spark, f"{path}/*/*/*.json", "stat_row_id long, games int", {"season": r"/s=(\d+)/", "position": r"/p=([A-Z]+)/"}).select("stat_row_id", "games", c("season").cast("int").alias("season"), "position")


def snapshot_once(spark: SparkSession, d: str) -> DataFrame:
    """A content-addressed snapshot written twice is there once."""
    root, rows = _scratch(spark, "snap"), read(spark, d, "players").select("player_id", "team")
    a, b = readers.write_once(rows, root, "roster"), readers.write_once(rows.orderBy("team"), root, "roster")
    return spark.read.parquet(a).groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.lit(a == b).alias("same"))


def csv_record_in_column(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "stats_file_lines").where("line like '00-%,%' and line not like '%;%'")
    return lines.select("file_id", "line_no", readers.parse_csv_text(c("line"), "a string, b string").alias("x")).select("file_id", "line_no", "x.a", "x.b")


def csv_records(spark: SparkSession, d: str) -> DataFrame:
    """Every data line of the comma-delimited files with all its cells; csv_record_in_column has two cells of some lines."""
    return readers.csv_records(read(spark, d, "stats_file_lines"))


def html_rows(spark: SparkSession, d: str) -> DataFrame:
    """Part prices rendered as HTML pages of up to a hundred rows, and scraped again."""
    cell = F.concat(F.lit("<tr><td>"), c("p_partkey").cast("string"), F.lit("</td><td><b>"), c("p_brand"), F.lit("</b></td></tr>"))
    page = F.floor(c("p_partkey") / 100)
    pages = read(spark, d, "part").groupBy("p_brand", page.alias("page")).agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(cell)), "\n"), F.lit("</table>")).alias("html"))
    return pages.select(F.explode(readers.html_cells(c("html"))).alias("r")).select(c("r")[0].cast("long").alias("p_partkey"), c("r")[1].alias("brand"))


def text_regex_rows(spark: SparkSession, d: str) -> DataFrame:
    """Links in documents, by their order in the text."""
    x = read(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"https?://([a-z\-]+)\."), F.lit(1))).alias("i", "host"))
    return x.select("doc_id", "i", "host")


def participation_explode(spark: SparkSession, d: str) -> DataFrame:
    """Tags split and exploded; the share of a source's tagged documents that carry each tag."""
    t = read(spark, d, "documents").where("tags is not null").select("source", "doc_id", F.explode(F.split("tags", r"\|")).alias("tag"))
    total = t.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"))
    return t.groupBy("source", "tag").agg(F.countDistinct("doc_id").alias("n")).join(total, "source").select("source", "tag", "n", R(c("n") / c("docs"), 9).alias("share"))


def modal_value(spark: SparkSession, d: str) -> DataFrame:
    """The commonest position of each player, ties to the first by name."""
    n = read(spark, d, "player_weeks").where("position is not null").groupBy("player_id", F.upper("position").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("player_id").agg(F.min_by("position", F.struct(-c("n"), "position")).alias("position"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return x.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


def control_characters(spark: SparkSession, d: str) -> DataFrame:
    clean = F.substring(F.trim(F.regexp_replace("title", r"[\x00-\x1f\x7f]+", " ")), 1, 80)
    return read(spark, d, "documents").where("title is not null").select("doc_id", clean.alias("title"))


def retention_prune(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select("doc_id", "source", "created_at", "n_chars")
    kept = readers.prune(files, "source", [c("created_at").desc_nulls_last(), c("doc_id").desc()], "n_chars", 50, 100_000)
    return kept.select("doc_id", "keep")


def capture_throttle(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", "ts")
    return P.throttle(e, "user_id", "ts", "event_id", 6 * 3600).select("user_id", "event_id")


def latest_state_upsert(spark: SparkSession, d: str) -> DataFrame:
    return P.latest_state(read(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


def _picks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(c("l_orderkey").alias("draft"), c("l_linenumber").alias("pick_no"), "l_partkey")


def contiguity_gate(spark: SparkSession, d: str) -> DataFrame:
    return P.contiguous_prefix(_picks(spark, d), "draft", "pick_no", "l_partkey")


def pick_log_state(spark: SparkSession, d: str) -> DataFrame:
    """An event-sourced pick log folded to the board that stands."""
    kind = F.when(c("event_id") % 97 == 0, "reset|0|").when(c("event_id") % 11 == 0, F.concat(F.lit("undo|"), (c("event_id") % 7).cast("string"), F.lit("|"))).otherwise(F.concat(F.lit("append|"), (c("event_id") % 13).cast("string"), F.lit("|p"), c("event_id").cast("string")))
    log = read(spark, d, "events").select(c("user_id").alias("draft"), c("event_id").alias("seq"), kind.alias("message"))
    return P.decode_log(log, "draft", "seq", "message")


def _board_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    size = F.pmod(c("event_id") * 7, F.lit(9)).cast("int")
    board = F.to_json(F.transform(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("n"), (i * 3 + F.floor(c("event_id") / 40).cast("int")).alias("p"))))
    return e.select(c("user_id").cast("string").alias("key"), c("event_id").alias("seq"), F.when(c("event_id") % 10 == 0, "heartbeat").otherwise("state").alias("kind"), F.lit("s1").alias("session"), F.concat(F.lit("r"), F.floor(c("event_id") / 4000).cast("string")).alias("run"), board.alias("picks"), c("event_id").alias("at"), F.lit(8).alias("total"), F.when(c("event_id") % 3 == 0, "drafting").otherwise("complete").alias("status"))


def stable_picks_stream(spark: SparkSession, d: str) -> DataFrame:
    """The board of every draft after each event, run as a stream over files."""
    source, out, checkpoint = _scratch(spark, "events"), _scratch(spark, "states"), _scratch(spark, "progress")
    events = _board_events(spark, d)
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    query = P.stream_state(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(P.OUT).parquet(out)


def stable_picks_batch(spark: SparkSession, d: str) -> DataFrame:
    return P.batch_state(_board_events(spark, d))


FEATURES = ["games_lag1", "games_lag2", "fantasy_points_ppr_lag1", "fantasy_points_ppr_lag2", "targets_lag1", "age", "depth_rank"]


def ridge_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "player_examples").select("example_id", "season", "target_ppr_total", *FEATURES)
    return M.walk_forward(x, "season", "target_ppr_total", FEATURES).select("example_id", "season", R("prediction", 4).alias("prediction"))


def ridge_nested_offset(spark: SparkSession, d: str) -> DataFrame:
    """The ridge forecasts shifted by the median miss of the forecasts of all earlier seasons, themselves out of fold."""
    x = read(spark, d, "player_examples").select("example_id", "season", "target_ppr_total", *FEATURES)
    out = M.nested_offset(M.walk_forward(x, "season", "target_ppr_total", FEATURES), "season", "target_ppr_total")
    return out.select("example_id", "season", R("offset", 4).alias("offset"), R("adjusted", 4).alias("adjusted"))


def gbt_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "player_examples").select("example_id", "season", "target_ppr_total", *FEATURES)
    return M.walk_forward(x, "season", "target_ppr_total", FEATURES, kind="gbt").select("example_id", "season", R("prediction", 4).alias("prediction"))


def finish_draft(spark: SparkSession, d: str) -> DataFrame:
    """A thousand keyed snake drafts of 12 teams and 16 rounds from the newest season's board, with needs, caps, completion
    and a lookahead of 32: how often each team gets each player, and when."""
    s = _seasons(spark, d).where("position is not null and fantasy_points_ppr is not null and not isnan(fantasy_points_ppr)").withColumn("position", F.upper(F.trim("position"))).where(c("position").isin(*season.POSITIONS))
    newest = s.join(F.broadcast(s.agg(F.max("season").alias("season"))), "season")
    # who stands later than twice the number of picks is drafted in no scenario
    board = newest.orderBy(c("fantasy_points_ppr").desc(), "player_id").limit(2 * 12 * 16).select(c("player_id").alias("key"), "position").toPandas()
    board["center"], board["spread"] = range(1, len(board) + 1), 8.0
    drafts = season.drafts(board, spark.range(0, 1000, 1, 16).withColumnRenamed("id", "scenario"), season.League(), 19)
    return drafts.groupBy("team", "key").agg(F.count(F.lit(1)).alias("n"), R(F.avg("round"), 6).alias("mean_round"))


def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "player_weeks").where("player_id <> '00-0000000' and fantasy_points is not null and not isnan(fantasy_points) and abs(fantasy_points) < 100")
    one = w.groupBy("player_id", "season", "week").agg(F.max_by("fantasy_points", F.struct("loaded_at", "week_row_id")).alias("v"))
    run = lambda k, g: M.block_bootstrap(g, "v", "week", 4, 200, 17, 3).assign(player_id=k[0], season=k[1])[["player_id", "season", "p10", "p50", "p90"]]
    return one.groupBy("player_id", "season").applyInPandas(run, "player_id string, season int, p10 double, p50 double, p90 double")


QUERIES = {f.__name__: f for f in (csv_round_trip, json_lines_round_trip, json_tree_keys, snapshot_once, csv_record_in_column, csv_records, html_rows, text_regex_rows, participation_explode, modal_value, json_props, control_characters, retention_prune, capture_throttle, latest_state_upsert, contiguity_gate, pick_log_state, stable_picks_stream, stable_picks_batch, ridge_walk_forward, ridge_nested_offset, gbt_walk_forward, finish_draft, block_bootstrap)}
ORACLE = {
    "csv_round_trip": "SELECT stat_row_id, player_id, season, games, player_display_name FROM player_seasons",
    "json_lines_round_trip": "SELECT roster_row_id, player_id, name, team FROM players",
    "json_tree_keys": "SELECT stat_row_id, games, season, position FROM player_seasons",
    "snapshot_once": "SELECT team, count(*) AS n, true AS same FROM players GROUP BY 1",
    "csv_record_in_column": "SELECT file_id, line_no, nullif(split_part(line, ',', 1), '') AS a, nullif(split_part(line, ',', 2), '') AS b FROM stats_file_lines WHERE line LIKE '00-%,%' AND line NOT LIKE '%;%'",
    "html_rows": "SELECT p_partkey, p_brand AS brand FROM part",
    "text_regex_rows": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, h[i] AS host FROM (SELECT doc_id, regexp_extract_all(text, 'https?://([a-z\\-]+)\\.', 1) AS h FROM documents), range(1, 1000) t(i) WHERE i <= len(h)",
    "participation_explode": "WITH t AS (SELECT source, doc_id, unnest(string_split(tags, '|')) AS tag FROM documents WHERE tags IS NOT NULL), s AS (SELECT source, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1) SELECT t.source, tag, count(DISTINCT doc_id) AS n, round(count(DISTINCT doc_id) / any_value(docs), 9) AS share FROM t JOIN s USING (source) GROUP BY 1, 2",
    "modal_value": "SELECT player_id, position FROM (SELECT player_id, upper(position) AS position, row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, upper(position)) AS rn FROM player_weeks WHERE position IS NOT NULL GROUP BY 1, 2) WHERE rn = 1",
    "json_props": "SELECT event_type, CAST(props ->> '$.k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "control_characters": "SELECT doc_id, substr(trim(regexp_replace(title, '[\\x00-\\x1f\\x7f]+', ' ', 'g')), 1, 80) AS title FROM documents WHERE title IS NOT NULL",
    "retention_prune": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC NULLS LAST, doc_id DESC) <= 50 AS e FROM documents)
      SELECT doc_id, e AND sum(CASE WHEN e THEN n_chars ELSE 0 END) OVER (PARTITION BY e ORDER BY created_at DESC NULLS LAST, doc_id DESC ROWS UNBOUNDED PRECEDING) <= 100000 AS keep FROM p""",
    "capture_throttle": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 21600) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
    "latest_state_upsert": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "contiguity_gate": """WITH e AS (SELECT l_orderkey AS draft, l_linenumber AS n, count(DISTINCT l_partkey) AS claims FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY draft ORDER BY n) AS rn FROM e),
      t AS (SELECT draft, max(claims) AS claims, count(*) FILTER (n = rn) AS ready, count(*) AS seen FROM r GROUP BY 1) SELECT draft, CAST(CASE WHEN claims > 1 THEN 0 ELSE ready END AS INTEGER) AS ready, CAST(seen AS INTEGER) AS seen, CASE WHEN claims > 1 THEN 'conflict' WHEN ready < seen THEN 'gap' ELSE 'ready' END AS status FROM t""",
    "pick_log_state": """WITH m AS (SELECT user_id AS draft, event_id AS s, CASE WHEN event_id % 97 = 0 THEN 'reset' WHEN event_id % 11 = 0 THEN 'undo' ELSE 'append' END AS kind, CAST(CASE WHEN event_id % 97 = 0 THEN 0 WHEN event_id % 11 = 0 THEN event_id % 7 ELSE event_id % 13 END AS INTEGER) AS n FROM events),
      r AS (SELECT draft, max(s) AS reset_at FROM m WHERE kind = 'reset' GROUP BY 1), l AS (SELECT m.* FROM m LEFT JOIN r USING (draft) WHERE s > coalesce(reset_at, -1)), a AS (SELECT draft, n, max(s) AS s FROM l WHERE kind = 'append' GROUP BY 1, 2)
      SELECT draft, n, 'p' || s AS player FROM a WHERE NOT EXISTS (SELECT 1 FROM l u WHERE u.kind = 'undo' AND u.draft = a.draft AND u.s > a.s AND u.n <= a.n)""",
}
