"""Queries of the general data-preparation problems 1, 2 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftloom.operators import asof, drift, impute
from draftloom.session import read, stage

SKILL = ("RB", "WR", "TE")


def filled_examples(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """player_examples (or its columns ``keep``) with games_lag2, target_share and year_end_role_missing filled and marked."""
    x = read(spark, sf_dir, "player_examples")
    c = F.col
    # what the same player's record of the season before said; repeated records count once
    before = x.groupBy("player_id", (c("season") + 1).alias("season")).agg(*[F.max(F.when(~F.isnan(n), c(n))).alias(f"before_{n}") for n in ("games_lag1", "target_share", "year_end_role_missing", "fantasy_points_ppr_lag1", "year_end_opportunity_share")])
    wide = x.join(before, ["player_id", "season"], "left").select(*x.columns, *[n for n in before.columns if n.startswith("before_")])
    skill = c("position").isin(*SKILL) & (c("experience") >= 1)
    games_ok = c("games_lag2").between(0, 17) & ~((c("games_lag2") == 0) & F.coalesce(c("fantasy_points_ppr_lag2") > 0, F.lit(False)))
    share_ok = c("target_share").between(0, 1) & ~((c("target_share") == 0) & F.coalesce(c("targets_lag1") > 0, F.lit(False)))
    plain = ["age", "depth_rank", "games_lag1", "games_lag3", "fantasy_points_ppr_lag1", "fantasy_points_ppr_lag2", "targets_lag1", "year_end_opportunity_share", "before_games_lag1", "before_target_share", "before_fantasy_points_ppr_lag1", "before_year_end_opportunity_share"]
    filled = impute.fill(
        wide,
        [
            impute.Target("games_lag2", c("experience") >= 2, 0, 17, whole=True, positive=c("fantasy_points_ppr_lag2") > 0, least_positive=1.0),
            impute.Target("target_share", skill, 0, 1, positive=c("targets_lag1") > 0, least_positive=0.001),
            impute.Target("year_end_role_missing", skill, 0, 1),
        ],
        [impute.Number("games_lag2", c("games_lag2"), games_ok), impute.Number("target_share", c("target_share"), share_ok), *[impute.Number(n, c(n), c(n) >= 0) for n in plain], impute.Number("experience", c("experience").cast("double"))],
        [
            impute.Category("year_end_role_missing", c("year_end_role_missing"), (0.0, 1.0), c("year_end_role_missing").isin(0.0, 1.0)),
            impute.Category("share_known", F.when(c("experience") >= 1, (c("year_end_opportunity_share").isNotNull() & ~F.isnan("year_end_opportunity_share")).cast("string")), ("false", "true")),
            impute.Category("position", c("position"), ("K", "QB", "RB", "TE", "WR")),
        ],
        [c("position"), c("season")],
        keep=keep or x.columns,
    )
    return filled


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_examples(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that the imputation filled with a valid value, one row each."""
    c = F.col
    valid = {"games_lag2": c("games_lag2").between(0, 17) & (c("games_lag2") == F.floor("games_lag2")), "target_share": c("target_share").between(0, 1), "year_end_role_missing": c("year_end_role_missing").isin(0.0, 1.0)}
    cells = F.array(*[F.when(c(f"{f}_filled") & ok, F.lit(f)) for f, ok in valid.items()])
    return filled_examples(spark, sf_dir, ["example_id"]).select("example_id", F.explode(F.array_compact(cells)).alias("field")).distinct()


P1_SQL = """
SELECT example_id, 'games_lag2' AS field FROM player_examples
WHERE experience >= 2 AND (games_lag2 IS NULL OR isnan(games_lag2) OR games_lag2 < 0 OR games_lag2 > 17 OR (games_lag2 = 0 AND coalesce(fantasy_points_ppr_lag2 > 0 AND NOT isnan(fantasy_points_ppr_lag2), false)))
UNION ALL
SELECT example_id, 'target_share' FROM player_examples
WHERE position IN ('RB','WR','TE') AND experience >= 1 AND (target_share IS NULL OR isnan(target_share) OR target_share < 0 OR target_share > 1 OR (target_share = 0 AND coalesce(targets_lag1 > 0 AND NOT isnan(targets_lag1), false)))
UNION ALL
SELECT example_id, 'year_end_role_missing' FROM player_examples
WHERE position IN ('RB','WR','TE') AND experience >= 1 AND (year_end_role_missing IS NULL OR isnan(year_end_role_missing) OR year_end_role_missing NOT IN (0, 1))
"""


def known_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_examples with the games of the season before as known at the cutoff."""
    x, s = read(spark, sf_dir, "player_examples"), read(spark, sf_dir, "player_seasons")
    c = F.col
    return asof.asof_attach(
        x, s, event_key=[c("player_id"), c("season")], event_time=c("cutoff_at"), version_key=[c("player_id"), (c("season") + 1).cast("int")], available=c("recorded_at"), order=[c("version_no"), c("stat_row_id")], values={"known_games": c("games"), "known_version": c("version_no")}, known_at="known_recorded_at",
    )


def _reasons() -> dict:
    c = F.col
    stored = c("games_lag1").isNotNull() & ~F.isnan("games_lag1")
    return {"cutoff_not_before": F.coalesce(c("feature_cutoff_season") >= c("season"), F.lit(False)), "unknown_stored": stored & c("known_games").isNull(), "other_value": F.coalesce(stored & (c("games_lag1") != c("known_games")), F.lit(False))}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = _reasons()
    return known_games(spark, sf_dir).where(why["cutoff_not_before"] | why["unknown_stored"] | why["other_value"]).select("example_id")


def p5_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each example with the games that were known at its cutoff and what is wrong with the stored value, if anything."""
    why = _reasons()
    return known_games(spark, sf_dir).select("example_id", "games_lag1", "known_games", "known_version", F.concat_ws(",", *[F.when(v, F.lit(k)) for k, v in why.items()]).alias("problems"))


_P5 = """
WITH known AS (
  SELECT e.example_id, e.season, e.feature_cutoff_season, e.games_lag1, s.games AS known_games, s.version_no AS known_version,
    row_number() OVER (PARTITION BY e.example_id ORDER BY s.recorded_at DESC NULLS LAST, s.version_no DESC, s.stat_row_id DESC) AS rn
  FROM player_examples e LEFT JOIN player_seasons s ON s.player_id = e.player_id AND s.season = e.season - 1 AND s.recorded_at <= e.cutoff_at)
"""
P5_SQL = (
    _P5
    + """SELECT example_id FROM known WHERE rn = 1 AND (coalesce(feature_cutoff_season >= season, false)
  OR (games_lag1 IS NOT NULL AND NOT isnan(games_lag1) AND (known_games IS NULL OR games_lag1 <> known_games)))"""
)
P5_KNOWN_SQL = (
    _P5
    + """SELECT example_id, games_lag1, known_games, known_version, concat_ws(',',
  CASE WHEN feature_cutoff_season >= season THEN 'cutoff_not_before' END,
  CASE WHEN games_lag1 IS NOT NULL AND NOT isnan(games_lag1) AND known_games IS NULL THEN 'unknown_stored' END,
  CASE WHEN games_lag1 IS NOT NULL AND NOT isnan(games_lag1) AND games_lag1 <> known_games THEN 'other_value' END) AS problems
FROM known WHERE rn = 1"""
)

def _drift(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple[str, str]]]:
    schema = read(spark, sf_dir, "player_weeks").dtypes
    files = drift.ordered_files(read(spark, sf_dir, "stats_files"))
    parsed = stage(drift.parse_lines(files, read(spark, sf_dir, "stats_file_lines")), "drift-lines")
    profiled = stage(drift.profile(parsed), "drift-profile")
    matches = drift.correspondences(files, profiled, schema)
    return files, parsed, stage(drift.assigned(files, profiled, matches), "drift-columns"), schema


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _, columns, _ = _drift(spark, sf_dir)
    return drift.changes(files, columns).select("file_id", "field", "change").distinct()


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All data lines of all files as one table with the columns of player_weeks."""
    _, parsed, columns, schema = _drift(spark, sf_dir)
    return drift.unify(parsed, columns, schema).withColumn("extra", F.to_json("extra"))


QUERIES = {"p2_found": p2_found, "p2_unified": p2_unified, "p1_found": p1_found, "p1_filled": p1_filled, "p5_found": p5_found, "p5_known": p5_known}
ORACLE = {"p1_found": P1_SQL, "p5_found": P5_SQL, "p5_known": P5_KNOWN_SQL}
