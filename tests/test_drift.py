import numpy as np
import pytest
from pyspark.sql import functions as F

from draftloom.operators import drift

FIELDS = [("player_id", "string"), ("week", "int"), ("season_type", "string"), ("game_id", "string"), ("carries", "int")]


@pytest.mark.parametrize(("a", "b", "least"), [("seasonType", "season_type", 0.9), ("Game ID", "game_id", 0.9), ("tgts", "targets", 0.7), ("gid", "game_id", 0.85), ("seasn_type", "season_type", 0.8)])
def test_names_that_mean_the_same(a, b, least):
    assert drift.name_likeness(a, b) >= least


@pytest.mark.parametrize(("a", "b"), [("wind_mph", "carries"), ("snap_pct", "projected"), ("surface", "season"), ("air_yards", "week")])
def test_names_that_do_not(a, b):
    assert drift.name_likeness(a, b) < 0.3


def tables(spark, files):
    meta = [(i, f, s, fmt) for i, f, s, fmt, _ in files]
    lines = [(i, n + 1, line) for i, _, _, _, ls in files for n, line in enumerate(ls)]
    return spark.createDataFrame(meta, "file_id long, feed_id long, file_seq int, file_format string"), spark.createDataFrame(lines, "file_id long, line_no int, line string")


def columns_of(spark, files):
    meta, lines = tables(spark, files)
    meta = drift.ordered_files(meta)
    parsed = drift.parse_lines(meta, lines)
    profiled = drift.profile(parsed)
    return meta, parsed, drift.assigned(meta, profiled, drift.correspondences(meta, profiled, FIELDS))


FILES = [
    (1, 1, 1, "csv", ["# export", "player_id,week,season_type,game_id,carries", "a,1,REG,2012_01_AA_BB,3", "", "b,2,REG,2012_02_AA_BB,NA", "c,3,POST,2012_03_CC_BB", "a,1,REG,2012_01_AA_BB,3"]),
    (2, 1, 2, "csv", ['﻿"player_id"|week|seasonType|game_id|carries|wind_mph', "a|1|REG|2012_01_AA_BB|3.0|4.5", "b|2|POST|2012_02_AA_BB|1.0|7.25"]),
    (3, 1, 3, "jsonl", ['{"player_id": "a", "week": 4, "game": {"id": "2012_04_AA_BB"}, "carries": 2.0, "wind_mph": 1.5, "seasonType": "REG"}', '{"player_id": "b", "week": 5, "game": {"id": "2012_05_AA_BB"}, "carries": null, "wind_mph": 2.5, "seasonType": "REG"}']),
    (4, 2, 1, "csv", []),
]


def test_changes(spark):
    meta, _, columns = columns_of(spark, FILES)
    got = {(r["file_id"], r["field"], r["change"]) for r in drift.changes(meta, columns).collect()}
    assert got == {(2, "season_type", "renamed"), (2, "carries", "retyped"), (2, "wind_mph", "added"), (3, "game_id", "renamed")}


def test_unified_table(spark):
    _, parsed, columns = columns_of(spark, FILES)
    got = {(r["file_id"], r["line_no"]): r for r in drift.unify(parsed, columns, FIELDS).collect()}
    assert len(got) == 8
    assert got[2, 2]["carries"] == 3 and got[2, 2]["season_type"] == "REG" and got[2, 2]["extra"] == {"wind_mph": "4.5"}
    assert got[3, 1]["game_id"] == "2012_04_AA_BB" and got[3, 2]["carries"] is None
    assert got[1, 5]["carries"] is None and got[1, 6]["carries"] is None


def test_kinds(spark):
    df = spark.createDataFrame([("1", "whole"), ("-2.50", "decimal"), ("TRUE", "true/false"), ("W16", "text"), ("NA", None), ("", None), (None, None), ("3 car.", "text")], "v string, want string")
    for r in df.select("want", drift.value_kind(df["v"]).alias("got")).collect():
        assert r["got"] == r["want"]


def test_empty(spark):
    meta, parsed, columns = columns_of(spark, [])
    assert columns.count() == 0 and drift.changes(meta, columns).count() == 0


def test_flooding_that_has_not_settled_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(drift, "ROUNDS", 4)
    with pytest.raises(RuntimeError, match="not settled after 4 rounds"):
        columns_of(spark, FILES)


def renamed_feeds(n=4):
    """Feeds in which an opaque name takes the place of carries; its values are larger, as later in a season."""
    out = []
    for f in range(n):
        head = ["player_id,week,season_type,game_id,carries", *[f"a{i},{i % 5 + 1},REG,2012_0{i % 9 + 1}_AA_BB,{i % 9 + 1}" for i in range(20)]]
        later = ["player_id,week,season_type,game_id,q7", *[f"a{i},{i % 5 + 1},REG,2012_0{i % 9 + 1}_AA_BB,{i % 9 + 1 if i % 2 else 10 + i}" for i in range(20)]]
        out += [(2 * f + 1, f, 1, "csv", head), (2 * f + 2, f, 2, "csv", later)]
    return out


def test_flooding_changes_the_answer(spark, monkeypatch):
    meta, _, columns = columns_of(spark, renamed_feeds())
    got = {(r["field"], r["change"]) for r in drift.changes(meta, columns).collect()}
    assert got == {("carries", "renamed")}
    monkeypatch.setattr(drift, "flood", lambda nodes, edges: nodes.withColumnRenamed("s0", "s"))
    meta, _, columns = columns_of(spark, renamed_feeds())
    got = {(r["field"], r["change"]) for r in drift.changes(meta, columns).collect()}
    assert got == {("q7", "added"), ("carries", "removed")}


def test_flood_equals_the_fixed_point(spark):
    rng = np.random.default_rng(5)
    n = 12
    w = rng.random((n, n)) * (rng.random((n, n)) < 0.4)
    w = w / np.maximum(w.sum(0), 1.0)
    s0 = rng.random(n)
    nodes = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(s0)], "node string, s0 double")
    edges = spark.createDataFrame([(str(i), str(j), float(w[i, j])) for i in range(n) for j in range(n) if w[i, j] > 0], "src string, dst string, w double")
    want = np.linalg.solve(np.eye(n) - drift.FLOOD * w.T, s0 * (1 - drift.FLOOD * w.sum(0)))
    got = {int(r["node"]): r["s"] for r in drift.flood(nodes, edges).collect()}
    assert max(abs(got[i] - want[i]) for i in range(n)) < 2e-3


def test_pairs_of_all_sorts_are_linked(spark):
    meta, lines = tables(spark, FILES)
    meta = drift.ordered_files(meta)
    profiled = drift.profile(drift.parse_lines(meta, lines))
    start = profiled.select("name").distinct().crossJoin(spark.createDataFrame([(f,) for f, _ in FIELDS], "field string")).withColumn("s0", F.lit(0.5))
    none = spark.createDataFrame([], "name string, other string, w double")
    nodes, edges = drift.connectivity(profiled, start, none, FIELDS)
    sorts = {r[0] for r in nodes.select(F.substring("node", 1, 1)).distinct().collect()}
    assert sorts == {"n", "w", "p", "k"}
    assert edges.groupBy("dst").agg(F.sum("w").alias("w")).where("w > 1.000001").count() == 0
    ends = {tuple(r) for r in edges.select(F.substring("src", 1, 1), F.substring("dst", 1, 1)).distinct().collect()}
    assert ends == {(x, "n") for x in "wpk"} | {("n", x) for x in "wpk"}


def test_the_second_choice_where_the_first_is_taken():
    import pandas as pd

    offers = lambda *x: [{"field": f, "score": s} for f, s in x]
    columns = [{"name": "a", "kind": "whole", "offers": offers(("x", 0.9))}, {"name": "b", "kind": None, "offers": offers(("x", 0.8), ("y", 0.7))}, {"name": "c", "kind": "text", "offers": None}]
    got = next(drift._stable(iter([pd.DataFrame({"file_id": [1], "columns": [columns]})])))
    assert list(zip(got["name"], got["field"])) == [("a", "x"), ("b", "y"), ("c", "c")]


def test_unreadable_lines_stay_in_the_one_table(spark):
    files = [(1, 1, 1, "jsonl", ['{"player_id": "a", "week": 4, "carries": 2}', '{"player_id": "b", "wee', ""])]
    _, parsed, columns = columns_of(spark, files)
    got = {r["line_no"]: r for r in drift.unify(parsed, columns, FIELDS).collect()}
    assert set(got) == {1, 2} and got[1]["carries"] == 2 and got[1]["beyond_header"] is None
    assert got[2]["player_id"] is None and got[2]["beyond_header"] == '{"player_id": "b", "wee'
