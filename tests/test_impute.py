import numpy as np
import pytest
from pyspark.sql import functions as F

from draftloom.operators import impute
from draftloom.plans import problems
from draftloom.session import read, stage

c = F.col
SCHEMA = "id long, g string, a double, b double, d double, flag double, x_filled string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return impute.fill(
        df,
        [impute.Target("a", F.lit(True), 0, 10, whole=True), impute.Target("flag", c("g") != "z")],
        [impute.Number("a", c("a"), c("a").between(0, 10)), impute.Number("b", c("b")), impute.Number("d", c("d"))],
        [impute.Category("flag", c("flag"), (0.0, 1.0), c("flag").isin(0.0, 1.0)), impute.Category("g", c("g"))],
        [c("g")],
        rank=3,
        ridge=0.5,
    )


def table(n=400, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        u = rng.normal()
        out.append((i, "pq"[i % 2], float(np.clip(round(5 + 2 * u), 0, 10)), 3 * u + rng.normal() * 0.1, -u, float(u > 0), "keep"))
    return out


def test_held_out_cells_are_close(spark):
    truth = {r[0]: r for r in table()}
    rows = [(i, g, None if i % 10 == 0 else a, b, d, None if i % 10 == 5 else f, x) for i, g, a, b, d, f, x in truth.values()]
    got = {r["id"]: r for r in run(spark, rows).collect()}
    filled = [i for i in got if i % 10 == 0]
    assert all(got[i]["a_filled"] for i in filled) and not any(got[i]["a_filled"] for i in got if i % 10)
    error = np.mean([abs(got[i]["a"] - truth[i][2]) for i in filled])
    assert error < 1.0
    flags = [got[i]["flag"] == truth[i][5] for i in got if i % 10 == 5]
    assert np.mean(flags) >= 0.8
    assert all(got[i]["a"] == truth[i][2] for i in got if i % 10)


def test_unusable_nan_and_unknown_group(spark):
    rows = table(40) + [(100, None, float("nan"), None, None, 7.0, None), (101, "z", -3.0, None, None, None, None), (101, "z", -3.0, None, None, None, None)]
    got = [r for r in run(spark, rows).collect() if r["id"] >= 100]
    assert len(got) == 3
    for r in got:
        assert r["a_filled"] and 0 <= r["a"] <= 10 and r["a"] == int(r["a"])
    assert all(r["flag"] is None and not r["flag_filled"] for r in got if r["g"] == "z")
    assert {r["x_filled"] for r in got} == {None}


def test_empty_table(spark):
    out = run(spark, [])
    assert out.count() == 0 and {"a_filled", "flag_filled"} <= set(out.columns)


def test_the_fit_settles_and_starts_near_its_end(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2)) @ rng.normal(size=(2, 9)) + rng.normal(size=(600, 9)) * 0.1
    x[rng.random(x.shape) < 0.2] = np.nan
    cells = spark.createDataFrame([([None if np.isnan(a) else float(a) for a in row],) for row in x], "c array<double>")
    v, rmse = impute.fit(cells, 9, rank=2, ridge=0.1)
    assert v.shape == (9, 2) and len(rmse) < 40 and rmse[-1] < 0.15
    with pytest.warns(RuntimeWarning, match="not settled"):
        impute.fit(cells, 9, rank=2, ridge=0.1, iterations=1)


def test_found_rows_come_from_decoded_values(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    assert problems.p1_found(spark, d).count() > 0
    assert "ArrowEvalPython" in problems.p1_found(spark, d)._jdf.queryExecution().toString()
    nothing = lambda x, v, ridge: (np.full((len(x), v.shape[1]), np.nan), (~np.isnan(x)).astype(float))
    found = problems.p1_found(spark, d)
    monkeypatch.setattr(impute, "fit", lambda cells, width, *a, **k: (np.full((width, impute.RANK), np.nan), []))
    monkeypatch.setattr(impute, "_solve_rows", nothing)
    undecoded = problems.p1_found(spark, d)
    assert undecoded.count() == 0 < found.count()


def test_hidden_cells_of_the_sample_come_back_better_than_group_means(spark, tmp_path):
    """A tenth of the usable cells, by a hash of the id: closer than the mean of their position and season."""
    d = "/root/testdata/sf0.01"
    x = read(spark, d, "player_examples")
    hide = lambda f: F.pmod(F.xxhash64("example_id", F.lit(f)), F.lit(10)) == 0
    usable = {"games_lag2": (c("experience") >= 2) & c("games_lag2").between(1, 17), "target_share": c("position").isin("RB", "WR", "TE") & (c("experience") >= 1) & (c("target_share") > 0) & (c("target_share") <= 1)}
    hidden = x
    for f in usable:
        hidden = hidden.withColumn(f, F.when(~hide(f), c(f)))
    hidden.write.parquet(str(tmp_path / "player_examples.parquet"))
    got = stage(problems.p1_filled(spark, str(tmp_path)))
    for f, ok in usable.items():
        truth = x.where(ok & hide(f)).select("example_id", "position", "season", c(f).alias("truth"))
        mean = x.where(ok & ~hide(f)).groupBy("position", "season").agg(F.avg(f).alias("mean"))
        r = truth.join(got.select("example_id", c(f).alias("got")), "example_id").join(mean, ["position", "season"], "left").agg(F.avg(F.abs(c("got") - c("truth"))).alias("a"), F.avg(F.abs(c("mean") - c("truth"))).alias("b"), F.corr("got", "truth").alias("r"), F.count("truth").alias("n")).first()
        print(f, r)
        assert r["n"] > 50 and r["a"] < 0.9 * r["b"] and r["r"] > 0.5, (f, r)
