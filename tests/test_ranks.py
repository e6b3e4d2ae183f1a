import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from draftloom.operators import consensus, ranks, stats

c = F.col


def table(n=900, seed=3):
    """A third of all rows in one group, many ties, a null group, null and NaN values."""
    rng = np.random.default_rng(seed)
    group = ["hot"] * (n // 3) + [None] * 20 + [f"g{i}" for i in rng.integers(0, 12, n - n // 3 - 20)]
    value = np.where(rng.random(n) < 0.4, 0.0, rng.integers(-30, 30, n).astype(float))
    rows = [(i, g, None if i % 97 == 0 else float("nan") if i % 89 == 0 else float(v), float(rng.integers(1, 5))) for i, (g, v) in enumerate(zip(group, value))]
    return rows


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(table(), "id long, g string, v double, w double")


def test_places_and_running_sums(df):
    x = ranks.cumulative(df, ["g"], [c("v").asc_nulls_first(), c("id")], {"one": F.lit(1), "w": c("w")}).toPandas()
    assert len(x) == 900
    for _, part in x.groupby("g", dropna=False):
        part = part.sort_values("one_upto")
        assert list(part["one_upto"]) == list(range(1, len(part) + 1)) and set(part["one_all"]) == {len(part)}
        assert np.allclose(part["w_upto"], part["w"].cumsum()) and np.allclose(part["w_all"], part["w"].sum())
        known = part["v"].dropna()
        assert known.is_monotonic_increasing


def test_quantiles_and_ranks(df):
    known = pd.DataFrame(table(), columns=["id", "g", "v", "w"]).dropna(subset=["v"])
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.93, 1.0]).collect()}
    for g, part in known.groupby("g", dropna=False):
        g = None if not isinstance(g, str) else g
        assert got[g]["n"] == len(part)
        assert np.allclose(got[g]["q"], np.quantile(part["v"], [0.0, 0.1, 0.5, 0.93, 1.0]))
    average = ranks.average_ranks(df.where("g = 'hot'"), ["g"], "v").toPandas().set_index("v")["rank"]
    hot = known[known["g"] == "hot"]
    assert np.allclose(hot["v"].rank().to_numpy(), average.loc[hot["v"]].to_numpy())


def test_weighted_quantile_and_spearman(df):
    known = pd.DataFrame(table(), columns=["id", "g", "v", "w"]).dropna(subset=["v", "g"])
    got = {r["g"]: r["q"] for r in stats.quantile_weighted(df.where("g is not null"), ["g"], "v", "w", 0.4).collect()}
    rho = {r["g"]: r["spearman"] for r in stats.spearman(df.where("g is not null and v is not null and not isnan(v)"), ["g"], "v", "w").collect()}
    for g, part in known.groupby("g"):
        part = part.sort_values("v")
        assert got[g] == part["v"][part["w"].cumsum() >= 0.4 * part["w"].sum()].iloc[0]
        assert rho[g] == pytest.approx(part["v"].rank().corr(part["w"].rank()))


def test_the_hot_group_spans_slices(df):
    from draftloom.session import stage

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(df.repartitionByRange(parts, "g", "v", "id").withColumn("s", F.spark_partition_id()))
    assert cut.where("g = 'hot'").select("s").distinct().count() > 1


def test_empty(spark, df):
    none = df.limit(0)
    assert ranks.placed(none, ["g"], [c("v")]).count() == 0
    assert ranks.quantiles(none, ["g"], "v", [0.5]).count() == 0


def test_neighbours_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], float(rng.integers(0, 200)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, g string, t double, r double")
    run = lambda: {r["k"]: r["bias"] for r in consensus.neighbour_bias(df, "g", "k", "t", "r", 5).collect()}
    whole = run()
    monkeypatch.setattr(consensus, "BLOCK", 16)
    cut = run()
    assert whole == cut and len(cut) == 300
