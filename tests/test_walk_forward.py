"""Folds come from the data, learn from earlier seasons only and reach every season that has earlier labels."""

import random

from draftloom.operators import models


def examples(spark, seasons):
    rng = random.Random(3)
    rows = []
    for s in seasons:
        for i in range(60):
            x = rng.uniform(0, 10)
            rows.append((len(rows), s, None if s == max(seasons) else 5 * x + rng.gauss(0, 1), None if i % 7 == 0 else x))
    return spark.createDataFrame(rows, "id long, season int, y double, share double")


def test_every_season_after_the_first_is_forecast(spark):
    df = examples(spark, range(2027, 2031))
    for kind in ("ridge", "gbt"):
        got = models.walk_forward(df, "season", "y", ["share"], kind=kind).toPandas()
        # 2030 has no labels yet
        assert got.groupby("season").size().to_dict() == {2028: 60, 2029: 60, 2030: 60}
        assert got["prediction"].notna().all() and got["id"].is_unique


def test_a_fold_does_not_see_later_seasons(spark):
    df = examples(spark, range(2027, 2031))
    changed = df.withColumns({"share": models.F.expr("if(season = 2029, share + 1000, share)"), "y": models.F.expr("if(season = 2029, -y, y)")})
    one, two = (models.walk_forward(d, "season", "y", ["share"], kind="gbt").where("season = 2028").orderBy("id").toPandas() for d in (df, changed))
    assert one["prediction"].tolist() == two["prediction"].tolist()


def test_boosting_reaches_the_label(spark):
    df = examples(spark, range(2027, 2031))
    got = models.walk_forward(df, "season", "y", ["share"], seasons=[2029], kind="gbt").where("id % 60 % 7 <> 0").toPandas()
    assert (got["prediction"] - got["y"]).abs().mean() < 3


def test_one_season_gives_no_forecast(spark):
    assert models.walk_forward(examples(spark, [2027]), "season", "y", ["share"]).count() == 0



def test_offsets_are_medians_of_earlier_misses(spark):
    rows = [(i, 2020 + i // 10, float(i % 10), 5.0) for i in range(40)] + [(99, 2023, None, 5.0)]
    got = models.nested_offset(spark.createDataFrame(rows, "id long, season int, y double, prediction double"), "season", "y").toPandas()
    assert len(got) == 41
    assert got.groupby("season")["offset"].first().to_dict() == {2020: 0.0, 2021: -0.5, 2022: -0.5, 2023: -0.5}


def test_leaking_features_are_an_error(spark):
    import pytest

    df = spark.createDataFrame([(2020, 2021), (None, 2021)], "known int, season int")
    models.check_leakage(df, models.c("known"), models.c("season"))
    with pytest.raises(ValueError, match="leak"):
        models.check_leakage(df.union(spark.createDataFrame([(2021, 2021)], df.schema)), models.c("known"), models.c("season"))
