import math
import random

import pytest
from pyspark.sql import functions as F

from draftloom.llm import quantiles as q

PS = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
SCHEMA = "g string, x double, sign int, probability string"


def values(n=3000, seed=3):
    rng = random.Random(seed)
    pick = lambda: rng.choice([0.0, rng.gauss(0, 30), rng.expovariate(0.01), -rng.expovariate(2), 1e-12])
    return [("hot" if rng.random() < 0.6 else f"g{rng.randrange(4)}", pick(), 1, "clash") for _ in range(n)]


def sketched(spark, rows, **kw):
    return q.sketch(spark.createDataFrame(rows, SCHEMA), F.col("x"), {"g": F.col("g")}, **kw)


def check(got, rows, error=q.ERROR):
    by = {}
    for g, x, *_ in rows:
        by.setdefault(g, []).append(x)
    assert len(got) == len(by) * len(PS)
    for r in got:
        xs = sorted(by[r["g"]])
        exact = xs[math.floor(r["probability"] * (len(xs) - 1))]
        assert abs(r["value"] - exact) <= error * abs(exact) + 1e-9
        assert r["n"] == len(xs)


def test_error_bound(spark):
    rows = values()
    check(q.percentiles(sketched(spark, rows), ["g"], PS).collect(), rows)


def test_merged_loads_equal_one_load(spark):
    rows = values()
    parts = [sketched(spark, rows[i::3]) for i in range(3)]
    merged = q.merge(parts, ["g"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, sketched(spark, rows).collect()))


def test_rejects_are_counted(spark):
    rows = [("a", None, 1, ""), ("a", float("nan"), 1, ""), ("a", float("inf"), 1, ""), ("a", 1e6, 1, ""), ("a", 2.0, 1, ""), (None, 3.0, 1, ""), ("none", None, 1, "")]
    got = {(r["g"], r["probability"]): r for r in q.percentiles(sketched(spark, rows, valid=(-10, 100)), ["g"], [0.5, 0.5, None, 2.0, float("nan")]).collect()}
    assert len(got) == 3
    assert got["a", 0.5]["n"] == 1 and got["a", 0.5]["rejected"] == 4 and abs(got["a", 0.5]["value"] - 2) < 0.02
    assert got["none", 0.5]["value"] is None and got[None, 0.5]["n"] == 1


def test_empty_and_bad_parameters(spark):
    assert q.percentiles(sketched(spark, []), ["g"], PS).count() == 0
    with pytest.raises(ValueError):
        q.gamma(1.5)
