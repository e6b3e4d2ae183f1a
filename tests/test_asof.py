import datetime as dt
import random

from pyspark.sql import functions as F

from draftloom.operators.asof import asof_attach

T0 = dt.datetime(2024, 1, 1)
EVENTS = "id long, k string, t timestamp_ntz, known string"
VERSIONS = "k string, at timestamp_ntz, no int, v long, extra string"


def attach(spark, events, versions, **kw):
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    out = asof_attach(e, v, event_key=[F.col("k")], event_time=F.col("t"), version_key=[F.col("k")], available=F.col("at"), order=[F.col("no")], values={"v": F.col("v")}, known_at="known", **kw)
    return sorted((r["id"], r["v"]) for r in out.collect())


def brute(events, versions):
    out = []
    for i, k, t, _ in events:
        seen = [(at, -1 if no is None else no, v) for kk, at, no, v, _ in versions if None not in (k, t, at) and kk == k and at <= t]
        out.append((i, max(seen)[2] if seen else None))
    return sorted(out, key=lambda r: r[0])


def data(n, keys, hot):
    rng = random.Random(5)
    key = lambda: "hot" if rng.random() < hot else f"k{rng.randrange(keys)}"
    at = lambda: T0 + dt.timedelta(minutes=rng.randrange(500))
    events = [(i, key(), at(), "clash") for i in range(n)]
    versions = [(key(), at(), i, i, "x") for i in range(n)]
    return events, versions


def test_matches_brute_force(spark):
    events, versions = data(300, 12, 0.1)
    assert attach(spark, events, versions) == brute(events, versions)


def test_hot_entity_is_sliced_and_salted(spark):
    events, versions = data(600, 6, 0.5)
    events += [(1000 + i, "hot", T0 + dt.timedelta(minutes=250), None) for i in range(100)]
    assert attach(spark, events, versions, hot_rows=20, bucket_rows=50) == brute(events, versions)


def test_nulls_ties_repeats(spark):
    late, tie = T0 + dt.timedelta(days=1), T0
    events = [(1, None, T0, None), (2, "a", None, None), (3, "a", T0, None), (3, "a", T0, None), (4, "b", T0, None)]
    versions = [("a", tie, 1, 10, None), ("a", tie, 2, 20, None), ("a", late, 3, 30, None), (None, T0, 1, 1, None), ("b", None, 1, 5, None)]
    assert attach(spark, events, versions) == [(1, None), (2, None), (3, 20), (3, 20), (4, None)]


def test_empty_tables(spark):
    assert attach(spark, [], []) == []
    assert attach(spark, [(1, "a", T0, None)], []) == [(1, None)]
