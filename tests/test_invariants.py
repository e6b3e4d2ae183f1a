"""What SQL twins cannot show: partition invariance, the sketch of ties, known values."""

import math

from pyspark.sql import functions as F

from draftloom.functions import grids, scalars
from draftloom.operators import resample
from draftloom.operators.identity import greedy_union


def py_uniform(seed, scenario, parts):
    m = 0xFFFFFFFF
    h = (seed ^ ((scenario + 1) * 0x9E3779B1)) & m
    for p in parts:
        h ^= p
        h = ((h ^ (h >> 16)) * 0x85EBCA6B) & m
    h = ((h ^ (h >> 16)) * 0x7FEB352D) & m
    h = ((h ^ (h >> 15)) * 0x846CA68B) & m
    return ((h ^ (h >> 16)) + 0.5) / 4294967296


def test_keyed_draws_do_not_depend_on_partitions(spark):
    want = [py_uniform(42, i, [scalars.fnv1a_of("x"), 7]) for i in range(50)]
    for n in (1, 4, 16):
        df = spark.range(0, 50, 1, n).select("id", resample.uniform(42, F.col("id"), [F.lit(scalars.fnv1a_of("x")).cast("long"), F.lit(7).cast("long")]).alias("u"))
        assert [r["u"] for r in df.orderBy("id").collect()] == want


def test_fnv_of_column_and_constant_agree(spark):
    r = spark.createDataFrame([("u1",), ("Player 7",)], "s string").select("s", scalars.fnv1a(F.col("s")).alias("h")).collect()
    assert all(x["h"] == scalars.fnv1a_of(x["s"]) for x in r)


def test_isotonic_repair(spark):
    df = spark.createDataFrame([([5.0, 12.0, 9.0, 20.0, 18.0],)], "v array<double>")
    r = df.select(grids.isotonic(F.col("v")).alias("i"), grids.running_max(F.col("v")).alias("m")).first()
    assert r["i"] == [5.0, 10.5, 10.5, 19.0, 19.0] and r["m"] == [5.0, 12.0, 12.0, 20.0, 20.0]


def test_grid_values(spark):
    df = spark.createDataFrame([([5.0, 10.0, 30.0],)], "v array<double>")
    at = lambda p: grids.quantile_at([0.1, 0.5, 0.9], F.col("v"), F.lit(p))
    got = list(df.select(at(0.3), at(0.7), at(0.0), at(1.0)).first())
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, [7.5, 20.0, 5.0, 30.0]))


def test_two_normal_functions_agree_closely(spark):
    df = spark.createDataFrame([(z / 4,) for z in range(-20, 21)], "z double").select("z", scalars.normal_cdf_erf(F.col("z")).alias("a"), scalars.normal_cdf_tail(F.col("z")).alias("b"))
    for r in df.collect():
        true = 0.5 * (1 + math.erf(r["z"] / math.sqrt(2)))
        assert abs(r["a"] - true) < 2e-7 and abs(r["b"] - true) < 2e-7


def test_greedy_union_is_greedy(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "x"), (5, "c", "z")]
    kept, a, b = [], set(), set()
    for i, p, q in rows:
        if p not in a and q not in b:
            kept.append(i)
            a.add(p)
            b.add(q)
    df = spark.createDataFrame(rows, "o int, p string, q string")
    assert sorted(r["o"] for r in greedy_union(df, "o", "p", "q").collect()) == kept


def test_a_null_key_blocks_nothing(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", "x"), (4, None, "x"), (5, None, "x")], "o long, p string, q string")
    assert sorted(r["o"] for r in greedy_union(df, "o", "p", "q").collect()) == [1, 2, 4]


def test_golden_names(spark):
    from draftloom.functions import scalars as S

    golden = {"José Núñez Jr.": "josenunez", "D'André Swift": "dandreswift", "Amon-Ra St. Brown": "amonrastbrown", "Kenneth Walker III": "kennethwalker", "Şerif Łoś": "serifos", "Jose\u0301": "jose", "  ": ""}
    df = spark.createDataFrame([(n,) for n in golden], "name string")
    got = {r[0]: r[1] for r in df.select("name", S.ascii_key(F.col("name"))).collect()}
    assert got == golden
    assert df.where("name like 'José%'").select(S.unicode_key(F.col("name"))).first()[0] == "josénúñezjr"
