"""Attributes as known at event time: hash-partitioned entities, one embedded DuckDB ASOF LEFT JOIN per bucket.

Versions of an entity are first reduced to availability-ordered current states: of versions that became available at
the same instant only the one with the highest version order is kept (ties are resolved before the join, so the ASOF
join meets strictly increasing times). Events and states are then hash-partitioned into buckets of bounded size and
each bucket is joined by DuckDB in one pass over sorted inputs.

A hot entity (more than ``hot_rows`` events or versions) is cut into slices of time. A slice gets the last state before
it as a carried row, so it needs no other slice; a slice whose events still exceed the bound (all at one instant) has
its events salted and its few states repeated for every salt. No task ever sees an unbounded group.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HOT_ROWS = 100_000
BUCKET_ROWS = 250_000
_P = "__asof_"


def current_states(versions: DataFrame, key: list[Column], available: Column, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """One state per (key, instant): the version with the highest ``order``. Versions without key or instant are never known."""
    k = [c.alias(f"{_P}k{i}") for i, c in enumerate(key)]
    names = [f"{_P}k{i}" for i in range(len(key))]
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    flat = versions.select(*k, available.alias(f"{_P}t"), F.struct(*order).alias(f"{_P}o"), row.alias(f"{_P}v"))
    flat = flat.dropna(subset=[*names, f"{_P}t"])
    best = flat.groupBy(*names, f"{_P}t").agg(F.max_by(f"{_P}v", f"{_P}o").alias(f"{_P}v"))
    return best.select(*names, f"{_P}t", *[F.col(f"{_P}v.{n}").alias(n) for n in values])


def _join_bucket(n_keys: int, event_cols: list[str], values: list[str], schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        try:
            con.register("e", left)
            con.register("v", right)
            on = " AND ".join(f'e."{_P}k{i}" = v."{_P}k{i}"' for i in range(n_keys))
            cols = ", ".join([*[f'e."{c}"' for c in event_cols], *[f'v."{c}"' for c in values], f'v."{_P}t" AS "{_P}known"'])
            sql = f'SELECT {cols} FROM e ASOF LEFT JOIN v ON {on} AND e."{_P}t" >= v."{_P}t"'
            return con.sql(sql).to_arrow_table().cast(schema)
        finally:
            con.close()

    return run


def asof_attach(events: DataFrame, versions: DataFrame, *, event_key: list[Column], event_time: Column, version_key: list[Column], available: Column, order: list[Column], values: dict[str, Column], known_at: str = "known_at", hot_rows: int = HOT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every event once, with ``values`` of the state of its key that was the last one available at ``event_time``.

    * null or NaN event key, null event time, no state yet: the values and ``known_at`` are null, the event stays.
    * null version key or instant: never available. Equal instants: highest ``order`` (nulls lowest) wins.
    * repeated events stay repeated; empty inputs give an empty or an all-null result.
    * an event column with the name of a value or of ``known_at`` is replaced by the joined one.
    """
    spark = events.sparkSession
    n = len(event_key)
    keys = [f"{_P}k{i}" for i in range(n)]
    kept = [c for c in events.columns if c not in {*values, known_at}]
    # events enter under position names, so nothing in them can clash
    e = events.select(*[F.col(f"`{c}`").alias(f"{_P}c{i}") for i, c in enumerate(kept)], *[c.alias(k) for c, k in zip(event_key, keys)], event_time.alias(f"{_P}t"))
    v = current_states(versions, version_key, available, order, values)
    counts = e.groupBy(*keys).count().select(*keys, F.col("count").alias("ne"), F.lit(0).cast("long").alias("nv")).unionByName(v.groupBy(*keys).count().select(*keys, F.lit(0).cast("long").alias("ne"), F.col("count").alias("nv")))
    counts = counts.groupBy(*keys).agg(F.sum("ne").alias("ne"), F.sum("nv").alias("nv"))
    sums = counts.agg(F.sum(F.col("ne") + F.col("nv")), F.max(F.greatest("ne", "nv"))).first()
    total, most = sums[0] or 0, sums[1] or 0
    if most > hot_rows:
        e, v = _slice_hot(e, v, counts, keys, hot_rows, math.ceil(most / hot_rows))
    else:
        e, v = e.withColumn(f"{_P}s", F.lit(0).cast("long")), v.withColumn(f"{_P}s", F.lit(0).cast("long"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bucket_rows))
    bucket = F.pmod(F.xxhash64(*keys, f"{_P}s"), F.lit(buckets)).alias(f"{_P}b")
    # keys of events that can match nothing are spread by their row instead of meeting in one bucket
    lost = F.col(f"{_P}t").isNull()
    for k in keys:
        lost = lost | F.col(k).isNull()
    own = F.xxhash64(*[f"{_P}c{i}" for i in range(len(kept)) if not isinstance(e.schema[f"{_P}c{i}"].dataType, T.MapType)] or [F.lit(0)])
    e = e.select("*", F.when(lost, F.pmod(own, F.lit(buckets))).otherwise(F.pmod(F.xxhash64(*keys, f"{_P}s"), F.lit(buckets))).alias(f"{_P}b"))
    v = v.select("*", bucket)
    out_fields = [T.StructField(f"{_P}c{i}", e.schema[f"{_P}c{i}"].dataType) for i in range(len(kept))] + [T.StructField(x, v.schema[x].dataType) for x in values] + [T.StructField(f"{_P}known", v.schema[f"{_P}t"].dataType)]
    schema = T.StructType(out_fields)
    # slice and salt join as one more key column
    e = e.withColumn(f"{_P}k{n}", F.col(f"{_P}s"))
    v = v.withColumn(f"{_P}k{n}", F.col(f"{_P}s"))
    run = _join_bucket(n + 1, [f"{_P}c{i}" for i in range(len(kept))], list(values), to_arrow_schema(schema))
    joined = e.groupBy(f"{_P}b").cogroup(v.groupBy(f"{_P}b")).applyInArrow(run, schema)
    return joined.select(*[F.col(f"{_P}c{i}").alias(c) for i, c in enumerate(kept)], *values, F.col(f"{_P}known").alias(known_at))


def _slice_hot(e: DataFrame, v: DataFrame, counts: DataFrame, keys: list[str], hot_rows: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Give hot keys a slice of time and, where needed, a salt: both end in column s, which joins as part of the key."""
    hot = counts.where(F.greatest("ne", "nv") > hot_rows).select(*keys)
    at = F.unix_micros(F.col(f"{_P}t").cast("timestamp"))
    times = e.select(*keys, at.alias("t")).unionByName(v.select(*keys, at.alias("t"))).join(hot, keys).groupBy(*keys)
    cuts = times.agg(F.percentile_approx("t", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts"))
    which = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("at"))), F.lit(0))
    e = e.join(cuts, keys, "left").withColumn("at", at).withColumn("slice", which)
    v = v.join(cuts, keys, "left").withColumn("at", at).withColumn("slice", which)
    # the state carried into a slice: the last one of all earlier slices, from one row per slice
    values = [c for c in v.columns if c not in {*keys, "cuts", "at", "slice"}]
    last = v.where("cuts is not null").groupBy(*keys, "slice").agg(F.max_by(F.struct(*values), F.col("at")).alias("row"))
    slices = e.where("cuts is not null").groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n_events"))
    both = slices.join(last, [*keys, "slice"], "full")
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("row", F.last("row", ignorenulls=True).over(before)).where("row is not null").select(*keys, "slice", "row.*")
    v = v.select(*keys, "slice", *values).unionByName(carried.select(*keys, "slice", *values))
    salts = slices.select(*keys, "slice", F.ceil(F.col("n_events") / hot_rows).cast("int").alias("salts"))
    e = e.join(salts, [*keys, "slice"], "left")
    v = v.join(salts, [*keys, "slice"], "left")
    step = F.lit(1_000_000)
    own = F.xxhash64(*[c for c in e.columns if c.startswith(f"{_P}c") and not isinstance(e.schema[c].dataType, T.MapType)] or [F.lit(0)])
    e = e.withColumn(f"{_P}s", F.col("slice") * step + F.pmod(own, F.coalesce("salts", F.lit(1)).cast("long"))).drop("slice", "salts", "cuts", "at")
    v = v.withColumn(f"{_P}s", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).withColumn(f"{_P}s", F.col("slice") * step + F.col(f"{_P}s").cast("long")).drop("slice", "salts")
    return e, v
