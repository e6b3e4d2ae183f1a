"""Session helpers: tuned sessions, the shared staging folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: list[str] = []


@atexit.register
def _drop_own_dirs() -> None:
    for path in _own_dirs:
        shutil.rmtree(path, ignore_errors=True)


def build_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("draftloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session names none (tests, a laptop) is a folder of our own made and set; on a cluster executors
    would write to their own disks, so there the setting is required.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        named = spark.sparkContext.getCheckpointDir() or ""
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="draftloom-")
        _own_dirs.append(named)
        spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut, columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/draftloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """A partition count that follows the data: at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / max(1, rows_per_partition)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for work that costs much per row, where its few files would keep most cores idle.

    A plain scan is asked for its splits; of anything that would have to run to be asked, the plan's size is judged. An
    input that fills the cores stays as it is, so only small ones are moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if {line.lstrip(" +-:").split(" ")[0] for line in plan.toString().splitlines() if line.strip()} <= {"Project", "Filter", "Relation"}:
        full = df.rdd.getNumPartitions() >= cores
    else:
        full = int(str(plan.stats().sizeInBytes())) >= cores * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if full else df.repartition(cores)
