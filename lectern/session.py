"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Runtime settings the operators rely on. Adaptive execution splits hot join
# keys; the force flag lets it do so even when that costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
# Settings that must be there from the start of a session. Call sites of column
# calls are not recorded: plans here have thousands of them.
START_CONF = {"spark.sql.session.timeZone": "UTC", "spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app_name: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings above; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **START_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out over the session's shuffle partitions before heavy per-row work.

    For tables that come in few row groups. ``key`` should be unique, so that rows
    spread evenly and reruns agree.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables, shared by all executors.

    The cluster names the shared folder in ``spark.checkpoint.dir``; without it the
    session's warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    Its plan is then computed once, and a lost executor costs a re-read.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, purpose: str, key: str) -> DataFrame:
    """As ``stage``, dealt by ``key`` into buckets, one for each of the session's shuffle partitions.

    Joins on the key read the table where it lies: it is shuffled once, however often it is
    joined. All rows of one key are one task's.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession, purpose)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name, format="parquet")
    table = spark.table(name)
    # The name was only needed to tell Spark of the buckets; the files stay.
    spark.sql(f"drop table {name}")
    return table


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a folder, empty where the folder does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T._parse_datatype_string(schema))
