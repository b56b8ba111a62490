"""Session helpers: a local builder for tests, the shared checkpoint folder, table loading."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession


def build(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rectifold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a machine's own folder serves only a local master (tests), on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rectifold-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder: a parquet file or a folder of parts."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def share(spark: SparkSession, thing: object) -> Broadcast:
    """A broadcast of any bounded object, with its classes by value; `received` opens it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def received(shared: Broadcast) -> object:
    """The object of a broadcast; a worker opens it once and keeps it, with all it remembers, for its later tasks."""
    thing = getattr(shared, "_rectifold", None)
    if thing is None:
        thing = pickle.loads(shared.value)
        shared._rectifold = thing
    return thing


WRITTEN: list[str] = []


def written(df: DataFrame, unique: Iterable[str] = ()) -> DataFrame:
    """df as a table in the shared checkpoint folder, compressed and in columns; removed by `release`, at the latest when the driver's JVM ends.

    unique: columns, nested ones by their path in the file, whose values hardly repeat: no dictionary is tried for them, as it costs time and is dropped again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rectifold-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in unique}).parquet(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the tables `written` so far, for sessions that run many queries; results built on them must have been used up. Returns their number."""
    jvm, n = spark.sparkContext._jvm, len(WRITTEN)
    while WRITTEN:
        where = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return n
