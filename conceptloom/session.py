"""Sessions and tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "conceptloom") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return builder.config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new place in the folder that all executors share; a folder of our own only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="conceptloom-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/conceptloom/{tag}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what cut_lineage wrote within it. Results have to be saved by then, or be read from what was written before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = shared_path(df.sparkSession, tag)
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a small table that go to every executor; a larger one is joined by shuffles.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, tag: str) -> DataFrame:
    """df, written, and marked to be broadcast if it has BROADCAST_ROWS rows or fewer."""
    df = cut_lineage(df, tag)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
