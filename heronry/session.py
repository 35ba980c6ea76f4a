"""Session and storage helpers shared by every part of the engine."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Folders that new ones are made in, innermost last; the shared folder if empty.
_inside: list[str] = []
#: When files of exchanges were last let go; seconds between two times.
_freed = [0.0]
FREE_S = 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named by ``spark.checkpoint.dir``. Only where that is unset
    and everything runs in one process is a temporary folder chosen and set;
    a cluster without that setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="heronry-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{_inside[-1] if _inside else shared_dir(spark)}/heronry-{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """A path and its file system, wherever Spark can reach it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that isn't there is fine."""
    found, fs = file_system(spark, path)
    fs.delete(found, True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file, with a line break behind the text, if there is none of that name."""
    found, fs = file_system(spark, path)
    try:
        out = fs.create(found, False)
    except Py4JJavaError:
        if fs.exists(found):
            return False
        raise
    out.write(bytearray((text + "\n").encode()))
    out.close()
    return True


def free_exchanges(spark: SparkSession) -> None:
    """Let Spark delete the files of exchanges that no plan holds any more: it does so only when the driver's JVM collects garbage, which may take half an hour."""
    if time.monotonic() - _freed[0] >= FREE_S:
        spark.sparkContext._jvm.System.gc()
        _freed[0] = time.monotonic()


def materialise(df: DataFrame, label: str, to: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = to or new_folder(spark, label)
    schema = df.schema
    df.write.parquet(path)
    free_exchanges(spark)
    return spark.read.schema(schema).parquet(path)


class Scratch:
    """Tables of one operator: those for its own use go when the block ends, kept ones stay for its result."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.own: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self.own])

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that the operator's lazy result reads."""
        return materialise(df, f"{self.label}-{name}")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """A table that nothing reads after the block."""
        path = new_folder(self.spark, f"{self.label}-{name}")
        self.own.append((out := materialise(df, name, path), path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables early."""
        gone = [(df, path) for df, path in self.own if any(df is f for f in frames)]
        self.own = [(df, path) for df, path in self.own if not any(df is f for f in frames)]
        for _, path in gone:
            remove(self.spark, path)


@contextmanager
def temporary(spark: SparkSession, label: str):
    """Folders made inside the block go when it ends, kept ones too; write what must stay before, elsewhere."""
    path = new_folder(spark, label)
    _inside.append(path)
    try:
        yield
    finally:
        _inside.pop()
        remove(spark, path)
