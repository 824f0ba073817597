"""Reading tables, and cutting lineage at written ones. quire.llm has its own of these, as either part works without the other."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where it names none: one of this machine if all run on it (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quire-shared-"))
    return _own[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: what reads it later starts from files, whichever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def mounted(target: str) -> Iterator[Callable[[str], str]]:
    """A folder that all executors mount, made where it is absent. Gives what leads a task to a path in it: fails where the task doesn't see what the driver put there."""
    os.makedirs(target, exist_ok=True)
    mark = os.path.join(target, f".shared-{uuid.uuid4().hex}")
    with open(mark, "w"):
        pass

    def place(name: str) -> str:
        if not os.path.exists(mark):
            raise FileNotFoundError(f"{target} must be mounted on all machines")
        return os.path.join(target, name)

    try:
        yield place
    finally:
        os.remove(mark)


def put(path: str, data: bytes) -> None:
    """Writes a file whole or not at all."""
    folder, name = os.path.split(path)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f".{name}.{uuid.uuid4().hex}.tmp"), "wb") as f:
        f.write(data)
    os.replace(f.name, path)
