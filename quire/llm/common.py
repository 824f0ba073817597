"""What the operators of this subpackage share: reading, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_tables: list[str] = []
#: Names under which some of these are known to the catalog.
_named: dict[str, str] = {}


#: Rows of an Arrow batch between the JVM and a worker; a batch of long texts would be large with Spark's 10,000.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Sets the session to Arrow batches of at most BATCH_ROWS rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none: one of this machine if all run on it (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="quire-shared-"))
    return _own_dir[0]


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """rows written into the shared folder in buckets of ``key``: joins by that key shuffle the other side alone. Spark knows buckets of tables of its catalog alone; remove_tables takes it out of there too."""
    spark, n = rows.sparkSession, shuffle_partitions(rows.sparkSession)
    path = new_path(spark, "buckets")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    _named[path] = name
    rows.repartition(n, key).write.format("parquet").bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def new_path(spark: SparkSession, tag: str) -> str:
    """A place in the shared folder, to be removed by remove_tables."""
    _tables.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _tables[-1]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and rereads it.

    Later steps then start from files every executor can read, so a lost
    executor costs the tasks it was running and nothing before this point.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, first: int = 0, keep: int = 0) -> None:
    """Deletes the tables that operators wrote in this process, from the ``first``-th on but for the last ``keep``; to be called when what was computed from them is itself written."""
    jvm = spark.sparkContext._jvm
    for path in _tables[first : len(_tables) - keep]:
        if path in _named:
            spark.sql(f"DROP TABLE IF EXISTS `{_named.pop(path)}`")
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _tables[first : len(_tables) - keep]


def tables_written() -> int:
    return len(_tables)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
