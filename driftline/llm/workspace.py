"""Where operators keep intermediate tables: the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of local sessions, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where none is named: a temporary one if all runs on this machine, as in tests, and else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="driftline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


#: Folders given out by ``fresh_path`` in this process and not dropped, in order.
_given: dict[str, None] = {}


def fresh_path(spark: SparkSession, tag: str) -> str:
    folder = f"{shared_dir(spark)}/driftline/{uuid.uuid4().hex}"
    _given[folder] = None
    return f"{folder}/{tag}"


def given() -> list[str]:
    """Folders of intermediate tables and files that are still there."""
    return list(_given)


def delete(spark: SparkSession, folder: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _given.pop(folder, None)


def roots_of(df: DataFrame) -> list[str]:
    """Paths of the tables that a frame reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            found += [paths.apply(k).toString() for k in range(paths.size())]
    return found


def few_files(df: DataFrame) -> DataFrame:
    """Narrow rows dealt to an eighth of the session's shuffle partitions: many small files cost more than one narrow shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(4, n // 8))


def materialise(df: DataFrame, tag: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``wide`` rows (whole texts), and those of many, are not shuffled for it.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    (df if wide else few_files(df)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftline_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again: what was made from them has been written too."""
    for df in tables:
        delete(df.sparkSession, df._driftline_path.rpartition("/")[0])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, through Hadoop's file system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


#: Bytes of rows that go to a worker at once; some copies of them are in memory on either side.
BATCH_BYTES = 8 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of whole texts that workers get; a session with a bound of its own keeps it."""
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` if there are no more than ``most``, else those with the least hashes of ``key``: ``most`` or somewhat fewer.

    A threshold on the hash chooses them, so no task or driver sees more than its share.
    """
    n = rows.count()
    if n <= most:
        return rows
    part = max(0.0, most - 5 * most**0.5) / n
    mark = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return rows.where(mark < int(part * (1 << 30))).orderBy(mark, key).limit(most)


def columns_as(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Only the wanted columns under internal names, so that extra columns of any name cannot clash.

    A value of None (the table has no such column) gives a null string column.
    """
    return df.select(*[(F.lit(None).cast("string") if c is None else F.col(f"`{c}`")).alias(n) for n, c in wanted.items()])
