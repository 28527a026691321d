"""Shared helpers of the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word contracts: blank and the control characters 9 to 13.
SPACE = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it none of df's columns."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def words_of(c: Column) -> Column:
    """Array of the maximal runs outside SPACE; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only where the setting is absent in a local session, as in tests, a temporary folder is made,
    once for each application; on a cluster the setting is needed.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="axonwave-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, label: str = "step", batch: str = "16m", **options: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it, whichever executors are lost.

    Lineage ends here, and the reader knows the size, so that small tables are broadcast and
    large ones are not. The application's tables go when the driver ends. batch: most bytes of an
    Arrow batch; options: of Spark's writer.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/axonwave-{spark.sparkContext.applicationId}"
    path = f"{top}/{label}-{uuid.uuid4().hex}"
    with batches_of(spark, batch):  # what Python workers hold at once
        df.write.options(**options).parquet(path)
    if top not in _tops:
        _tops.add(top)
        atexit.register(dropped, spark, top)
    out = spark.read.schema(df.schema).parquet(path)
    out._axonwave_path = path
    return out


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: str):
    """Arrow batches of at most this size for what is planned inside; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(rows: Callable) -> Callable:
    """rows, a function for mapInArrow, whose worker gives back what its task has freed: idle workers count as the executor's memory, and the next task's is added to theirs."""

    def out(batches):
        try:
            yield from rows(batches)
        finally:
            given_back()

    return out


def given_back() -> None:
    """Freed memory that Arrow and the C library keep for later goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


_tops: set[str] = set()


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a written table (or all of them) through the file system that holds it."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone already; nothing depends on it
        pass


def forget(df: DataFrame | None) -> None:
    """Drops the table behind a DataFrame that written() returned and that nobody reads again."""
    if path := getattr(df, "_axonwave_path", None):
        dropped(df.sparkSession, path)


def small_side(df: DataFrame, most_rows: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows from files of at most most_bytes; else as it is, for a shuffled join.

    df should be made from written() tables only, so that the count is a read of file footers.
    """
    if df.limit(most_rows + 1).count() > most_rows:
        return df
    jvm, conf, total = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), 0
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(top)
        total += where.getFileSystem(conf).getContentSummary(where).getLength()
    return F.broadcast(df) if total <= most_bytes else df
