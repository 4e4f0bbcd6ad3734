"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is sent to every executor; its callers count first.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session that names none gets
    a folder of its own: on a cluster executors would each write to their own disk."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docspindle-"))
        found = sc.getCheckpointDir()
    return found


#: Tables that this process wrote and has not deleted.
_WRITTEN: dict[str, SparkSession] = {}


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` under the checkpoint folder and read it back: cuts the lineage,
    survives lost executors, and gives the optimiser true sizes."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        sc = spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table of `materialise` that nothing reads any more."""
    _delete(getattr(df, "_written", ""))


def discard_all() -> None:
    """Delete all tables that `materialise` wrote: when all results are read, and at exit."""
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            _WRITTEN.clear()


atexit.register(discard_all)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows, else as it is."""
    n = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def share(spark: SparkSession, value):
    """A broadcast of `value`; `value_of` reads it where this package is not installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def value_of(shared):
    import pickle

    return pickle.loads(shared.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash01(*cols: Column | str) -> Column:
    """A uniform double in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def crc_mod(col: str, m: int) -> Column:
    return F.crc32(F.col(col).cast("string")) % m


def ordered_words(text: Column) -> Column:
    """Runs of bytes other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
