"""Tables written once to the folder that all executors share, to be read again by what follows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_written: list[tuple[weakref.ref, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary folder of this machine if Spark runs in
    local mode; on a cluster that is an error, as executors do not see each other's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="granary-"))
    return f"file://{_own_dir[0]}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes as stored tables do."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors, and is
    computed once however often it is used. The files go when the driver's process ends, or by `forget`."""
    spark = df.sparkSession
    path = fresh(spark, "granary")
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def forget() -> None:
    """Deletes all tables written so far. Results that still read them can't be computed any more: for a long session,
    between one result that is done with and the next."""
    while _written:
        ref, path = _written.pop()
        with contextlib.suppress(Exception):
            spark = ref()
            jvm, hconf = spark._jvm, spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hconf).delete(p, True)
