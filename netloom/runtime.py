"""Session-level helpers that every subpackage may use."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()
#: seconds between two calls of ``lighten`` that do something, and when the last one did, by application
LIGHTEN_S = 5.0
_LIGHTENED: dict[str, float] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Workers that import the modules (instead of unpickling copies) keep module-level
    caches from one task to the next.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "netloom_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("netloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests) is one of our own
    set; a cluster without one is an error, as its machines don't share temporary folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="netloom-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def lighten(spark: SparkSession) -> str | None:
    """Gives back what the driver's JVM has freed, at most once in ``LIGHTEN_S`` seconds; what it said.

    Plans and finished tasks leave garbage that lets the heap grow to its most, and the C library
    keeps what compilers and threads have freed. Both count for a driver whose memory is limited.
    JVMs that can't return the latter (before 17.0.9, or not on Linux) only collect.
    """
    app = spark.sparkContext.applicationId
    if time.monotonic() - _LIGHTENED.get(app, -LIGHTEN_S) < LIGHTEN_S:
        return None
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.java.lang.System.gc()
    kind = jvm.java.lang.Class.forName
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, args = new(jvm.java.lang.Class, len(names)), new(jvm.java.lang.Object, len(names))
    for i, name in enumerate(names):
        kinds[i] = kind(name)
    try:  # by the interface's method, as the server's class is not open to reflection; the command has no arguments
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        said = kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, args)
    except Py4JError:
        said = ""
    _LIGHTENED[app] = time.monotonic()
    return said


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage is cut, and a lost
    executor costs a read of these files rather than the work behind them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    lighten(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of ``stored`` tables that nothing needs any more."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_skewed(left: DataFrame, right: DataFrame, key: str, share: int = 512) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, of which ``right`` has a row each and ``left`` may
    have very many: keys with over one of ``share`` rows of ``left``, so fewer than ``share`` keys,
    are broadcast, which leaves their rows where they are. Keys that ``right`` lacks are left out."""
    n = F.count("*").alias("_n")
    counts = left.groupBy(key).agg(n)
    total = left.count()
    hot = [r[0] for r in counts.where(F.col("_n") * share > total).select(key).collect()] if total > share else []  # fewer than ``share``
    if not hot:
        return left.join(right, key)
    many = left.sparkSession.createDataFrame([(h,) for h in hot if h is not None], left.select(key).schema)
    few = F.broadcast(right.join(F.broadcast(many), key, "left_semi"))
    rest = left.join(F.broadcast(many), key, "left_anti").join(right, key)
    return left.join(few, key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(docs: DataFrame) -> Column:
    """The hash of all columns of a row: rows that share it are wholly equal."""
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in docs.columns])
    return F.xxhash64(*docs.columns, nulls)
