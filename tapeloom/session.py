"""Session factory and staging of shared intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tapeloom", shuffle_partitions: int | None = None):
    """Session with the settings the operators are tuned for.

    On a cluster pass no ``master``: spark-submit supplies it, AQE coalesces the
    shuffle partitions and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_METHODS = "spark.sql.codegen.hugeMethodLimit"
_JIT_BYTES = 8000  # the JVM interprets a larger method for good


def compiled_methods(spark) -> None:
    """Keeps the generated code of wide rows compiled, unless the session has a limit of its own.

    A stage of whole-stage code whose methods are too large for the JVM's compiler runs operator by
    operator instead: those projections are split into small methods, and the rows are the same.
    """
    if int(spark.conf.get(_METHODS, "65535")) == 65535:
        spark.conf.set(_METHODS, str(_JIT_BYTES))


def stage_folder(spark) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; anywhere else it
    has to name storage that every executor sees.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        own = tempfile.mkdtemp(prefix="tapeloom-stage-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        folder = sc.getCheckpointDir()
    return folder


def stage_path(spark, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df):
    """Write ``df`` to the shared folder once and read it back.

    For frames that several passes read: the upstream plan runs once, every pass sees the
    same values bit for bit, lineage is cut, and the size on disk lets Spark choose its
    join strategy.
    """
    path = stage_path(df.sparkSession, "stage")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list] = []


@contextmanager
def staging():
    """Owns the tables staged inside and deletes them at the end.

    A result is lazy, so use it up inside: ``with staging(): query(spark, folder).write...``.
    """
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes.pop())


def discard(*frames):
    """Delete staged tables that no later plan reads; other frames are left alone.

    The JVM's garbage goes too, so that Spark's cleaner drops the shuffle files of the steps
    that are done.
    """
    sc = None
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path is not None:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
            df.staged_path = None
    if sc is not None:
        gc.collect()
        sc._jvm.System.gc()


def input_dir(default: str = "/root/testdata/sf0.1") -> str:
    return os.environ.get("BENCH_SF_DIR", default)
