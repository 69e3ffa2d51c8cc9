"""Session helpers shared by every module."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The folder of the scratch that is open, if any.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "flowprism", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine is written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone: all event times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="flowprism-ckpt-")
    context.setCheckpointDir(shared)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss); inside a ``scratch`` with a table that goes with it."""
    if _FOLDER.get():
        return stored(df)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only when a bounded count proves the side small.

    A larger side is returned without the hint, so the planner falls back to a
    shuffled join (and AQE may still split skewed partitions).
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, or under that of the ``scratch`` that is open."""
    ensure_checkpoint_dir(spark)
    return f"{_FOLDER.get() or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to a fresh parquet folder under the shared checkpoint folder and read that back.

    Cuts lineage like ``durable``, computes ``df`` once (a checkpoint computes its last stage twice)
    and keeps rows compressed. Survives executor loss.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Work whose tables are not needed later: what ``stored`` and ``durable`` write inside is dropped at its end.

    Yields a ``stored`` whose tables stay as long as those around the scratch. Inside, shuffle files go with the query
    that wrote them, so disk holds the files of one query and not of all. Frames made inside must not be read outside.
    """
    outer, folder = _FOLDER.get(), scratch_path(spark, "scratch")
    before = spark.conf.get(_CLEANUP, None)

    def keep(df: DataFrame, name: str = "table") -> DataFrame:
        inner = _FOLDER.set(outer)
        try:
            return stored(df, name)
        finally:
            _FOLDER.reset(inner)

    opened = _FOLDER.set(folder)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield keep
    finally:
        _FOLDER.reset(opened)
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
