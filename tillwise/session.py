"""Session settings and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tillwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# The folder of the run that this thread is in.
_run: ContextVar[str | None] = ContextVar("run", default=None)


def _root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which executors share.

    Only a session whose executor is its own driver may go without the setting; it gets a
    folder of its own, which that session's one machine shares with itself.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        root = tempfile.mkdtemp(prefix="tillwise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, in the folder of the current run if there is one."""
    folder = _run.get() or _root(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A run whose intermediate tables lie in one folder, which goes when the run ends.

    Write or collect the results inside the block: what is lazy reads those tables.
    """
    folder = f"{_root(spark)}/run-{uuid.uuid4().hex}"
    outer = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch and read back.

    For tables that several later steps read: they are computed once, the loss of an
    executor costs nothing of them, and Spark knows their size when it plans a join.
    """
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What makes rows dear to read again: all but scans, projections, filters and unions of them.
DERIVED = re.compile(r"^[\s:+-]*(Join|Aggregate|Window|Sort|Generate|Repartition\w*|Distinct|MapIn\w*|FlatMap\w*|GlobalLimit)\b", re.M)


def read_again(df: DataFrame, name: str) -> DataFrame:
    """``df`` for several passes: stored if it comes from joins or the like, as it is if from a scan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return materialize(df, name) if DERIVED.search(plan) else df
