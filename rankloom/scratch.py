"""Tables written between the stages of a query.

Iterative operators cut their lineage here: a stage is written as parquet to the
folder that all executors share (``spark.checkpoint.dir``) and read back, so a lost
executor only costs the tasks that it was running.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
#: What a stage has shuffled is of no use once it is written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where none is set."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if named:
        path = f"{named.rstrip('/')}/rankloom-{app}"
        if app not in _own and (local := path.removeprefix("file://")).startswith("/"):
            # The session's folder goes with the session; on other file systems ``drop`` has removed most of it.
            _own[app] = local
            atexit.register(shutil.rmtree, local, True)
        return path
    if app not in _own:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="rankloom-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def stage(df: DataFrame, tag: str, **measures: Column) -> DataFrame:
    """Write ``df`` and return the written table; its lineage ends there.

    ``measures`` are aggregates over the rows, taken while they are written; they and
    ``rows`` are found in ``.measured`` of the result.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    seen = Observation()
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items())).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._rankloom_path, out.measured = path, seen.get
    return out


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles at any size.

    A broadcast is chosen by the size of files, or by columns of rows that are yet to be
    exploded; what the driver needs for it is ten times that and more.
    """
    return df.hint("merge")


def drop(*frames: DataFrame | None) -> None:
    """Delete stages that nothing will read any more."""
    for df in frames:
        path = getattr(df, "_rankloom_path", None)
        if path is None:
            continue
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
