"""Session settings and shared scratch folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "heliochron", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and the zone pinned to UTC."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.unionOutputPartitioning": "false",  # see union_all
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_TEMP: list[str] = []
_WRITTEN: list[str] = []


def _shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names.  Only a session on this machine may go without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    if not _TEMP:
        _TEMP.append(tempfile.mkdtemp(prefix="heliochron-"))
    return _TEMP[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call has been given."""
    _WRITTEN.append(f"{_shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _WRITTEN[-1]


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table written to the shared folder as Parquet and read back: it survives the loss of any executor."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> int:
    """Delete what this session has written to the shared folder; results that read it must be done with."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def union_all(parts: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Union by name.

    Spark 4.1 may take a union of equally partitioned inputs for partitioned as well and leave
    out a shuffle that it then turns out to need; groups come out split.  That inference is
    switched off for the session.
    """
    out = parts[0]
    key = "spark.sql.unionOutputPartitioning"
    if out.sparkSession.version.startswith("4.1"):
        out.sparkSession.conf.set(key, "false")
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=allow_missing)
    return out
