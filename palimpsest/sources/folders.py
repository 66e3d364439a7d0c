"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the application ends. Without that setting, a local session gets one of its own; a cluster's raises."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc._jsc.sc().getCheckpointDir().isDefined():
        root = sc._jsc.sc().getCheckpointDir().get()
    if not root:
        if not re.match(r"local(\[.*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


#: Bytes of stored tables for one partition of a join whose rows grow with them.
PART_BYTES = 2 << 20


def parts_of(*tables: DataFrame, size: int | None = None) -> int:
    """Partitions for a join of tables, one for `size` bytes of them: as many as shuffles have, more where the files that the tables are read from are large, so that a task's rows don't grow with them."""
    spark = tables[0].sparkSession
    files = sum(size for _, size, _ in fingerprint(*tables))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files // (size or PART_BYTES)))


def fingerprint(*tables: DataFrame) -> tuple:
    """Paths, lengths and times of the files that the tables are read from: equal as long as the files are."""
    out = []
    for df in tables:
        spark = df.sparkSession
        for name in sorted(df.inputFiles()):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)
