"""Tables written to the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship


def shared_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster's raises."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    sc.setCheckpointDir(root)
    return root


#: Row groups of written tables. A task holds one of each file it writes or reads: texts and sets in larger ones take memory.
ROW_GROUP_BYTES = 8 << 20


class Scratch:
    """A private folder below the shared root, for the tables one operator writes on its way.

    What a result still reads stays until the application ends, and goes then.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
        self._n = 0
        target, files = self._file_system(self.root)
        files.mkdirs(target)
        files.deleteOnExit(target)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """Write df as Parquet and return the table read back; the lineage ends there.

        small: of few bytes beside the input (ids, links, counts); it is written in
        as many files as there are cores, not one for each shuffle partition.
        """
        path = self.path(name)
        if small:
            df = df.coalesce(max(2, self.spark.sparkContext.defaultParallelism))
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._palimpsest_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of keep() that nothing reads any more; others are passed over."""
        for df in tables:
            if hasattr(df, "_palimpsest_path"):
                self.delete(df._palimpsest_path)

    def _file_system(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def delete(self, path: str) -> None:
        target, files = self._file_system(path)
        files.delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; the package's code goes to the executors before it is read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
