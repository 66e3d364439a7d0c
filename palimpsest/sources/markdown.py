"""Folders of Markdown files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import DOCUMENT_CHARS, markdown_chunks
from ..shipping import ship
from .folder_source import IGNORED, MAX_BYTES, SETTLE_SECONDS, MarkdownFolder


def read_markdown(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """relative_path, content (text), content_hash, byte_size of the Markdown files below a folder.

    Files over max_bytes raise, as do files that aren't UTF-8. Mounted folders are
    read by the data source of their own (folder_source), which doesn't follow links;
    others by Spark's reader of binary files, on any file system that it reaches.
    """
    mounted = _mounted(spark, folder)
    return _binary_files(spark, folder, max_bytes) if mounted is None else _source(spark, spark.read, mounted, max_bytes)


def stream_markdown(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES, settle_seconds: float = SETTLE_SECONDS) -> DataFrame:
    """The files of a mounted folder as a stream: each as it is found, and again whenever it has changed."""
    mounted = _mounted(spark, folder)
    if mounted is None:
        raise ValueError(f"only mounted folders can be watched, {folder} isn't one")
    return _source(spark, spark.readStream.option("settleSeconds", settle_seconds), mounted, max_bytes)


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that machines have mounted; None for other file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(path).toUri().getPath() if files.getScheme() == "file" else None


def _source(spark: SparkSession, reader, path: str, max_bytes: int) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MarkdownFolder)
    return reader.format(MarkdownFolder.name()).option("maxBytes", max_bytes).load(path)


def _binary_files(spark: SparkSession, folder: str, max_bytes: int) -> DataFrame:
    """The same by Spark's reader. It passes over empty files; they are added from the listing. Links are followed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM]*").load(folder)
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?(?=/)", ""), "^" + _quoted(root) + "/", "")
    named = files.select(path.alias("relative_path"), "content", F.col("length").alias("byte_size"))
    empty = [(p.removeprefix(root + "/"), bytearray(), 0) for p in _empty_files(spark, folder)]
    named = named.unionByName(spark.createDataFrame(empty, "relative_path string, content binary, byte_size long")).where(F.lower("relative_path").rlike(r"\.(md|markdown)$"))
    parts = F.split("relative_path", "/")
    kept = named.where(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in IGNORED])))
    kept = kept.where(F.assert_true(F.col("byte_size") <= max_bytes, "a document is too large").isNull())
    return kept.select("relative_path", F.validate_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("content_hash"), "byte_size")


def _empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the empty files below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        status = found.next()
        if not status.getLen():
            out.append(status.getPath().toUri().getPath())
    return out


def _quoted(path: str) -> str:
    return "\\Q" + path + "\\E"


def chunked(documents: DataFrame, limit: int = DOCUMENT_CHARS) -> DataFrame:
    """relative_path, content_hash, chunk_index, heading, start_line, end_line, content."""
    cut = documents.select("relative_path", "content_hash", F.posexplode(markdown_chunks(F.col("content"), limit)).alias("chunk_index", "c"))
    return cut.select("relative_path", "content_hash", "chunk_index", "c.*")


def in_order(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.lower("relative_path"), "relative_path")
