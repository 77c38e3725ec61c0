"""Reading document bundles: block tree, markdown, metadata, chunks and html of one document."""

from __future__ import annotations

import json as json_module
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ARTIFACTS

FILES = {"output.json": "json", "output.md": "md", "output.metadata.json": "metadata", "output_chunks.json": "chunks", "output.html": "html"}
KINDS = ["json", "md", "metadata", "chunks", "html"]


class ServiceUnavailable(NotImplementedError):
    """Live recognition is not part of this engine."""


def live_service(*_args, **_kwargs):
    raise ServiceUnavailable("Live recognition is not wired up; provide the recognition output as files instead.")


def read_text(source) -> str:
    """Text of a path, bytes, an open file, or a string itself; None gives the empty text."""
    if source is None:
        return ""
    if isinstance(source, bytes):
        return source.decode("utf-8")
    if hasattr(source, "read"):
        return read_text(source.read())
    if isinstance(source, Path) or isinstance(source, str) and os.path.isfile(source):
        return Path(source).read_text(encoding="utf-8")
    return str(source)


def read_json(source):
    """The value of a path, bytes, an open file or a JSON string; other objects are values already."""
    if source is None or isinstance(source, (dict, list, int, float, bool)):
        return source
    return json_module.loads(read_text(source))


def from_buffers(spark: SparkSession, doc_id: str, json, md=None, metadata=None, chunks=None, html=None) -> DataFrame:
    """artifacts of one document from uploads; json is required."""
    if json is None:
        raise ValueError("the block tree (json) is required")
    dump = lambda x: None if x is None else json_module.dumps(read_json(x), ensure_ascii=False)
    given = {"json": dump(json), "md": None if md is None else read_text(md), "metadata": dump(metadata), "chunks": dump(chunks), "html": None if html is None else read_text(html)}
    return spark.createDataFrame([(doc_id, k, v) for k, v in given.items() if v is not None], ARTIFACTS)


def from_folders(spark: SparkSession, path: str) -> DataFrame:
    """artifacts of all documents below path: a folder with an output.json is a document, named by its way from path (by
    its own name if it is path).  Any store that Spark reads will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "output*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/") + "/"
    files = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    below = F.when(F.startswith(F.col("folder"), F.lit(root)), F.col("folder").substr(F.lit(len(root) + 1), F.length("folder"))).otherwise(F.element_at(F.split("folder", "/"), -1))
    kinds = F.create_map(*[F.lit(x) for kv in FILES.items() for x in kv])
    out = files.select(below.alias("doc_id"), F.try_element_at(kinds, name).alias("kind"), F.col("content").cast("string").alias("content"))
    out = out.where("kind is not null")
    return out.join(out.where("kind = 'json'").select("doc_id").distinct(), "doc_id", "left_semi")


def wide(artifacts: DataFrame) -> DataFrame:
    """One row a document, one column a kind."""
    return artifacts.groupBy("doc_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in KINDS])
