"""Helpers shared by the corpus operators: table access, scratch tables, word splitting."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster.  Only a session in one process may name none: it gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append("file://" + tempfile.mkdtemp(prefix="folioscope-"))
    return _own_scratch[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a scan of it: lineage is cut, and lost executors
    cost a re-read.  The scan keeps its folder in ``scratch_path`` so that `discard` can drop it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(side: DataFrame, most: int = 50_000) -> DataFrame:
    """side (a scratch table) marked for broadcast if it has up to `most` rows, else for a join by shuffle.  Unmarked, Spark
    sizes tables by their compressed files and takes an explode to add no rows: what it then broadcasts can be many times
    larger than its threshold, and all of it passes through the driver."""
    return F.broadcast(side) if side.count() <= most else side.hint("merge")


def join_counted(rows: DataFrame, counted: DataFrame, on: str, at: str, n: str, least: int, most: int = 50_000) -> DataFrame:
    """rows joined with counted (a scratch table of one row a key `at`, with the number `n` of its rows) where on = at.  Up to
    `most` keys are joined by broadcast.  Of more, those of `least` rows or more, and of more than a `most`th of all (so `most`
    of them at most), are: no task gathers the rows of a frequent key.  The others are joined by shuffle (see `sized`)."""
    total, keys = counted.agg(F.sum(n), F.count("*")).first()
    if keys <= most:
        return rows.join(F.broadcast(counted), F.col(on) == F.col(at))
    many = max(least, total // most)
    hot, cold = counted.where(F.col(n) >= many), counted.where(F.col(n) < many).hint("merge")
    if not hot.head(1):
        return rows.join(cold, F.col(on) == F.col(at))
    few = F.broadcast(hot)
    rest = rows.join(few.select(at), F.col(on) == F.col(at), "left_anti")
    return rest.join(cold, F.col(on) == F.col(at)).unionByName(rows.join(few, F.col(on) == F.col(at)))


def give_back() -> None:
    """Return memory that a finished computation freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def cells(spark: SparkSession, size: float, cell: float) -> int:
    """Cells of about `cell` that hold `size`, enough of them for every shuffle partition to have some."""
    return max(math.ceil(size / cell), int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts (null: empty), and offsets: words of text i are flat[off[i]:off[i + 1]]."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(text)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.flatten()
    offsets -= offsets[0] if len(offsets) else 0
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    if not full.all():  # white space at an end of a text leaves an empty word there
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets


def encode_words(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch, the code of each word in order, and the offsets of the texts."""
    if lower:
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        text = pc.ascii_lower(text.cast(pa.large_string()))
    flat, offsets = split_words(text)
    enc = flat.dictionary_encode()
    return enc.dictionary, np.asarray(enc.indices).astype(np.int64), offsets


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each segment; empty segments give 0."""
    total = np.concatenate([np.zeros(1, dtype=np.float64), np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def pieces(batch: pa.RecordBatch, at: int, limit: int = 4 << 20):
    """Slices of a batch of about `limit` bytes of text in column `at` (one row at least), so that what is derived from
    a slice stays small however Arrow batches are cut."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64)
    cut = (np.cumsum(size) - size) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(cut)) + 1, [batch.num_rows]]) if batch.num_rows else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def stacked(batches, at: int, limit: int):
    """Record batches of about `limit` bytes of text in column `at`, however the incoming ones are cut (one row at least)."""
    held, size = [], 0
    for b in (x for batch in batches for x in pieces(batch, at, max(limit >> 3, 1))):
        held.append(b)
        size += pc.sum(pc.binary_length(b.column(at))).as_py() or 0
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (whole := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield whole[0]
