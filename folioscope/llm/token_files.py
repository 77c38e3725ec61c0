"""Token-id files: every text's ids in ascending doc_id order, in an adaptive context-mixing range code.

Documents are dealt to partitions by ranges of doc_id and sorted there; a task tokenises its range and cuts it, between
documents, into segments of about `SEGMENT` ids.  A row of the file is a segment: its place (part, seq), the ids of its
part before it, the doc_ids and id counts of its documents, and the code (see block_coder), whose blocks are reset and
checksummed on their own.  Rows are written and read by Spark, so commits and lost tasks are Spark's matter and any store
that Spark reads will do.  Reading needs the segments before a part only as one sum a part.

Defined results: null text is empty and has the end id alone; null doc_ids come first; rows of one doc_id follow in the
order of a hash of their text; an empty table writes no segment and reads as no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .block_coder import decode, encode
from .common import pieces, scratch_dir, table
from .tokens import default_path, stops, token_ids

SEGMENT = 6 << 20
#: Bytes of text of a part.
PART = 44 << 20
#: One row a part; broadcast up to so many.
BROADCAST_PARTS = 500_000


def write(docs: DataFrame, path: str, tokenizer: str | None = None, segment: int = SEGMENT, part_bytes: int = PART) -> None:
    tokenizer = tokenizer or default_path()
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held, held_ids, held_lens, n = [], [], [], 0

        def flush():
            nonlocal seq, before, held, held_ids, held_lens, n
            ids = np.concatenate(held_ids)
            doc_ids = pa.concat_arrays(held)
            lens = np.concatenate(held_lens)
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), one(doc_ids), one(pa.array(lens)), pa.array([encode(ids, stops(ids, tokenizer))], pa.binary())], ["part", "seq", "before", "n_ids", "doc_ids", "doc_lens", "code"])
            seq, before = seq + 1, before + len(ids)
            held, held_ids, held_lens, n = [], [], [], 0
            return row

        for b in (x for batch in batches for x in pieces(batch, 1, 6 << 20)):
            ids, offsets = token_ids(b.column(1), tokenizer)
            lens, at = np.diff(offsets), 0
            while at < len(lens):
                # as many documents as reach the size of a segment, one at least
                stop = min(int(np.searchsorted(offsets, offsets[at] + segment - n)), len(lens))
                stop = max(stop, at + 1)
                held.append(b.column(0).slice(at, stop - at))
                held_ids.append(ids[offsets[at] : offsets[stop]])
                held_lens.append(lens[at:stop])
                n += int(offsets[stop] - offsets[at])
                at = stop
                if n >= segment:
                    yield flush()
        if held:
            yield flush()

    rows.mapInArrow(run, f"part int, seq int, before long, n_ids long, doc_ids array<{kind}>, doc_lens array<long>, code binary").write.parquet(path)


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Segments with the number of ids before each."""
    segments = spark.read.parquet(path)
    per = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    starts = per.select(F.col("part").alias("p"), (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("part_start"))
    few = per.count() <= BROADCAST_PARTS
    placed = segments.join(F.broadcast(starts) if few else starts, F.col("part") == F.col("p"))
    kind = dict(segments.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    return placed.select((F.col("part_start") + F.col("before")).alias("start"), "doc_ids", "doc_lens", "code"), kind


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document, decoded."""
    placed, kind = _placed(spark, path)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids = decode(b.column(3)[k].as_py())
                lens = np.asarray(b.column(2)[k].values)
                stops = np.cumsum(lens)
                starts = b.column(0)[k].as_py() + stops - lens
                for i in range(0, len(lens), 256):
                    lo, hi = (stops[i] - lens[i]), stops[min(i + 256, len(lens)) - 1]
                    off = np.concatenate([[0], stops[i : i + 256] - lo])
                    lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids[lo:hi].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(1)[k].values.slice(i, len(off) - 1), pa.array(starts[i : i + 256]), pa.array(lens[i : i + 256]), lists], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the decoded ids."""
    placed, kind = _placed(spark, path)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids = decode(b.column(3)[k].as_py()).astype("<u4")
                lens = np.asarray(b.column(2)[k].values)
                stops = np.cumsum(lens)
                crc = [zlib.crc32(ids[s - n : s]) for s, n in zip(stops, lens, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(1)[k].values, pa.array(b.column(0)[k].as_py() + stops - lens), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
