"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has 64 bits, one for each bit position set in over half of the XXH64 values of a text's word shingles.
Fingerprints at `MAX_BITS` = 4 or fewer differing bits agree in at least 8 - 4 = 4 of their 8 bytes.  The index posts
each distinct fingerprint under byte values at positions, three positions to a posting: 20 triples suffice, for any four
of eight positions hold one of them (`TRIPLES`), which keeps postings short where single bytes would give 256 huge ones.
Within a posting of any length (see postings.py), the byte lists of single positions tally the bytes that pairs share;
pairs are kept from 4 on, and verified by counting differing bits.  Copies share a fingerprint and are one entry.

Defined results: null texts and texts without words have fingerprint 0 and link like any other; a text of fewer words
than a shingle is one shingle; repeated rows link; a null doc_id is never the smallest unless alone; an empty table
gives an empty result.  Only doc_id and text are read; other columns pass through `drop_near_copies` untouched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import postings
from .common import materialize, pieces, sized, table
from .components import components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Removed ids of at most so many rows are broadcast.
BROADCAST_IDS = 1_000_000


def _triples() -> list[tuple[int, ...]]:
    """Split positions into three classes; take triples within a class, and of two from a class with one of the next."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for c in classes for t in combinations(c, 3)]
    for i, c in enumerate(classes):
        out += [(*two, one) for two in combinations(c, 2) for one in classes[(i + 1) % 3]]
    return out


TRIPLES = _triples()


def shingle_hashes(text: str | None, width: int, seed: int):
    """XXH64 of a text's shingles of words, in order, as arrays of at most 2^16."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(len(words) - width + 1, 1)
    stops = ends[-n:] if len(words) >= width else ends[-1:]
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    digest = xxhash.xxh64_digest
    for at in range(0, n, 1 << 16):
        part = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)].tolist(), stops[at : at + (1 << 16)].tolist(), strict=True)])
        yield np.frombuffer(part, dtype=np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> bytes:
    """8 bytes, most significant first."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, width, SEED):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch, 1)):
            fp = b"".join([fingerprint(t.as_py(), width) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(fp, dtype=">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _posting_keys(fp: Column) -> Column:
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for i, (a, b, c) in enumerate(TRIPLES):
        packed = F.shiftleft(byte(a), 16).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c))
        keys.append(packed.bitwiseOR(F.lit(i << 24)).cast("long"))
    return F.explode(F.array(*keys))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, tile: int = postings.TILE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join the same fingerprints as all links would."""
    entries = distinct.select(_posting_keys(F.col("fp")).alias("key"), F.col("fp").alias("node"))
    return postings.links(entries, ["node"], max_bits, 8 - max_bits, tile=tile)


def groups(docs: DataFrame, max_bits: int = MAX_BITS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id and root (the fingerprint that names the group) of each row."""
    fps = materialize(fingerprints(docs, width), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    return named_groups(fps, nodes, links(nodes.select("fp"), max_bits))


def named_groups(fps: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, fp, component_id and root of each row of fps (doc_id, fp), from its nodes (fp, first, n) and links."""
    comp = components(found).select(F.col("node").alias("fp"), "component")
    roots = nodes.join(sized(comp), "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("root"), F.col("component").isNotNull().alias("linked"))
    # a root's smallest document; only what is linked or repeated can differ from its own
    known = materialize(roots.where("linked or n > 1"), "simhash-known")
    least = materialize(known.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = known.join(sized(least), "root").select(F.col("fp").alias("known_fp"), "component_id", "root")
    out = fps.join(named, F.col("fp") == F.col("known_fp"), "left")
    component = F.when(F.col("known_fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "fp", component, F.coalesce("root", "fp").alias("root"))


def drop_near_copies(docs: DataFrame, index=None, mark=None) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, and one of its rows if it is repeated in the group; rows
    of one id in several groups are judged in each.  index gives (doc_id, fp, component_id, root) and mark the fp of one
    text; by default those of the 64-bit index."""
    index = index or groups
    mark = mark or (lambda t: int.from_bytes(fingerprint(t), "big", signed=True))
    found = materialize(index(docs), "simhash-groups")
    again = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-again")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    out = _without(docs, found.where(~first).select("doc_id").union(again.select("doc_id")).distinct())
    if again.head(1):
        # the rows of a repeated id may hold different texts: of these few, each row is looked at again
        rows = docs.join(sized(again, BROADCAST_IDS), docs["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
        at, fp_name = docs.columns.index("text"), "fp_" + "_".join(docs.columns)
        keep_id, keep_fp, keep_root = (f"{k}_{fp_name}" for k in ("id", "keep", "root"))

        def run(batches):
            for x in batches:
                fp = pa.array([mark(t.as_py()) for t in x.column(at)], pa.int64())
                yield pa.RecordBatch.from_arrays([*x.columns, fp], [*x.schema.names, fp_name])

        marked = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(fp_name, LongType())]))
        keep = found.where(first).select(F.col("doc_id").alias(keep_id), F.col("fp").alias(keep_fp), F.col("root").alias(keep_root)).distinct()
        hit = marked["doc_id"].eqNullSafe(keep[keep_id]) & (marked[fp_name] == keep[keep_fp])
        out = out.unionByName(marked.join(sized(keep), hit).dropDuplicates(["doc_id", keep_root]).select(*docs.columns))
    return out


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = materialize(ids.select(F.col("doc_id").alias("gone_id")), "simhash-gone")
    return docs.join(sized(ids, BROADCAST_IDS), docs["doc_id"].eqNullSafe(ids["gone_id"]), "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
