"""Splitting page-delimited markdown without leaving Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nz, strip

LINE = r"(?m)^\s*\{?\d+\}?\s*-{6,}\s*$"


def markdown_pages(df: DataFrame, doc_id: str, column: str) -> DataFrame:
    """doc_id, page_no, segment: text after each delimiter line; page 1 if there is none; the last of a number counts."""
    md = nz(F.col(column))
    numbers = F.regexp_extract_all(md, F.lit(r"(?m)^\s*\{?(\d+)\}?\s*-{6,}\s*$"), F.lit(1))
    parts = F.slice(F.split(md, LINE), 2, 1_000_000_000)
    zipped = F.when(F.size(numbers) > 0, F.arrays_zip(numbers.cast("array<int>").alias("page_no"), parts.alias("segment"))).when(md != "", F.array(F.struct(F.lit(1).alias("page_no"), md.alias("segment"))))
    rows = df.select(doc_id, F.posexplode(zipped).alias("pos", "s"))
    return rows.groupBy(doc_id, F.col("s.page_no").alias("page_no")).agg(strip(F.max_by("s.segment", "pos")).alias("segment"))
