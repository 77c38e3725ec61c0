"""Markup, geometry and table functions."""

from __future__ import annotations

import difflib
import gzip
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..constants import VOID_TAGS
from .text import nz

TAG = r"<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9]*)\b[^>]*?(/?)\s*>"
BAD_AMPERSAND = r"&(?!amp;|lt;|gt;|quot;|apos;|nbsp;|#\d+;|#x[0-9a-fA-F]+;)"


def tags(html: Column) -> Column:
    """array<struct<close, name, own>> of the tags that a balance check looks at (no void or self-closed ones)."""
    whole = F.regexp_extract_all(nz(html), F.lit(f"({TAG})"), F.lit(1))
    part = lambda t, k: F.regexp_extract(t, TAG, k)
    found = F.transform(whole, lambda t: F.struct((part(t, 1) == "/").alias("close"), F.lower(part(t, 2)).alias("name"), (part(t, 3) == "/").alias("own")))
    return F.filter(found, lambda t: ~t["own"] & ~t["name"].isin(VOID_TAGS))


def malformed(html: Column) -> Column:
    """Why a block's markup is malformed, or null: a stray close, else an element left open, else a raw ampersand.  A
    close ends everything opened since its match.  The open elements are kept as a path, /div/p/b."""
    start = F.struct(F.lit("").alias("path"), F.lit(None).cast("string").alias("why"))

    def step(s, t):
        is_open = F.concat(s["path"], F.lit("/")).contains(F.concat(F.lit("/"), t["name"], F.lit("/")))
        closed = F.regexp_replace(s["path"], F.concat(F.lit("^(.*)/"), t["name"], F.lit("(?:/.*)?$")), F.lit("$1"))
        path = F.when(~t["close"], F.concat(s["path"], F.lit("/"), t["name"])).when(is_open, closed).otherwise(s["path"])
        why = F.when(t["close"] & ~is_open, F.concat(F.lit("stray closing </"), t["name"], F.lit(">")))
        return F.struct(path.alias("path"), F.coalesce(s["why"], why).alias("why"))

    left = lambda s: F.when(s["path"] != "", F.concat(F.lit("unclosed <"), F.substring_index(s["path"], "/", -1), F.lit(">")))
    raw = F.when(nz(html).rlike(BAD_AMPERSAND), F.lit("broken/raw '&' entity"))
    return F.when(nz(html).contains("<"), F.coalesce(F.aggregate(tags(html), start, step, lambda s: F.coalesce(s["why"], left(s))), raw))


def area(b: Column) -> Column:
    return F.when(F.size(b) == 4, (b[2] - b[0]) * (b[3] - b[1])).otherwise(0.0)


def degenerate(b: Column) -> Column:
    return F.when(F.size(b) == 4, (b[2] - b[0] <= 0) | (b[3] - b[1] <= 0)).otherwise(True)


def outside(b: Column, width: Column, height: Column, slack: float = 2.0) -> Column:
    return F.when(F.size(b) == 4, (b[0] < -slack) | (b[1] < -slack) | (b[2] > width + slack) | (b[3] > height + slack)).otherwise(False)


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((F.size(a) == 4) & (F.size(b) == 4) & (w > 0) & (h > 0), w * h).otherwise(0.0)


class _Table(HTMLParser):
    """Rows and cells of the first table of some html; cells of nested tables count with their row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.has_head = 0, False, False
        self.rows: list[list[tuple[str | None, bool]]] = []
        self.cells: list[tuple[str | None, list[str]]] = []
        self.open: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if not self.depth or self.done:
            return
        if tag == "thead":
            self.has_head = True
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            span = dict(attrs).get("colspan")
            text: list[str] = []
            self.cells.append((span, text))
            self.open.append(text)
            if self.rows:
                self.rows[-1].append((span, tag == "th"))

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.open:
            self.open.pop()
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.done or self.depth == 0
            if self.done:
                self.open.clear()

    def handle_data(self, data):
        if not self.done:
            for text in self.open:
                text.append(data)


def analyze_table(html: str | None) -> dict:
    """What the structure of the first table is; valid is false without one or without rows."""
    t = _Table()
    t.feed(html or "")
    t.close()
    if not t.rows:
        return {"valid": False, "rows": 0, "has_header": False, "col_mode": 0, "ragged_rows": [], "empty": 0, "n_cells": 0, "stray": 0}

    def span(s):
        try:
            return int(s) if s else 1
        except ValueError:
            return 1

    def is_stray(s, most):
        try:
            return bool(s) and int(s) > most
        except ValueError:
            return True

    cols = [sum(span(s) for s, _ in row) for row in t.rows]
    mode = max(dict.fromkeys(cols), key=cols.count)
    return {
        "valid": True,
        "rows": len(cols),
        "has_header": t.has_head or any(h for _, h in t.rows[0]),
        "col_mode": mode,
        "ragged_rows": [i + 1 for i, c in enumerate(cols) if c != mode],
        "empty": sum(not "".join(x).strip() for _, x in t.cells),
        "n_cells": len(t.cells),
        "stray": sum(is_stray(s, max(mode, 1)) for s, _ in t.cells),
    }


TABLE = "struct<valid:boolean,rows:int,has_header:boolean,col_mode:int,ragged_rows:array<int>,empty:int,n_cells:int,stray:int>"


def analyze_tables(htmls: Column) -> Column:
    """array of TABLE for an array of html."""

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[analyze_table(h) for h in row] if row is not None else None for row in rows])

    return pandas_udf(run, f"array<{TABLE}>")(htmls)


def table_defect(t: Column) -> Column:
    """0 (sound) to 1, from ragged rows, empty cells, a missing header and stray spans."""
    ragged, empty = F.size(t["ragged_rows"]) / F.greatest(t["rows"], F.lit(1)), t["empty"] / F.greatest(t["n_cells"], F.lit(1))
    penalty = F.when(t["has_header"], 0.0).otherwise(0.4) + F.least(F.lit(0.3), t["stray"] * 0.1)
    return F.when(t["valid"], F.least(F.lit(1.0), ragged + empty * 0.5 + penalty)).otherwise(1.0)


def gzip_ratio(text: Column) -> Column:
    """Bytes over gzipped bytes; 1 for blank texts."""

    def one(t):
        if t is None or not t.strip():
            return 1.0
        raw = t.encode("utf-8")
        return len(raw) / max(1, len(gzip.compress(raw)))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one).astype("float64")

    return pandas_udf(run, "double")(text)


def sequence_similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks; null if either is null or empty."""

    def run(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else None for x, y in zip(one, other, strict=True)], dtype="float64")

    return pandas_udf(run, "double")(a, b)
