"""Queries over page structure, scores and reports on relations derived from the driver's tables, with SQL that must agree.

The tables hold no boxes, counts, chunks or metric rows, so both sides derive them by the same integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..constants import HARD_RULES, KEYS, METRICS, PRIORITY
from ..functions import markup as M
from ..functions import text as T
from ..operators import context as C
from ..operators import metrics as X
from ..operators import pages as P
from ..operators import scoring as S
from ..operators import views as V
from ..schemas import BLOCK, LOCATION
from ..sources import markdown as MD
from .text_queries import TURNS, docs, lerp_sql, pages_of, strip_sql, turns

LONG = lambda c: c.cast("long")
R6 = lambda c: T.rounded(c, 6)
CONFIG = Config()


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Four blocks a page: doc_id, page_no, ord, x0, y0, x1, y1 (some inverted, some outside a 1000 x 1400 page)."""
    t = turns(spark, d).select("doc_id", "page_no", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    k = F.col("doc_id") * 31 + F.col("page_no") * 17 + F.col("ord") * 7
    x0, y0 = (k * 13) % 600 - F.when(k % 23 == 0, 40).otherwise(0), F.col("ord") * 200 + (k * 5) % 150 - F.when(k % 11 == 0, 500).otherwise(0)
    w, h = 200 + (k * 3) % 400, F.when(k % 19 == 0, -20).otherwise(120 + k % 180)
    return t.select("doc_id", "page_no", "ord", *[c.cast("double").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x0 + w), ("y1", y0 + h))])


_BOXES = f"""{TURNS}, k AS (SELECT doc_id, page_no, ord, doc_id * 31 + page_no * 17 + ord * 7 AS k FROM turns, (SELECT unnest(range(4)) AS ord)),
xy AS (SELECT *, (k * 13) % 600 - CASE WHEN k % 23 = 0 THEN 40 ELSE 0 END AS x0, ord * 200 + (k * 5) % 150 - CASE WHEN k % 11 = 0 THEN 500 ELSE 0 END AS y0 FROM k),
boxes AS (SELECT doc_id, page_no, ord, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + 200 + (k * 3) % 400)::DOUBLE AS x1, (y0 + CASE WHEN k % 19 = 0 THEN -20 ELSE 120 + k % 180 END)::DOUBLE AS y1 FROM xy)"""


def boxed_pages(spark, d) -> DataFrame:
    """Pages whose blocks have those boxes; blocks of even ord are Text, others Figure."""
    b = boxes(spark, d)
    kind = F.when(F.col("ord") % 2 == 0, "Text").otherwise("Figure")
    block = F.struct(
        F.col("ord").alias("reading_order"), kind.alias("block_type"), F.lit("x").alias("text"), F.lit("").alias("html"), F.array("x0", "y0", "x1", "y1").alias("bbox"), F.expr("cast(array() as array<array<double>>)").alias("polygon"),
        F.lit(False).alias("inference_failed"), F.lit(False).alias("is_table"), (F.col("ord") % 2 == 1).alias("is_figure"), F.concat(F.lit("b"), F.col("ord").cast("string")).alias("block_id"),
    ).cast(BLOCK)
    rows = b.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return rows.withColumn("page_bbox", F.array(F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(1400.0)))


def geometry_boxes(spark, d):
    b = boxes(spark, d).withColumn("bbox", F.array("x0", "y0", "x1", "y1"))
    bad = M.degenerate(F.col("bbox"))
    return b.select("doc_id", "page_no", LONG(F.col("ord")).alias("ord"), bad.alias("degenerate"), (~bad & M.outside(F.col("bbox"), F.lit(1000.0), F.lit(1400.0))).alias("outside"), M.area(F.col("bbox")).alias("area"))


def overlap_pairs(spark, d):
    """A theta self-join: pairs of content blocks of a page that overlap by more than half of the smaller."""
    b = boxes(spark, d).withColumn("bbox", F.array("x0", "y0", "x1", "y1")).where((F.col("ord") % 2 == 0) & ~M.degenerate(F.col("bbox")))
    one, two = (b.select("doc_id", "page_no", F.col("ord").alias(f"ord_{s}"), F.col("bbox").alias(f"box_{s}")) for s in "ab")
    share = M.overlap_area(F.col("box_a"), F.col("box_b")) / F.least(M.area(F.col("box_a")), M.area(F.col("box_b")))
    return one.join(two, ["doc_id", "page_no"]).where((F.col("ord_a") < F.col("ord_b")) & (share > 0.5)).select("doc_id", "page_no", LONG(F.col("ord_a")).alias("ord_a"), LONG(F.col("ord_b")).alias("ord_b"), R6(share).alias("share"))


def order_inversions(spark, d):
    b = boxes(spark, d).where(~M.degenerate(F.array("x0", "y0", "x1", "y1")))
    before = F.lag("y0").over(W.partitionBy("doc_id", "page_no").orderBy("ord"))
    return b.withColumn("jump", F.when(F.col("y0") < before - 0.25 * 1400, 1).otherwise(0)).groupBy("doc_id", "page_no").agg(F.sum("jump").alias("inversions"))


def geometry_metric(spark, d):
    m = boxed_pages(spark, d).withColumn("m", X.bgc(CONFIG))
    return m.select("doc_id", "page_no", R6(F.col("m.raw_value")).alias("raw"), F.col("m.score").alias("score"), F.col("m.status").alias("status"), LONG(F.size("m.locations")).alias("n_locations"))


GEOMETRY_SQL = f"""
WITH {_BOXES}, b AS (SELECT *, (x1 - x0 <= 0 OR y1 - y0 <= 0) AS deg FROM boxes),
o AS (SELECT *, NOT deg AND (x0 < -2 OR y0 < -2 OR x1 > 1002 OR y1 > 1402) AS outs FROM b),
ov AS (SELECT a.doc_id, a.page_no, a.ord AS oa, c.ord AS oc FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page_no = c.page_no AND a.ord < c.ord AND a.ord % 2 = 0 AND c.ord % 2 = 0 AND NOT a.deg AND NOT c.deg
  WHERE least(a.x1, c.x1) > greatest(a.x0, c.x0) AND least(a.y1, c.y1) > greatest(a.y0, c.y0)
    AND (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) > 0.5),
bad AS (SELECT doc_id, page_no, ord FROM o WHERE deg OR outs UNION SELECT doc_id, page_no, oa FROM ov UNION SELECT doc_id, page_no, oc FROM ov),
inv AS (SELECT doc_id, page_no, sum(CASE WHEN y0 < prev - 350 THEN 1 ELSE 0 END) AS n FROM (SELECT *, lag(y0) OVER (PARTITION BY doc_id, page_no ORDER BY ord) AS prev FROM b WHERE NOT deg) GROUP BY ALL),
t AS (SELECT p.doc_id, p.page_no, coalesce(k, 0) AS k, coalesce(n, 0) AS n FROM (SELECT DISTINCT doc_id, page_no FROM boxes) p LEFT JOIN (SELECT doc_id, page_no, count(*) AS k FROM bad GROUP BY ALL) USING (doc_id, page_no) LEFT JOIN inv USING (doc_id, page_no)),
r AS (SELECT *, least(1.0, (k + n) / 4) AS raw FROM t), s AS (SELECT *, {lerp_sql('raw', 0.0, 0.4)} AS score FROM r)
SELECT doc_id, page_no, round(raw::DOUBLE, 6) AS raw, score, CASE WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'warn' ELSE 'bad' END AS status, CAST(k AS BIGINT) AS n_locations FROM s
"""


def counted_pages(spark, d) -> DataFrame:
    """Pages with block counts (sentences), recorded counts (off by some) and chunk coverage by arithmetic."""
    t = turns(spark, d)
    n = F.size(T.sentences(F.col("text")))
    meta = F.when((F.col("doc_id") + F.col("page_no")) % 5 == 0, None).otherwise(n + (F.col("doc_id") * 3 + F.col("page_no")) % 4)
    return t.select("doc_id", "page_no", n.alias("num_blocks_json"), meta.cast("int").alias("num_blocks_meta"), ((F.col("doc_id") + F.col("page_no")) % 7 != 0).alias("covered"))


def block_counts(spark, d):
    rows = counted_pages(spark, d)
    blocks = F.expr(f"cast(array() as array<{BLOCK}>)")
    rows = rows.withColumn("blocks", blocks)
    rows = rows.join(C.median_blocks(rows), "doc_id", "left").withColumn("chunk_meta", F.struct(F.lit(True).alias("chunks_present"), "covered"))
    m = rows.withColumn("m", X.bcc(CONFIG))
    return m.select("doc_id", "page_no", F.col("median_blocks").alias("median"), R6(F.col("m.raw_value")).alias("raw"), F.col("m.score").alias("score"), F.col("m.status").alias("status"), F.col("m.hard_fail").alias("hard"), F.col("m.applicable").alias("applicable"))


def median_blocks(spark, d):
    rows = counted_pages(spark, d).withColumn("blocks", F.expr(f"cast(array() as array<{BLOCK}>)"))
    return C.median_blocks(rows).select("doc_id", "median_blocks")


_COUNTS = f"""{TURNS}, c AS (SELECT doc_id, page_no, len([x FOR x IN string_split(regexp_replace({strip_sql('text')}, '([.!?])[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1)) IF {strip_sql('x')} <> '']) AS n FROM turns),
p AS (SELECT doc_id, page_no, n, CASE WHEN (doc_id + page_no) % 5 = 0 THEN NULL ELSE n + (doc_id * 3 + page_no) % 4 END AS meta, (doc_id + page_no) % 7 <> 0 AS covered FROM c),
md AS (SELECT doc_id, median(n)::DOUBLE AS median FROM p WHERE n <> 0 GROUP BY doc_id)"""
BCC_SQL = f"""
WITH {_COUNTS}, j AS (SELECT p.*, median FROM p LEFT JOIN md USING (doc_id)),
a AS (SELECT *, CASE WHEN meta IS NOT NULL THEN abs(n - meta) / greatest(meta, 1) WHEN coalesce(median, 0) <> 0 THEN greatest(0.0, 1 - n / median) ELSE 0.0 END AS raw FROM j),
b AS (SELECT *, meta IS NOT NULL AND raw > 0.20::DOUBLE AS hard, CASE WHEN meta IS NOT NULL THEN {lerp_sql('raw', 0.0, 0.5)} WHEN coalesce(median, 0) <> 0 THEN CASE WHEN n / median < 0.5 THEN 40.0 ELSE 100.0 END ELSE 100.0 END AS score FROM a),
s AS (SELECT *, CASE WHEN meta IS NOT NULL THEN CASE WHEN hard THEN 'bad' WHEN score < 70 THEN 'warn' ELSE 'good' END WHEN coalesce(median, 0) <> 0 THEN CASE WHEN n / median < 0.5 THEN 'warn' ELSE 'good' END ELSE 'na' END AS status FROM b)
SELECT doc_id, page_no, median, round(round(raw::DOUBLE, 4), 6) AS raw, CASE WHEN covered THEN score ELSE least(score, 55.0) END::DOUBLE AS score,
  CASE WHEN NOT covered AND status IN ('good', 'na') THEN 'warn' ELSE status END AS status, hard, (meta IS NOT NULL OR coalesce(median, 0) <> 0 OR NOT covered) AS applicable FROM s
"""


def inference_failures(spark, d):
    """Pages of five blocks, some of which the engine could not read; every third is not content."""
    t = turns(spark, d)
    one = lambda i: F.struct(
        F.lit(i).alias("reading_order"), F.lit("PageHeader" if i % 3 == 2 else "Text").alias("block_type"), F.lit("x").alias("text"), F.lit("").alias("html"), F.expr("cast(array() as array<double>)").alias("bbox"), F.expr("cast(array() as array<array<double>>)").alias("polygon"),
        ((F.col("doc_id") * 13 + F.col("page_no") * 7 + i) % 11 == 0).alias("inference_failed"), F.lit(False).alias("is_table"), F.lit(False).alias("is_figure"), F.lit(f"b{i}").alias("block_id"),
    ).cast(BLOCK)
    m = t.withColumn("blocks", F.array(*[one(i) for i in range(5)])).withColumn("m", X.ifr(CONFIG))
    return m.select("doc_id", "page_no", F.col("m.raw_value").alias("raw"), F.col("m.score").alias("score"), F.col("m.status").alias("status"), F.col("m.hard_fail").alias("hard"), LONG(F.size("m.locations")).alias("n_locations"))


IFR_SQL = f"""
WITH {TURNS}, b AS (SELECT doc_id, page_no, i, (doc_id * 13 + page_no * 7 + i) % 11 = 0 AS failed, i % 3 <> 2 AS content FROM turns, (SELECT unnest(range(5)) AS i)),
k AS (SELECT doc_id, page_no, count(*) FILTER (failed) AS k, count(*) FILTER (failed AND content) AS kc FROM b GROUP BY ALL),
r AS (SELECT *, k / 5 AS raw, {lerp_sql('k / 5', 0.0, 0.2)} AS soft FROM k)
SELECT doc_id, page_no, round(raw, 4)::DOUBLE AS raw, CASE WHEN kc > 0 THEN 0.0 WHEN k > 0 THEN soft ELSE 100.0 END::DOUBLE AS score, CASE WHEN kc > 0 THEN 'bad' WHEN k > 0 THEN CASE WHEN soft >= 50 THEN 'warn' ELSE 'bad' END ELSE 'good' END AS status,
  kc > 0 AS hard, CAST(CASE WHEN kc > 0 THEN k ELSE 0 END AS BIGINT) AS n_locations FROM r
"""


def table_integrity(spark, d):
    """One table a page, written as html: rows of 3 cells but ragged ones, blank cells, some without a header."""
    t = turns(spark, d)
    k = F.col("doc_id") * 5 + F.col("page_no") * 3
    cell = lambda r, c: F.concat(F.lit("<td>"), F.when((k + r * 2 + c) % 4 == 0, " ").otherwise("v"), F.lit("</td>"))
    row = lambda r: F.concat(F.lit("<tr>"), cell(r, F.lit(0)), cell(r, F.lit(1)), F.when((k + r) % 6 != 0, cell(r, F.lit(2))).otherwise(""), F.lit("</tr>"))
    head = F.when(k % 3 != 0, "<tr><th>a</th><th>b</th><th>c</th></tr>").otherwise("")
    html = F.concat(F.lit("<table>"), head, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), row), ""), F.lit("</table>"))
    m = t.withColumn("t", M.analyze_tables(F.array(html))[0])
    return m.select("doc_id", "page_no", LONG(F.col("t.rows")).alias("n_rows"), LONG(F.size("t.ragged_rows")).alias("ragged"), LONG(F.col("t.empty")).alias("empty"), R6(M.table_defect(F.col("t"))).alias("defect"))


TSI_SQL = f"""
WITH {TURNS}, k AS (SELECT doc_id, page_no, doc_id * 5 + page_no * 3 AS k FROM turns),
cells AS (SELECT doc_id, page_no, k, r, c, (k + r * 2 + c) % 4 = 0 AS blank FROM k, (SELECT unnest(range(1, 5)) AS r), (SELECT unnest(range(3)) AS c) WHERE c < 2 OR (k + r) % 6 <> 0),
rows AS (SELECT doc_id, page_no, k, r, count(*) AS n, count(*) FILTER (blank) AS blanks FROM cells GROUP BY ALL),
allr AS (SELECT doc_id, page_no, k, r, n, blanks FROM rows UNION ALL SELECT doc_id, page_no, k, 0, 3, 0 FROM k WHERE k % 3 <> 0),
m AS (SELECT doc_id, page_no, n AS mode, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY count(*) DESC, min(r)) AS o FROM allr GROUP BY doc_id, page_no, n),
s AS (SELECT a.doc_id, a.page_no, a.k, count(*) AS n_rows, count(*) FILTER (n <> mode) AS ragged, sum(blanks) AS empty, sum(n) AS n_cells FROM allr a JOIN m ON m.doc_id = a.doc_id AND m.page_no = a.page_no AND o = 1 GROUP BY ALL)
SELECT doc_id, page_no, n_rows, ragged, CAST(empty AS BIGINT) AS empty, round(least(1.0::DOUBLE, ragged / n_rows + empty / n_cells * 0.5::DOUBLE + CASE WHEN k % 3 <> 0 THEN 0.0 ELSE 0.4 END::DOUBLE), 6) AS defect FROM s
"""


def markdown_of(spark, d) -> DataFrame:
    """One markdown text a conversation, pages headed by delimiters (every fifth is missing)."""
    t = turns(spark, d).where((F.col("doc_id") + F.col("page_no")) % 5 != 0)
    part = F.concat(F.lit("\n{"), F.col("page_no").cast("string"), F.lit("}----------------\n"), F.coalesce("text", F.lit("")))
    return t.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", part.alias("part")))), lambda x: x["part"]), "").alias("md"))


def split_markdown_pages(spark, d):
    return MD.markdown_pages(markdown_of(spark, d), "doc_id", "md").select("doc_id", LONG(F.col("page_no")).alias("page_no"), F.col("segment"))


def md_left_join(spark, d):
    """Markdown and recorded counts looked up by raw page number: left joins, missing pages stay."""
    t, md = turns(spark, d).select("doc_id", "page_no"), MD.markdown_pages(markdown_of(spark, d), "doc_id", "md")
    meta = counted_pages(spark, d).select("doc_id", "page_no", "num_blocks_meta").where("num_blocks_meta is not null")
    j = t.join(md, ["doc_id", "page_no"], "left").join(meta, ["doc_id", "page_no"], "left")
    return j.select("doc_id", "page_no", F.col("segment").isNotNull().alias("has_md"), LONG(F.col("num_blocks_meta")).alias("meta"))


def chunk_attach(spark, d):
    """Chunks of two 0-based pages each, every fourth missing; a page takes the chunks of its shifted number, else its
    own, else one less (a priority join)."""
    t = turns(spark, d)
    chunks = t.where((F.col("page_no") % 2 == 1) & ((F.col("doc_id") + F.col("page_no")) % 4 != 0)).select("doc_id", F.col("page_no").alias("chunk_ord"), F.array(F.col("page_no") - 1, F.col("page_no")).alias("page_ids"))
    stats = F.expr("named_struct('has_table', false, 'table_count', 0, 'table_density', 0.0D)")
    chunks = chunks.select("*", F.col("chunk_ord").cast("string").alias("chunk_title"), F.lit("x").alias("content"), F.lit(0).alias("token_count"), stats.alias("table_metrics"))
    meta = F.col("chunk_meta")
    found = P.attach_chunks(t.select("doc_id", "page_no", F.col("page_no").alias("raw_page_no")), chunks)
    return found.select("doc_id", "page_no", LONG(meta["title"]).alias("chunk_ord"), F.coalesce(meta["covered"], F.lit(False)).alias("covered"))


CHUNK_SQL = f"""
WITH {TURNS}, ids AS (SELECT doc_id, page_no AS chunk_ord, unnest([page_no - 1, page_no]) AS id FROM turns WHERE page_no % 2 = 1 AND (doc_id + page_no) % 4 <> 0),
sh AS (SELECT t.doc_id, p0 - i0 AS shift FROM (SELECT doc_id, min(page_no) AS p0 FROM turns GROUP BY doc_id) t JOIN (SELECT doc_id, min(id) AS i0 FROM ids GROUP BY doc_id) i USING (doc_id)),
tr AS (SELECT t.doc_id, page_no, unnest([0, 1, 2]) AS rank, unnest([page_no - coalesce(shift, 0), page_no, page_no - 1]) AS id FROM turns t LEFT JOIN sh USING (doc_id)),
h AS (SELECT tr.doc_id, tr.page_no, chunk_ord, row_number() OVER (PARTITION BY tr.doc_id, tr.page_no ORDER BY rank, chunk_ord) AS k FROM tr JOIN ids USING (doc_id, id))
SELECT t.doc_id, t.page_no, chunk_ord, chunk_ord IS NOT NULL AS covered FROM turns t LEFT JOIN h ON h.doc_id = t.doc_id AND h.page_no = t.page_no AND k = 1
"""


def page_count_audit(spark, d):
    t = turns(spark, d)
    n = t.groupBy("doc_id").agg(F.count("*").alias("n"))
    c = n.select("doc_id", LONG(F.col("n")).alias("json_pages"), LONG(F.col("n") - F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("md_pages"), LONG(F.when(F.col("doc_id") % 2 == 0, F.col("n"))).alias("meta_pages"), LONG(F.col("n") + F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)).alias("source_pages"))
    counts = F.create_map(*[x for k in ("json_pages", "md_pages", "meta_pages") for x in (F.lit("output.json" if k == "json_pages" else k), F.col(k))])
    audit = P.page_audit(c.select("doc_id", counts.alias("counts"), "source_pages"))
    return audit.select("doc_id", F.col("ocr_consistent").alias("consistent"), F.col("delta_ocr_minus_source").alias("delta"), "status")


def page_text(spark, d):
    return pages_of(spark, d).select(LONG(F.col("doc_id")).alias("doc_id"), LONG(F.col("page_no")).alias("page_no"), "text", "prose")


def renumber_pages(spark, d):
    t = turns(spark, d).where((F.col("doc_id") + F.col("page_no")) % 3 != 0).withColumn("raw_page_no", F.col("page_no") * 10)
    return P.renumber(t).select("doc_id", LONG(F.col("raw_page_no")).alias("raw_page_no"), LONG(F.col("page_no")).alias("page_no"))


def metric_arrays(spark, d) -> DataFrame:
    """Pages with fourteen synthetic metric results each."""
    t = turns(spark, d)

    def one(i, key):
        k = F.col("doc_id") * 7 + F.col("page_no") * 13 + i * 29
        score = (100 - (k * 37) % 97 * F.when(k % 3 == 0, 1).otherwise(0)).cast("double")
        applicable, hard = k % 11 != 0, (k % 53 == 0) & F.lit(key in HARD_RULES)
        where = F.when(k % 4 == 0, F.array(F.struct(F.lit("rare_word").alias("kind"), F.lit("statistical").alias("confidence"), F.lit("b").alias("block_id"), F.expr("cast(array() as array<double>)").alias("bbox"), F.lit(key.lower()).alias("snippet")).cast(LOCATION))).otherwise(F.expr(X.NO_LOCATIONS))
        return X.result(key, 0.0, score, T.status_of(score), {}, "", "", F.expr(X.NO_TEXT), F.format_string(f"{key} score %.0f", score), where, F.lit(False), applicable, hard)

    return t.select(F.col("doc_id"), F.col("page_no"), F.array(*[one(i, k) for i, k in enumerate(KEYS)]).alias("metrics"), F.lit(None).cast("string").alias("image_path"), LONG(F.size(T.word_tokens(F.col("text")))).alias("token_count"))


_VALUES = ", ".join(f"({i}, '{k}', {w}::DOUBLE, {PRIORITY.index(k)}, {str(k in HARD_RULES).lower()})" for i, (k, _, w) in enumerate(METRICS))
_METRIC = f"""{TURNS}, keys(ord, key, w, prio, can) AS (VALUES {_VALUES}),
m0 AS (SELECT doc_id, page_no, text, ord, key, w, prio, can, doc_id * 7 + page_no * 13 + ord * 29 AS k FROM turns, keys),
m AS (SELECT doc_id, page_no, ord, key, w, prio, (100 - (k * 37) % 97 * CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS score, k % 11 <> 0 AS applicable, k % 53 = 0 AND can AS hard, k % 4 = 0 AS located FROM m0),
wt AS (SELECT doc_id, page_no, list_reduce(list(w ORDER BY ord) FILTER (applicable), lambda a, b: a + b) AS total FROM m GROUP BY ALL),
pq AS (SELECT doc_id, page_no, coalesce(round(list_reduce(list(w / total * score ORDER BY ord) FILTER (applicable), lambda a, b: a + b), 1), 100.0) AS pqs, count(*) FILTER (applicable AND hard) AS n_hard FROM m JOIN wt USING (doc_id, page_no) GROUP BY ALL),
pr AS (SELECT *, pqs < 70 OR n_hard > 0 AS review FROM pq)"""
WORDS_N = r"len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+(?:[''’\-][\p{L}\p{Nl}\p{No}]+)*'))"
_DOC = f"""{_METRIC}, tk AS (SELECT doc_id, page_no, {WORDS_N} AS tokens FROM turns),
dq AS (SELECT pr.doc_id, round(sum(greatest(tokens, 40)::DOUBLE * pqs) / sum(greatest(tokens, 40)::DOUBLE), 1) AS dqs, count(*) AS total, count(*) FILTER (review) AS faulty, count(*) FILTER (n_hard > 0) AS hard_pages FROM pr JOIN tk USING (doc_id, page_no) GROUP BY pr.doc_id)"""


def weights_renormalised(spark, d):
    """Each applicable metric's weight as a share of its page's, by a window."""
    rows = X.metric_rows(metric_arrays(spark, d)).where("applicable")
    w = S.weight_of(F.col("key"), CONFIG)
    return rows.select("doc_id", "page_no", "key", R6(w / F.sum(w).over(W.partitionBy("doc_id", "page_no"))).alias("share"))


def page_scores(spark, d):
    r = S.page_reports(metric_arrays(spark, d))
    return r.select("doc_id", "page_no", "page_score", "verdict", LONG(F.size("hard_keys")).alias("n_hard"))


def document_verdicts(spark, d):
    r = S.document_reports(S.page_reports(metric_arrays(spark, d)))
    return r.select("doc_id", "document_score", "document_verdict", LONG(F.col("summary.faulty_pages")).alias("faulty"), F.col("summary.faulty_ratio").alias("faulty_ratio"), LONG(F.size("summary.hard_pages")).alias("n_hard_pages"), F.array_join("summary.hard_rules", ",").alias("hard_rules"))


def problem_lines(spark, d):
    r = S.page_reports(metric_arrays(spark, d))
    return r.select("doc_id", "page_no", F.posexplode("problems").alias("pos", "problem")).select("doc_id", "page_no", LONG(F.col("pos") + 1).alias("rank"), "problem")


def faulty_worst_first(spark, d):
    f = V.faulty_pages(S.page_reports(metric_arrays(spark, d)))
    return f.select("doc_id", "page_no", "page_score", LONG(F.col("rank")).alias("rank"), "worst_metrics", "top_problem")


def passed_lowest_metric(spark, d):
    p = V.passed_pages(S.page_reports(metric_arrays(spark, d)))
    return p.select("doc_id", "page_no", "page_score", "lowest_metric")


def located_evidence(spark, d):
    return V.locations(S.page_reports(metric_arrays(spark, d))).groupBy("doc_id", "confidence").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_metrics"))


def page_walker(spark, d):
    w = V.walker(S.page_reports(metric_arrays(spark, d)))
    return w.select("doc_id", "page_no", LONG(F.col("k")).alias("k"), LONG(F.col("n")).alias("n"), LONG(F.col("previous")).alias("previous"), LONG(F.col("following")).alias("following"))


def metric_sections(spark, d):
    s = V.ordered_metrics(S.page_reports(metric_arrays(spark, d)))
    return s.select("doc_id", "page_no", "section", LONG(F.col("rank")).alias("rank"), "key")


def human_calls(spark, d):
    """Reviewers' calls on faulty pages: labels stand in for them."""
    calls = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id"), F.lit(1).alias("page_no"), F.when(F.col("toxic") == 1, "confirm").when(F.col("quality") == 1, "dismiss").otherwise("undecided").alias("call"))
    pages = docs(spark, d).select("doc_id", F.lit(1).alias("page_no"), (F.col("doc_id") % 5).alias("bucket"))
    return V.human_call_tally(pages, calls, ["bucket"]).select(LONG(F.col("bucket")).alias("bucket"), "pages", "decided")


def review_csv(spark, d):
    return V.review_rows(S.page_reports(metric_arrays(spark, d))).select("doc_id", "page_no", "PQS", "problem_1", "problem_2", "problem_3")


def page_report(spark, d):
    """All fourteen metrics, score and verdict of every conversation page."""
    r = S.page_reports(X.page_metrics(P.from_texts(turns(spark, d)), CONFIG))
    return r.select(LONG(F.col("doc_id")).alias("doc_id"), "page_no", "page_score", "verdict", F.array_join("hard_keys", ",").alias("hard_keys"), "problems", "token_count")


def document_report(spark, d):
    r = S.document_reports(S.page_reports(X.page_metrics(P.from_texts(turns(spark, d)), CONFIG)))
    return r.select(LONG(F.col("doc_id")).alias("doc_id"), "document_score", "document_verdict", "verdict_reason")


QUERIES = {
    f.__name__: f
    for f in (
        geometry_boxes, overlap_pairs, order_inversions, geometry_metric, block_counts, median_blocks, inference_failures, table_integrity, split_markdown_pages, md_left_join, chunk_attach, page_count_audit, page_text,
        renumber_pages, weights_renormalised, page_scores, document_verdicts, problem_lines, faulty_worst_first, passed_lowest_metric, located_evidence, page_walker, metric_sections, human_calls, review_csv, page_report, document_report,
    )
}

_PROBLEMS = """, lines AS (SELECT m.doc_id, m.page_no, '[' || key || '] ' || key || ' score ' || printf('%.0f', score) AS problem, row_number() OVER (PARTITION BY m.doc_id, m.page_no ORDER BY CASE WHEN hard THEN 0 ELSE 1 END, prio) AS rank
  FROM m JOIN pr ON pr.doc_id = m.doc_id AND pr.page_no = m.page_no AND review WHERE applicable AND (hard OR score < 60))"""
SQL = {
    "geometry_boxes": f"WITH {_BOXES} SELECT doc_id, page_no, ord, (x1 - x0 <= 0 OR y1 - y0 <= 0) AS degenerate, NOT (x1 - x0 <= 0 OR y1 - y0 <= 0) AND (x0 < -2 OR y0 < -2 OR x1 > 1002 OR y1 > 1402) AS outside, (x1 - x0) * (y1 - y0) AS area FROM boxes",
    "overlap_pairs": f"WITH {_BOXES}, b AS (SELECT * FROM boxes WHERE ord % 2 = 0 AND x1 > x0 AND y1 > y0), p AS (SELECT a.doc_id, a.page_no, a.ord AS ord_a, c.ord AS ord_b, greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0.0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) AS share FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page_no = c.page_no AND a.ord < c.ord) SELECT doc_id, page_no, ord_a, ord_b, round(share, 6) AS share FROM p WHERE share > 0.5",
    "order_inversions": f"WITH {_BOXES}, l AS (SELECT *, lag(y0) OVER (PARTITION BY doc_id, page_no ORDER BY ord) AS prev FROM boxes WHERE x1 > x0 AND y1 > y0) SELECT doc_id, page_no, CAST(sum(CASE WHEN y0 < prev - 350 THEN 1 ELSE 0 END) AS BIGINT) AS inversions FROM l GROUP BY ALL",
    "geometry_metric": GEOMETRY_SQL,
    "block_counts": BCC_SQL,
    "median_blocks": f"WITH {_COUNTS} SELECT doc_id, median AS median_blocks FROM md",
    "inference_failures": IFR_SQL,
    "table_integrity": TSI_SQL,
    "split_markdown_pages": f"WITH {TURNS} SELECT doc_id, page_no, {strip_sql('text')} AS segment FROM turns WHERE (doc_id + page_no) % 5 <> 0",
    "md_left_join": f"WITH {_COUNTS} SELECT doc_id, page_no, (doc_id + page_no) % 5 <> 0 AS has_md, CAST(meta AS BIGINT) AS meta FROM p",
    "chunk_attach": CHUNK_SQL,
    "page_count_audit": f"WITH {TURNS}, n AS (SELECT doc_id, count(*) AS n FROM turns GROUP BY doc_id), c AS (SELECT doc_id, doc_id % 3 <> 0 AS consistent, CASE WHEN doc_id % 4 = 1 THEN -1 ELSE 0 END AS delta FROM n) SELECT doc_id, consistent, CAST(delta AS BIGINT) AS delta, CASE WHEN NOT consistent THEN 'ocr_inconsistent' WHEN delta <> 0 THEN 'source_mismatch' ELSE 'ok' END AS status FROM c",
    "page_text": f"WITH {TURNS} SELECT doc_id, page_no, text, text AS prose FROM turns",
    "renumber_pages": f"WITH {TURNS} SELECT doc_id, page_no * 10 AS raw_page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no FROM turns WHERE (doc_id + page_no) % 3 <> 0",
    "weights_renormalised": f"WITH {_METRIC} SELECT doc_id, page_no, key, round(w / sum(w) OVER (PARTITION BY doc_id, page_no), 6) AS share FROM m WHERE applicable",
    "page_scores": f"WITH {_METRIC} SELECT doc_id, page_no, pqs AS page_score, CASE WHEN review THEN 'review' ELSE 'ok' END AS verdict, n_hard FROM pr",
    "document_verdicts": f"WITH {_DOC}, hr AS (SELECT doc_id, string_agg(key, ',' ORDER BY key) AS hard_rules FROM (SELECT DISTINCT doc_id, key FROM m WHERE applicable AND hard) GROUP BY doc_id) SELECT doc_id, dqs AS document_score, CASE WHEN dqs >= 75 AND faulty / total <= 0.20::DOUBLE AND hard_pages = 0 THEN 'PASSED' ELSE 'FAILED' END AS document_verdict, faulty, round(faulty / total, 3) AS faulty_ratio, hard_pages AS n_hard_pages, coalesce(hard_rules, '') AS hard_rules FROM dq LEFT JOIN hr USING (doc_id)",
    "problem_lines": f"WITH {_METRIC}{_PROBLEMS} SELECT doc_id, page_no, rank, problem FROM lines",
    "faulty_worst_first": f"WITH {_METRIC}{_PROBLEMS}, w AS (SELECT doc_id, page_no, string_agg(key || ' ' || printf('%.0f', score), ', ' ORDER BY r) AS worst_metrics FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY hard DESC, score, ord) AS r FROM m WHERE applicable) WHERE r <= 3 GROUP BY ALL) SELECT pr.doc_id, pr.page_no, pqs AS page_score, row_number() OVER (PARTITION BY pr.doc_id ORDER BY pqs, pr.page_no) AS rank, worst_metrics, coalesce(problem, '—') AS top_problem FROM pr JOIN w USING (doc_id, page_no) LEFT JOIN lines l ON l.doc_id = pr.doc_id AND l.page_no = pr.page_no AND l.rank = 1 WHERE review",
    "passed_lowest_metric": f"WITH {_METRIC}, l AS (SELECT doc_id, page_no, key || ' ' || printf('%.0f', score) AS lowest_metric, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY score, ord) AS r FROM m WHERE applicable) SELECT pr.doc_id, pr.page_no, pqs AS page_score, lowest_metric FROM pr JOIN l ON l.doc_id = pr.doc_id AND l.page_no = pr.page_no AND r = 1 WHERE NOT review",
    "located_evidence": f"WITH {_METRIC} SELECT doc_id, 'statistical' AS confidence, count(*) AS n, count(DISTINCT key) AS n_metrics FROM m WHERE applicable AND located GROUP BY doc_id",
    "page_walker": f"WITH {TURNS} SELECT doc_id, page_no, row_number() OVER o AS k, count(*) OVER (PARTITION BY doc_id) AS n, lag(page_no) OVER o AS previous, lead(page_no) OVER o AS following FROM turns WINDOW o AS (PARTITION BY doc_id ORDER BY page_no)",
    "metric_sections": f"WITH {_METRIC}, s AS (SELECT *, CASE WHEN hard OR score < 70 THEN 'failing' ELSE 'passing' END AS section FROM m WHERE applicable) SELECT doc_id, page_no, section, row_number() OVER (PARTITION BY doc_id, page_no, section ORDER BY CASE WHEN section = 'failing' AND NOT hard THEN 1 ELSE 0 END, CASE WHEN section = 'failing' THEN score ELSE -score END, ord) AS rank, key FROM s",
    "human_calls": "WITH c AS (SELECT d.doc_id % 5 AS bucket, CASE WHEN l.toxic = 1 THEN 'confirm' WHEN l.quality = 1 THEN 'dismiss' ELSE 'undecided' END AS call FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT bucket, count(*) AS pages, CAST(count(*) FILTER (call <> 'undecided') AS BIGINT) AS decided FROM c GROUP BY bucket",
    "review_csv": f"WITH {_METRIC}{_PROBLEMS}, p AS (SELECT doc_id, page_no, max(problem) FILTER (rank = 1) AS p1, max(problem) FILTER (rank = 2) AS p2, max(problem) FILTER (rank = 3) AS p3 FROM lines GROUP BY ALL) SELECT pr.doc_id, pr.page_no, printf('%.1f', pqs) AS PQS, coalesce(p1, '') AS problem_1, coalesce(p2, '') AS problem_2, coalesce(p3, '') AS problem_3 FROM pr LEFT JOIN p USING (doc_id, page_no) WHERE review",
}
