"""The page relation: its text, and building one from a plain table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CONTENT_TYPES, FIGURE_TYPES, PROSE_TYPES
from ..functions.text import is_blank, nz
from ..schemas import BLOCK, CHUNK_META, PAGES


def is_table(block_type: Column, html: Column) -> Column:
    return F.lower(nz(html)).contains("<table") | (nz(block_type) == "Table")


def is_figure(block_type: Column, html: Column) -> Column:
    low = F.lower(nz(html))
    return F.lower(nz(block_type)).isin(FIGURE_TYPES) | low.contains("<img") | low.contains("img-description")


def is_prose(b: Column) -> Column:
    return ~b["is_table"] & ~b["is_figure"] & b["block_type"].isin(PROSE_TYPES)


def is_content(b: Column) -> Column:
    return b["block_type"].isin(CONTENT_TYPES) | b["is_table"]


def text_of(blocks: Column) -> Column:
    """Block texts that are not blank, one a line, in reading order (blocks are kept in that order)."""
    return F.array_join(F.filter(F.transform(blocks, lambda b: nz(b["text"])), lambda t: ~is_blank(t)), "\n")


def with_text(pages: DataFrame) -> DataFrame:
    """pages with text (all blocks) and prose (prose blocks)."""
    return pages.withColumn("text", text_of(F.col("blocks"))).withColumn("prose", text_of(F.filter("blocks", is_prose)))


def from_texts(rows: DataFrame) -> DataFrame:
    """Pages of one Text block each from rows (doc_id, page_no, text) and, if present, language and native_text."""
    block = F.struct(
        F.lit(0).alias("reading_order"), F.lit("Text").alias("block_type"), nz(F.col("text")).alias("text"), F.lit("").alias("html"),
        F.expr("cast(array() as array<double>)").alias("bbox"), F.expr("cast(array() as array<array<double>>)").alias("polygon"),
        F.lit(False).alias("inference_failed"), F.lit(False).alias("is_table"), F.lit(False).alias("is_figure"), F.lit("").alias("block_id"),
    )
    given = {c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string") for c in ("language", "native_text", "md_text", "html_text")}
    return rows.select(
        F.col("doc_id").cast("string"), F.col("page_no").cast("int"), F.col("page_no").cast("int").alias("raw_page_no"),
        F.when(is_blank(F.col("text")), F.expr(f"cast(array() as array<{BLOCK}>)")).otherwise(F.array(block)).cast(f"array<{BLOCK}>").alias("blocks"),
        given["md_text"].alias("md_text"), given["html_text"].alias("html_text"),
        F.lit(None).cast("int").alias("num_blocks_meta"), F.lit(None).cast("int").alias("num_blocks_json"),
        F.lit(None).cast("array<double>").alias("page_bbox"), F.lit(None).cast("string").alias("chunk_text"),
        F.lit(None).cast(CHUNK_META).alias("chunk_meta"), given["language"].alias("language"), given["native_text"].alias("native_text"), F.lit(None).cast("string").alias("image_path"),
    )


def columns() -> list[str]:
    return [c.split()[0] for c in PAGES.replace(BLOCK, "B").replace(CHUNK_META, "C").split(", ")]


def renumber(pages: DataFrame) -> DataFrame:
    """Contiguous 1-based page_no in the order of raw_page_no (stable)."""
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy("raw_page_no", "page_no")
    return pages.withColumn("page_no", F.row_number().over(order))


def attach_chunks(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """pages with chunk_text and chunk_meta of the chunks that cover them, as a priority join on raw_page_no: the chunk id
    at the document's shift (smallest page less smallest id), else the page's own number, else one less.  Pages of
    documents without chunks have neither."""
    ids = chunks.select("doc_id", F.explode("page_ids").alias("id"), F.struct("chunk_ord", "content", "chunk_title", "token_count", F.size("page_ids").alias("n"), "table_metrics").alias("c"))
    per_id = ids.groupBy("doc_id", "id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    numbers = pages.select("doc_id", F.col("raw_page_no").alias("page")).distinct()
    low = numbers.groupBy("doc_id").agg(F.min("page").alias("page0")).join(ids.groupBy("doc_id").agg(F.min("id").alias("id0")), "doc_id")
    tries = numbers.join(low, "doc_id").select("doc_id", "page", F.posexplode(F.array(F.col("page") - F.col("page0") + F.col("id0"), F.col("page"), F.col("page") - 1)).alias("rank", "id"))
    hits = tries.join(per_id, ["doc_id", "id"]).groupBy("doc_id", "page").agg(F.min_by("cs", "rank").alias("cs"))
    first = F.col("cs")[0]
    found = hits.select(
        "doc_id", F.col("page").alias("raw_page_no"), F.array_join(F.transform("cs", lambda c: c["content"]), "\n\n").alias("chunk_text"),
        F.struct(first["chunk_title"].alias("title"), first["token_count"].alias("token_count"), first["n"].alias("n_pages"), (first["n"] == 1).alias("single_page"), first["table_metrics"].alias("t")).alias("hit"),
    )
    has = chunks.select("doc_id").distinct().withColumn("has_chunks", F.lit(True))
    out = pages.join(found, ["doc_id", "raw_page_no"], "left").join(has, "doc_id", "left")
    hit, t = F.col("hit"), F.col("hit")["t"]
    meta = F.struct(F.lit(True).alias("chunks_present"), hit.isNotNull().alias("covered"), hit["title"], hit["token_count"], hit["n_pages"], hit["single_page"], t["has_table"], t["table_count"], t["table_density"])
    return out.withColumn("chunk_meta", F.when(F.col("has_chunks"), meta).cast(CHUNK_META)).drop("hit", "has_chunks")


def page_audit(counted: DataFrame) -> DataFrame:
    """Whether the artefacts of a document agree on its pages, and with its source, from (doc_id, counts: a map with null
    for what is missing, source_pages).  Pages are those of the block tree, else the most frequent count."""
    known = F.filter(F.map_values("counts"), lambda n: n.isNotNull())
    most = F.array_max(F.transform(known, lambda n: F.struct(F.size(F.filter(known, lambda x: x == n)).alias("times"), (-n).alias("less"))))
    tree = F.element_at("counts", F.lit("output.json"))
    out = counted.select("doc_id", "counts", (F.size(F.array_distinct(known)) <= 1).alias("ocr_consistent"), F.when(tree > 0, tree).otherwise(F.coalesce(-most["less"], F.lit(0))).alias("ocr_pages"), "source_pages")
    out = out.withColumn("delta_ocr_minus_source", F.col("ocr_pages") - F.col("source_pages"))
    delta = F.col("delta_ocr_minus_source")
    status = F.when(~F.col("ocr_consistent"), "ocr_inconsistent").when(F.coalesce(delta != 0, F.lit(False)), "source_mismatch").otherwise("ok")
    given = F.array_join(F.transform(F.filter(F.map_entries("counts"), lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), ", ")
    agreed = F.when(F.col("ocr_consistent"), F.format_string("Every artefact counts %d page(s).", "ocr_pages")).otherwise(F.concat(F.lit("Artefacts count different numbers of pages: "), given, F.lit(".")))
    source = F.when(delta == 0, F.format_string("The source has %d page(s) too.", "source_pages")).otherwise(F.format_string("The source has %d page(s), the recognised document %d (%+d).", "source_pages", "ocr_pages", delta))
    messages = F.filter(F.array(agreed, F.when(delta.isNotNull(), source)), lambda m: m.isNotNull())
    return out.withColumn("status", status).withColumn("messages", messages)


def _picked(rows: DataFrame, value: str, last: bool) -> DataFrame:
    """doc_id, at, value: one value a page number, in the order of `ord` if rows have it, else of the values."""
    order = F.struct(*[c for c in ("ord", value) if c in rows.columns])
    return rows.groupBy("doc_id", F.col("page_no").alias("at")).agg((F.max_by if last else F.min_by)(value, order).alias(value))


def attach_source(pages: DataFrame, images: DataFrame | None, native: DataFrame | None) -> DataFrame:
    """Images and native text of pages, aligned by the constant shift between the first image and the first page; the
    last image of a page number and the first native text count (in the order of a column `ord`, if they have one)."""
    if images is None and native is None:
        return pages
    first_page = pages.groupBy("doc_id").agg(F.min("page_no").alias("p0"))
    base = (images if images is not None else native).groupBy("doc_id").agg(F.min("page_no").alias("i0"))
    shift = first_page.join(base, "doc_id").select("doc_id", (F.col("i0") - F.col("p0")).alias("shift"))
    out = pages.drop("image_path", "native_text").join(shift, "doc_id", "left")
    out = out.withColumn("at", F.col("page_no") + F.coalesce("shift", F.lit(0)))
    for rows, value, last in ((images, "image_path", True), (native, "text", False)):
        name = "native_text" if value == "text" else value
        if rows is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
        else:
            out = out.join(_picked(rows, value, last).withColumnRenamed(value, name), ["doc_id", "at"], "left")
    return out.drop("at", "shift").select(*pages.columns)
