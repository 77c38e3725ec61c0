"""Views over reports that a reviewer reads: tables of faulty and passed pages, evidence, sections, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import TEXT_KINDS
from .scoring import top_problem


def _applicable(reports: DataFrame) -> Column:
    return F.filter("metrics", lambda m: m["applicable"])


def _label(m: Column) -> Column:
    return F.concat(m["key"], F.lit(" "), F.format_string("%.0f", m["score"]))


def faulty_pages(reports: DataFrame) -> DataFrame:
    """Pages to review, worst first in a document: score, the three worst metrics, the first problem."""
    order = F.array_sort(F.transform(_applicable(reports), lambda m: F.struct((~m["hard_fail"]).alias("soft"), m["score"].alias("s"), m["metric_ord"].alias("o"), _label(m).alias("label"))))
    worst = F.array_join(F.transform(F.slice(order, 1, 3), lambda x: x["label"]), ", ")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("page_score", "page_no"))
    return reports.where("verdict = 'review'").select("doc_id", "page_no", "page_score", rank.alias("rank"), worst.alias("worst_metrics"), top_problem(F.col("problems")).alias("top_problem"))


def passed_pages(reports: DataFrame) -> DataFrame:
    """Pages that passed, with their lowest applicable metric."""
    low = F.array_min(F.transform(_applicable(reports), lambda m: F.struct(m["score"].alias("s"), m["metric_ord"].alias("o"), _label(m).alias("label"))))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("page_score").desc(), "page_no"))
    return reports.where("verdict = 'ok'").select("doc_id", "page_no", "page_score", rank.alias("rank"), low["label"].alias("lowest_metric"))


def locations(reports: DataFrame) -> DataFrame:
    """Every located piece of evidence of applicable metrics."""
    m = reports.select("doc_id", "page_no", F.explode(_applicable(reports)).alias("m"))
    return m.select("doc_id", "page_no", F.col("m.key").alias("key"), F.explode("m.locations").alias("l")).select("doc_id", "page_no", "key", "l.*")


def ordered_metrics(reports: DataFrame) -> DataFrame:
    """Metrics of a page: failing ones (hard first, then lowest), then passing ones (highest first)."""
    m = reports.select("doc_id", "page_no", F.explode(_applicable(reports)).alias("m")).select("doc_id", "page_no", "m.*")
    m = m.withColumn("section", F.when(F.col("hard_fail") | F.col("status").isin("bad", "warn"), "failing").otherwise("passing"))
    fails = F.col("section") == "failing"
    order = W.partitionBy("doc_id", "page_no", "section").orderBy(F.when(fails & ~F.col("hard_fail"), 1).otherwise(0), F.when(fails, F.col("score")).otherwise(-F.col("score")), "metric_ord")
    return m.withColumn("rank", F.row_number().over(order))


def walker(reports: DataFrame) -> DataFrame:
    """Each page with its place k of n and its neighbours."""
    order = W.partitionBy("doc_id").orderBy("page_no")
    return reports.select("doc_id", "page_no", F.row_number().over(order).alias("k"), F.count("*").over(W.partitionBy("doc_id")).alias("n"), F.lag("page_no").over(order).alias("previous"), F.lead("page_no").over(order).alias("following"))


def review_rows(reports: DataFrame) -> DataFrame:
    """Rows of the review table: PQS with one decimal and up to three problems."""
    p = [F.coalesce(F.try_element_at("problems", F.lit(i)), F.lit("")).alias(f"problem_{i}") for i in (1, 2, 3)]
    return reports.where("verdict = 'review'").select("doc_id", "page_no", F.format_string("%.1f", "page_score").alias("PQS"), *p)


def human_call_tally(pages: DataFrame, calls: DataFrame, by: list[str]) -> DataFrame:
    """How many pages have a call other than the default."""
    j = pages.join(calls, ["doc_id", "page_no"], "left")
    decided = F.coalesce("call", F.lit("undecided")) != "undecided"
    return j.groupBy(*by).agg(F.count("*").alias("pages"), F.sum(F.when(decided, 1).otherwise(0)).alias("decided"))


def band(score: Column) -> Column:
    """Colour of a score: 75 and 50, not the 70 and 50 of a status."""
    return F.when(score >= 75, "green").when(score >= 50, "amber").otherwise("red")


def summary(documents: DataFrame) -> DataFrame:
    """Counters of each document."""
    return documents.select("doc_id", "document_verdict", "document_score", band(F.col("document_score")).alias("band"), "summary.total_pages", "summary.passed_pages", "summary.faulty_pages", "summary.failed_rules")


def audit_table(page_audit: DataFrame) -> DataFrame:
    """One row an artefact, the source last: pages or 'not provided'."""
    shown = lambda v: F.coalesce(v.cast("string"), F.lit("not provided"))
    a = page_audit.select("doc_id", F.posexplode("counts").alias("pos", "artefact", "n")).select("doc_id", "pos", "artefact", shown(F.col("n")).alias("pages"))
    s = page_audit.select("doc_id", F.lit(1000).alias("pos"), F.lit("source").alias("artefact"), shown(F.col("source_pages")).alias("pages"))
    return a.unionByName(s)


def scaled_boxes(reports: DataFrame, page_boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Evidence boxes in pixels of the page image: doc_id, page_no, kind, box."""
    j = locations(reports).where(F.size("bbox") == 4).join(page_boxes.select("doc_id", "page_no", "page_bbox"), ["doc_id", "page_no"]).join(images.select("doc_id", "page_no", "width", "height"), ["doc_id", "page_no"])
    sx, sy = F.col("width") / F.col("page_bbox")[2], F.col("height") / F.col("page_bbox")[3]
    return j.select("doc_id", "page_no", "kind", F.transform("bbox", lambda v, i: F.when(i % 2 == 0, v * sx).otherwise(v * sy)).alias("box"))


def highlighted(reports: DataFrame, texts: DataFrame) -> DataFrame:
    """Page text, escaped, with text evidence in <mark>: snippets of two characters or more, once each whatever the case,
    longest first."""
    found = locations(reports).where(F.col("kind").isin(TEXT_KINDS) & (F.length("snippet") >= 2))
    per = found.groupBy("doc_id", "page_no", F.lower("snippet").alias("low")).agg(F.min("snippet").alias("snippet"))
    lists = per.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct((-F.length("snippet")).alias("n"), "snippet"))).alias("found"))
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quote = lambda c: F.concat(F.lit("(?i)(\\Q"), F.replace(esc(c), F.lit("\\E"), F.lit("")), F.lit("\\E)"))
    marked = F.aggregate(F.coalesce("found", F.expr("cast(array() as array<struct<n:int,snippet:string>>)")), esc(F.coalesce("text", F.lit(""))), lambda t, x: F.regexp_replace(t, quote(x["snippet"]), F.lit("<mark>$1</mark>")))
    return texts.join(lists, ["doc_id", "page_no"], "left").select("doc_id", "page_no", marked.alias("html"))
