"""From metric results to page and document scores, verdicts, problems and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..constants import HARD_RULES, PRIORITY
from ..functions.text import rounded


def weight_of(key: Column, config: Config) -> Column:
    pairs = [F.lit(x) for kv in config.weights.items() for x in (kv[0], float(kv[1]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0.0)) if pairs else F.lit(0.0)


def page_quality_score(metrics: Column, config: Config) -> Column:
    """Weighted mean of the applicable metrics' scores (equal weights if they have none), one decimal; 100 without any.
    The fold runs in the order of the array, so the sum does not depend on how rows were shuffled."""
    used = F.filter(metrics, lambda m: m["applicable"])
    total = F.aggregate(used, F.lit(0.0), lambda a, m: a + weight_of(m["key"], config))
    weighted = F.aggregate(used, F.lit(0.0), lambda a, m: a + F.when(total > 0, weight_of(m["key"], config) / total).otherwise(F.lit(1.0) / F.size(used)) * m["score"])
    return F.when(F.size(used) == 0, 100.0).otherwise(rounded(weighted, 1))


def hard_keys(metrics: Column) -> Column:
    return F.transform(F.filter(metrics, lambda m: m["hard_fail"] & m["applicable"]), lambda m: m["key"])


def problems(metrics: Column, t_page: float) -> Column:
    """Lines of hard failures, then of bad or low metrics, each in the fixed order of priority."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(PRIORITY) for x in (k, i)])
    limit = min(t_page, 60.0)
    hard = lambda m: m["hard_fail"] & m["applicable"]
    soft = lambda m: m["applicable"] & ~m["hard_fail"] & ((m["status"] == "bad") | (m["score"] < limit))
    named = F.transform(
        F.filter(metrics, lambda m: hard(m) | soft(m)),
        lambda m: F.struct(F.when(hard(m), 0).otherwise(1).alias("group"), F.try_element_at(rank, m["key"]).alias("rank"), F.concat(F.lit("["), m["key"], F.lit("] "), m["justification"]).alias("line")),
    )
    return F.transform(F.array_sort(named), lambda x: x["line"])


def top_problem(lines: Column) -> Column:
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("—"))


def page_reports(metrics: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """doc_id, page_no, metrics, page_score, verdict, hard_keys, problems, image_path, token_count from page metrics."""
    scored = metrics.withColumn("page_score", page_quality_score(F.col("metrics"), config)).withColumn("hard_keys", hard_keys(F.col("metrics")))
    review = (F.col("page_score") < config.t_page) | (F.size("hard_keys") > 0)
    scored = scored.withColumn("verdict", F.when(review, "review").otherwise("ok"))
    lines = F.when(review, problems(F.col("metrics"), config.t_page)).otherwise(F.expr("cast(array() as array<string>)"))
    return scored.withColumn("problems", lines).select("doc_id", "page_no", "metrics", "page_score", "verdict", "hard_keys", "problems", "image_path", "token_count")


def document_reports(reports: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """doc_id, document_score, document_verdict, verdict_reason, faulty_pages, summary from page reports.

    Every aggregate has a partial form but the lists of pages, which hold numbers only.  The weighted mean folds over the
    pages in their order: at decimal ties another order of the same sums can round to another score."""
    weight = F.greatest(F.col("token_count").cast("double"), F.lit(float(config.short_page_token_floor)))
    review, hard = F.col("verdict") == "review", F.size("hard_keys") > 0
    pages_where = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("page_no"))))
    d = reports.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("page_no"), weight.alias("weight"), F.col("page_score").alias("score")))).alias("scored"),
        F.count("*").alias("total"),
        pages_where(review).alias("faulty_pages"),
        pages_where(hard).alias("hard_pages"),
        pages_where(F.array_contains("hard_keys", "IFR")).alias("inference_failed_pages"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("hard_keys")))).alias("hard_rules"),
    )
    sums = F.aggregate(
        F.filter("scored", lambda p: p["score"].isNotNull()), F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("weight")),
        lambda a, p: F.struct((a["score"] + p["weight"] * p["score"]).alias("score"), (a["weight"] + p["weight"]).alias("weight")),
    )
    d = d.withColumn("sums", sums).withColumn("mean", F.col("sums.score") / F.nullif(F.col("sums.weight"), F.lit(0.0)))
    d = d.withColumn("document_score", F.coalesce(rounded(F.col("mean"), 1), F.lit(100.0))).withColumn("faulty", F.size("faulty_pages")).withColumn("ratio", F.col("faulty") / F.col("total"))
    low, many, broken = F.col("document_score") < config.t_doc, F.col("ratio") > config.doc_flag_ratio, F.size("hard_pages") > 0
    names = F.create_map(*[F.lit(x) for kv in HARD_RULES.items() for x in kv])
    named = F.array_join(F.transform("hard_rules", lambda k: F.coalesce(F.try_element_at(names, k), k)), ", ")
    rules = F.filter(
        F.array(
            F.when(low, F.format_string(f"document score %.0f < {config.t_doc:.0f}", "document_score")),
            F.when(many, F.format_string(f"%d/%d pages (%.0f%%) need review > {config.doc_flag_ratio * 100:.0f}%% allowed", "faulty", "total", F.col("ratio") * 100)),
            F.when(broken, F.concat(F.format_string("%d page(s) hit a HARD condition [", F.size("hard_pages")), named, F.lit("]"))),
        ),
        lambda x: x.isNotNull(),
    )
    passed = ~(low | many | broken)
    d = d.withColumn("failed_rules", rules).withColumn("document_verdict", F.when(passed, "PASSED").otherwise("FAILED"))
    good = F.format_string("PASSED: document score %.0f/100; %d/%d pages (%.0f%%) flagged; no HARD conditions.", "document_score", "faulty", "total", F.col("ratio") * 100)
    failed = F.concat(
        F.format_string("FAILED: %d/%d pages (%.0f%%) need review; doc score %.0f/100", "faulty", "total", F.col("ratio") * 100, "document_score"),
        F.when(F.size("inference_failed_pages") > 0, F.format_string("; %d page(s) had inference_failed content", F.size("inference_failed_pages"))).otherwise(""),
        F.lit(". Rule(s): "), F.array_join("failed_rules", "; "), F.lit("."),
    )
    summary = F.struct(
        F.col("total").alias("total_pages"), (F.col("total") - F.col("faulty")).alias("passed_pages"), F.col("faulty").alias("faulty_pages"), rounded(F.col("ratio"), 3).alias("faulty_ratio"),
        F.col("document_score").alias("dqs"), "hard_pages", "hard_rules", "inference_failed_pages",
        F.struct(F.lit(config.t_doc).alias("t_doc"), F.lit(config.t_page).alias("t_page"), F.lit(config.doc_flag_ratio).alias("doc_flag_ratio")).alias("thresholds"), "failed_rules",
    )
    return d.select("doc_id", "document_score", "document_verdict", F.when(passed, good).otherwise(failed).alias("verdict_reason"), "faulty_pages", summary.alias("summary"))
