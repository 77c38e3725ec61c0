"""The fourteen page metrics as one wide projection: features first, then an array of fourteen structs of one type.

Nothing here shuffles; what a metric needs of the document or of other relations has been joined to the page before
(see `features`).  Only gzip ratios, html similarity and table structure run in Python, as Arrow UDFs.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..constants import KEYS, METRICS, SINGLE_LETTERS, STOPWORD_BAND, STOPWORD_SHARE, STOPWORDS
from ..functions import markup as M
from ..functions import text as T
from ..schemas import LOCATION
from ..session import held
from . import context as C
from .pages import is_content, with_text

NAMES = {k: n for k, n, _ in METRICS}
NO_TEXT = "cast(array() as array<string>)"
NO_LOCATIONS = f"cast(array() as array<{LOCATION}>)"
MEASURES = {
    "IFR": "Share of blocks that the recognition engine itself could not read.",
    "BCC": "Agreement of the number of blocks with the recorded one, and with the rest of the document.",
    "BGC": "Sanity of block boxes: sizes, place on the page, overlaps and vertical order.",
    "HMW": "Share of html blocks whose tags balance and whose entities are whole.",
    "TSI": "Structure of tables: header, equal columns, filled cells, sound spans.",
    "LVR": "Share of prose words that are known.",
    "OOV": "Share of unknown words that no one could pronounce.",
    "SFC": "Share of function words against natural prose of the language.",
    "CED": "Letter distribution against the language, and signs of wrong decoding.",
    "PPL": "How surprising the prose is to a character model of its own document.",
    "TTR": "Variety of words against what prose of the length has.",
    "WSA": "Words merged, split, broken by hyphens, or with digits among letters.",
    "PSW": "Balance of brackets and quotes, sentence ends, spacing and sentence length.",
    "XSA": "Repetition, and agreement with markdown, native text, chunks and html.",
}


def fmt(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def texts(*parts: tuple[Column, Column] | Column) -> Column:
    """Array of the given strings, of pairs (condition, string) those that hold."""
    items = [F.when(p[0], p[1]) if isinstance(p, tuple) else p for p in parts]
    return F.filter(F.array(*[i.cast("string") for i in items]), lambda x: x.isNotNull())


def location(kind, confidence, block: Column | None, snippet: Column) -> Column:
    one = lambda v: v if isinstance(v, Column) else F.lit(v)
    block_id = T.nz(block["block_id"]) if block is not None else F.lit("")
    bbox = F.coalesce(block["bbox"], F.expr("cast(array() as array<double>)")) if block is not None else F.expr("cast(array() as array<double>)")
    return F.struct(one(kind).alias("kind"), one(confidence).alias("confidence"), block_id.alias("block_id"), bbox.alias("bbox"), F.substring(T.nz(snippet), 1, 120).alias("snippet")).cast(LOCATION)


def block_with(needle: Column) -> Column:
    """The first block whose text or html holds the needle, whatever the case; null if none."""
    low = F.lower(needle)
    return F.try_element_at(F.filter("blocks", lambda b: F.lower(T.nz(b["text"])).contains(low) | F.lower(T.nz(b["html"])).contains(low)), F.lit(1))


def result(key, raw, score, status, threshold: dict, how, example, evidence, justification, locations=None, low=None, applicable=None, hard=None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    pairs = [x for k, v in threshold.items() for x in (F.lit(k), lit(v).cast("string"))]
    return F.struct(
        F.lit(KEYS.index(key)).alias("metric_ord"), F.lit(key).alias("key"), F.lit(NAMES[key]).alias("name"),
        T.rounded(lit(raw), 4).alias("raw_value"), T.rounded(lit(score), 1).alias("score"), lit(status).alias("status"),
        (F.create_map(*pairs) if pairs else F.expr("map()")).cast("map<string,string>").alias("threshold"),
        F.lit(MEASURES[key]).alias("what_it_measures"), lit(how).alias("how_computed"), lit(example).alias("example"),
        F.slice(evidence, 1, 8).alias("evidence"), F.slice(locations if locations is not None else F.expr(NO_LOCATIONS), 1, 12).alias("locations"),
        lit(justification).alias("justification"), F.when(lit(low) if low is not None else F.lit(False), "low").otherwise("high").alias("reliability"),
        (lit(applicable) if applicable is not None else F.lit(True)).alias("applicable"), F.coalesce(lit(hard) if hard is not None else F.lit(False), F.lit(False)).alias("hard_fail"),
    )


def na(key: str, reason: str) -> Column:
    return result(key, 0.0, 100.0, "na", {}, reason, "", F.expr(NO_TEXT), f"Not applicable: {reason}", applicable=False)


def block_name(b: Column) -> Column:
    return F.coalesce(F.nullif(b["block_id"], F.lit("")), b["block_type"])


def ifr(c: Config) -> Column:
    failed = F.filter("blocks", lambda b: b["inference_failed"])
    content = F.filter("blocks", lambda b: b["inference_failed"] & is_content(b))
    n, k, kc = F.size("blocks"), F.size(failed), F.size(content)
    raw = k / n
    evidence = F.transform(failed, lambda b: F.concat(F.coalesce(F.nullif(b["block_id"], F.lit("")), F.lit("(no id)")), F.lit(" ["), b["block_type"], F.lit("] inference_failed=true")))
    limits = {"any_content_block_failed": "HARD FAIL", "rate_bad_at": 0.2}
    ids = F.array_join(F.transform(content, block_name), ", ")
    hard = result("IFR", raw, 0.0, "bad", limits, "failed blocks / blocks; a failed content block is a hard failure", fmt("%d of %d blocks could not be read, content among them.", k, n), evidence, fmt("%d content block(s) returned inference_failed=true (%s) — the engine could not read page content, so the page MUST be reviewed.", kc, ids), F.transform(failed, lambda b: location("inference_failed", "definite", b, F.substring(F.coalesce(F.nullif(b["text"], F.lit("")), b["block_type"]), 1, 80))), hard=True)
    score = T.lerp_score(raw, 0.0, 0.2)
    soft = result("IFR", raw, score, F.when(score >= 50, "warn").otherwise("bad"), limits, "failed blocks / blocks", fmt("%d of %d blocks, none of content, could not be read.", k, n), evidence, fmt("%d/%d non-content blocks (%.1f%%) had inference_failed=true.", k, n, raw * 100))
    good = result("IFR", 0.0, 100.0, "good", limits, "failed blocks / blocks", fmt("All %d blocks were read.", n), texts(F.lit("no blocks reported inference_failed")), "No block reported inference_failed; engine read the whole page.")
    return F.when(n == 0, na("IFR", "page has no blocks")).when(kc > 0, hard).when(k > 0, soft).otherwise(good)


def bcc(c: Config) -> Column:
    tol = c.bcc_tolerance
    n, meta, median = C.block_count(F.col("blocks"), F.col("num_blocks_json")), F.col("num_blocks_meta"), F.col("median_blocks")
    limits = {"tolerance": tol, "low_vs_median_factor": 0.5}
    raw = F.abs(n - meta) / F.greatest(meta, F.lit(1))
    score, hard = T.lerp_score(raw, 0.0, max(tol * 2.5, 0.5)), raw > tol
    side = F.when(n < meta, "fewer").otherwise("more")
    limit = f"{tol * 100:.0f}%%"
    just = F.when(hard, fmt(f"output.json has %d blocks but metadata expects %d (%.1f%% mismatch, %s than recorded) — exceeds the ±{limit} tolerance; possible dropped/extra content.", n, meta, raw * 100, side)).otherwise(fmt(f"json=%d vs metadata=%d (%.1f%% within ±{limit} tolerance).", n, meta, raw * 100))
    counted = result("BCC", raw, score, F.when(hard, "bad").when(score < 70, "warn").otherwise("good"), limits, "|blocks - recorded| / recorded; a hard failure above the tolerance", fmt("%d blocks found, %d recorded.", n, meta), texts(fmt("json=%d blocks vs metadata=%d blocks", n, meta), (F.coalesce(median, F.lit(0)) != 0, fmt("document median = %.0f blocks", median))), just, hard=hard)
    ratio = n / median
    few = ratio < 0.5
    by_median = result("BCC", F.greatest(F.lit(0.0), 1 - ratio), F.when(few, 40.0).otherwise(100.0), F.when(few, "warn").otherwise("good"), limits, "no recorded count; compared with the document's median", "", texts(fmt("json=%d blocks vs document median %.0f (ratio %.2f)", n, median, ratio)), F.concat(fmt("No metadata count; page has %d blocks vs median %.0f", n, median), F.when(few, " — abnormally low (possible content drop).").otherwise(".")))
    base = F.when(meta.isNotNull(), counted).when(F.coalesce(median, F.lit(0.0)) != 0, by_median).otherwise(na("BCC", "no metadata num_blocks and no document median available"))
    lost = F.col("chunk_meta")["chunks_present"] & ~F.coalesce(F.col("chunk_meta")["covered"], F.lit(False))
    changed = lambda b: {
        "applicable": F.lit(True),
        "score": F.least(b["score"], F.lit(55.0)),
        "status": F.when(b["status"].isin("good", "na"), "warn").otherwise(b["status"]),
        "evidence": F.concat(b["evidence"], texts(F.lit("page not covered by any output_chunks entry — possible chunk/content drop"))),
        "justification": F.concat(b["justification"], F.lit(" Also: page is absent from output_chunks (possible content drop).")),
    }
    order = "metric_ord key name raw_value score status threshold what_it_measures how_computed example evidence locations justification reliability applicable hard_fail".split()
    return T.let(base, lambda b: F.when(F.coalesce(lost, F.lit(False)), F.struct(*[changed(b).get(f, b[f]).alias(f) for f in order])).otherwise(b))


def bgc(c: Config) -> Column:
    boxed = F.filter("blocks", lambda b: F.size(b["bbox"]) == 4)
    n = F.size(boxed)
    given = F.size(F.col("page_bbox")) == 4
    width = F.when(given, F.col("page_bbox")[2]).otherwise(F.array_max(F.transform(boxed, lambda b: b["bbox"][2])))
    height = F.when(given, F.col("page_bbox")[3]).otherwise(F.array_max(F.transform(boxed, lambda b: b["bbox"][3])))
    sound = F.filter(boxed, lambda b: ~M.degenerate(b["bbox"]))
    content = F.filter(sound, is_content)
    share = lambda a, b: M.overlap_area(a["bbox"], b["bbox"]) / F.least(M.area(a["bbox"]), M.area(b["bbox"]))
    pairs = T.let(content, lambda content: F.flatten(F.transform(content, lambda a, i: F.transform(F.filter(F.slice(content, i + 2, F.greatest(F.size(content) - i - 1, F.lit(0))), lambda b: share(a, b) > 0.5), lambda b: F.struct(a["block_id"].alias("a"), b["block_id"].alias("b"), block_name(a).alias("an"), block_name(b).alias("bn"), share(a, b).alias("share"))))))
    bad_box = T.let(F.struct(width.alias("w"), height.alias("h")), lambda s: F.filter(boxed, lambda b: M.degenerate(b["bbox"]) | M.outside(b["bbox"], s["w"], s["h"])))
    ids = F.array_distinct(F.concat(F.transform(bad_box, lambda b: b["block_id"]), F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))))
    tops = F.transform(sound, lambda b: b["bbox"][1])
    jumps = T.let(F.struct(tops.alias("y"), height.alias("h")), lambda s: F.size(F.filter(F.transform(s["y"], lambda y, i: F.when(i > 0, y < F.try_element_at(s["y"], i) - s["h"] * 0.25).otherwise(False)), lambda x: x)))
    bad = F.size(ids) + jumps
    raw = F.least(F.lit(1.0), bad / n)
    box = lambda b: F.to_json(b["bbox"])
    found = F.concat(
        F.transform(bad_box, lambda b: F.when(M.degenerate(b["bbox"]), F.concat(block_name(b), F.lit(": degenerate box "), box(b))).otherwise(F.concat(block_name(b), F.lit(": box "), box(b), fmt(" outside page (0..%.0f x 0..%.0f)", width, height)))),
        F.transform(pairs, lambda p: F.concat(p["an"], F.lit(" & "), p["bn"], fmt(" overlap %.0f%%", p["share"] * 100))),
        texts((jumps > 0, fmt("%d reading-order inversion(s) vs vertical position", jumps))),
    )
    evidence = F.when(F.size(found) > 0, found).otherwise(texts(fmt("all %d boxes have valid geometry within the page", n)))
    score = T.lerp_score(raw, 0.0, 0.4)
    just = F.when(bad > 0, fmt("%d/%d blocks have geometry problems (%.1f%%).", bad, n, raw * 100)).otherwise(fmt("All %d blocks have coherent geometry.", n))
    where = F.transform(T.let(ids, lambda ids: F.filter(boxed, lambda b: F.array_contains(ids, b["block_id"]))), lambda b: location("bad_geometry", "definite", b, F.substring(F.coalesce(F.nullif(b["text"], F.lit("")), b["block_type"]), 1, 60)))
    full = result("BGC", raw, score, T.status_of(score), {"bad_rate_zero_at": 0.0, "bad_rate_bad_at": 0.4}, "(degenerate + outside + overlapping + out of order) / boxes", fmt("%d of %d boxes are broken; first: %s", bad, n, evidence[0]), evidence, just, where)
    return F.when(n == 0, na("BGC", "no block bboxes on this page")).otherwise(full)


def hmw(c: Config) -> Column:
    html = F.filter("blocks", lambda b: T.nz(b["html"]).contains("<"))
    n = F.size(html)
    judged = F.col("judged")
    k = F.size(judged)
    raw = k / n
    cut = lambda x: F.replace(F.substring(T.strip(x["b"]["html"]), 1, 60), F.lit("\n"), F.lit(" "))
    found = F.transform(judged, lambda x: F.concat(block_name(x["b"]), F.lit(": "), x["why"], F.lit(" — '"), cut(x), F.lit("…'")))
    evidence = F.when(k > 0, found).otherwise(texts(fmt("all %d HTML blocks are well-formed", n)))
    score = T.lerp_score(raw, 0.0, 0.3)
    just = F.when(k > 0, fmt("%d/%d blocks have malformed markup (%.1f%%).", k, n, raw * 100)).otherwise(fmt("All %d HTML blocks are well-formed.", n))
    where = F.transform(judged, lambda x: location("malformed_html", "definite", x["b"], F.concat(x["why"], F.lit(": "), cut(x))))
    full = result("HMW", raw, score, T.status_of(score), {"malformed_rate_zero_at": 0.0, "bad_at": 0.3}, "malformed blocks / html blocks", fmt("%d of %d html blocks are malformed; first: %s", k, n, evidence[0]), evidence, just, where)
    return F.when(n == 0, na("HMW", "no HTML blocks on this page")).otherwise(full)


def tsi(c: Config) -> Column:
    blocks = F.filter("blocks", lambda b: b["is_table"])
    n, info = F.size(blocks), F.col("tables")
    meta = F.col("chunk_meta")
    single = F.coalesce(meta["covered"] & meta["single_page"], F.lit(False))
    says, told = single & F.coalesce(meta["has_table"], F.lit(False)), F.when(single, F.coalesce(meta["table_count"], F.lit(0))).otherwise(0)
    both = F.arrays_zip(blocks.alias("b"), info.alias("t"))
    name = lambda x: F.coalesce(F.nullif(x["b"]["block_id"], F.lit("")), F.lit("table"))
    empty = lambda t: t["empty"] / F.greatest(t["n_cells"], F.lit(1))
    row_list = lambda t: F.concat(F.lit("["), F.array_join(t["ragged_rows"].cast("array<string>"), ", "), F.lit("]"))
    lines = lambda x: F.when(
        ~x["t"]["valid"], texts(F.concat(name(x), F.lit(": could not parse <table>")))
    ).otherwise(
        texts(
            (~x["t"]["has_header"], F.concat(name(x), F.lit(": no header row (thead/th)"))),
            (F.size(x["t"]["ragged_rows"]) > 0, F.concat(name(x), F.lit(": ragged rows "), row_list(x["t"]), fmt(" (expected %d cols)", x["t"]["col_mode"]))),
            (empty(x["t"]) > 0.2, F.concat(name(x), fmt(": %.0f%% empty cells", empty(x["t"]) * 100))),
            (x["t"]["stray"] > 0, F.concat(name(x), fmt(": %d stray colspan(s)", x["t"]["stray"]))),
        )
    )
    bits = lambda t: F.array_join(texts((~t["has_header"], F.lit("no header")), (F.size(t["ragged_rows"]) > 0, fmt("%d ragged row(s) vs %d cols", F.size(t["ragged_rows"]), t["col_mode"])), (empty(t) > 0.2, fmt("%.0f%% empty cells", empty(t) * 100))), "; ")
    mean = F.aggregate(info, F.lit(0.0), lambda a, t: a + M.table_defect(t)) / n
    differs = says & (told != n)
    raw = F.when(differs, F.least(F.lit(1.0), mean + 0.25)).otherwise(mean)
    score = T.rounded((1 - raw) * 100, 1)
    found = F.concat(F.flatten(F.transform(both, lines)), texts((differs, fmt("output_chunks reports table_count=%d but %d table(s) parsed — count mismatch", told, n))))
    evidence = F.when(F.size(found) > 0, found).otherwise(texts(fmt("%d table(s) well-structured", n)))
    wrong = F.filter(both, lambda x: M.table_defect(x["t"]) > 0)
    where = F.transform(wrong, lambda x: F.when(x["t"]["valid"], location("table_defect", "definite", x["b"], F.coalesce(F.nullif(bits(x["t"]), F.lit("")), F.lit("table defect")))).otherwise(location("table_unparseable", "definite", x["b"], F.lit("could not parse <table>"))))
    just = F.concat(fmt("Table defect rate %.1f%% across %d table(s).", raw * 100, n), F.when(differs, fmt(" Chunk reports %d table(s) vs %d parsed.", told, n)).otherwise(""))
    full = result("TSI", raw, score, T.status_of(score), {"defect_rate_good_at": 0.0, "bad_at": 1.0}, "mean over tables of ragged rows + half of empty cells + missing header + stray spans", fmt("Defects of %d table(s): %.0f%%; first: %s", n, raw * 100, evidence[0]), evidence, just, where)
    gone = result("TSI", 1.0, 20.0, "bad", {"chunk_table_count": told}, "chunks report a table, none was parsed", fmt("Chunks report %d table(s), none was parsed.", told), texts(fmt("output_chunks reports table_count=%d (has_table=true) but 0 tables parsed — possible dropped table", told)), fmt("Chunk metadata reports %d table(s) on this page, but none were parsed — likely a dropped table.", told), F.array(location("dropped_table", "definite", None, fmt("chunk reports %d table(s), 0 parsed", told))))
    return F.when(n > 0, full).when(says & (told >= 1), gone).otherwise(na("TSI", "page has no tables"))


def quoted(items: Column, k: int, sep: str = ", ", count: str = " ×") -> Column:
    shown = lambda x: F.concat(F.lit("'"), x["token"], F.lit("'"), F.lit(count), x["n"].cast("string"))
    return F.array_join(F.transform(F.slice(items, 1, k), shown), sep)


def lvr(c: Config) -> Column:
    n, k, bad = F.col("n_countable"), F.col("n_bad"), F.col("bad")
    ratio = (n - k) / n
    score, hard = T.rounded(T.lexical_score(ratio), 1), ratio < c.lexical_warn
    top = F.slice(bad, 1, 8)
    evidence = F.when(k > 0, F.transform(top, lambda x: F.concat(F.lit("'"), x["token"], F.lit("' ×"), x["n"].cast("string")))).otherwise(texts(F.lit("no invalid tokens detected")))
    where = F.transform(top, lambda x: location(F.when(x["gibberish"], "gibberish_word").otherwise("rare_word"), F.when(x["gibberish"], "definite").otherwise("statistical"), block_with(x["token"]), x["token"]))
    just = fmt(f"Lexical validity %.0f%% (threshold {c.lexical_good * 100:.0f}%%; hard-fail below {c.lexical_warn * 100:.0f}%%); %d/%d prose words are not recognised.", ratio * 100, k, n)
    full = result("LVR", ratio, score, T.status_of(score), {"good": c.lexical_good, "warn_hard_below": c.lexical_warn, "zero": c.lexical_zero}, "known words / countable words", fmt("%d of %d words are known%s.", n - k, n, F.when(k > 0, F.concat(F.lit("; unknown: "), quoted(bad, 3))).otherwise("")), evidence, just, where, F.col("low"), hard=hard)
    return F.when(F.coalesce(n, F.lit(0)) == 0, na("LVR", "no prose tokens on this page")).otherwise(full)


def oov(c: Config) -> Column:
    k, g, bad = F.coalesce("n_bad", F.lit(0)), F.coalesce("n_gibberish", F.lit(0)), F.col("bad")
    limits = {"gibberish_rate_good_at": 0.0, "bad_at": 0.5}
    raw = g / k
    score = T.lerp_score(raw, 0.0, 0.5)
    gib, fine = F.filter(bad, lambda x: x["gibberish"]), F.filter(bad, lambda x: ~x["gibberish"])
    evidence = texts((g > 0, F.concat(F.lit("gibberish: "), quoted(gib, 5, count="×"))), (k > g, F.concat(F.lit("plausible: "), quoted(fine, 5, count="×"))))
    full = result("OOV", raw, score, T.status_of(score), limits, "unpronounceable unknown words / unknown words", fmt("%d unknown words, %d of them unpronounceable.", k, g), evidence, fmt("%d/%d OOV words are unpronounceable gibberish (%.0f%%); %d look like plausible rare/brand words.", g, k, raw * 100, k - g), low=F.col("low"))
    none = result("OOV", 0.0, 100.0, "good", limits, "unpronounceable unknown words / unknown words", "Every word is known.", texts(F.lit("no out-of-vocabulary words")), "No out-of-vocabulary words to classify.", low=F.col("low"))
    return F.when(k == 0, none).otherwise(full)


def stopword_language(lang: Column) -> Column:
    two = F.substring(F.coalesce(lang, F.lit("en")), 1, 2)
    return F.when(two.isin(*STOPWORDS), two).otherwise("en")


def stopword_count(words: Column, lang: Column) -> Column:
    of = lambda k: F.size(F.filter(words, lambda w: F.lower(w).isin(STOPWORDS[k])))
    return F.when(lang == "de", of("de")).otherwise(of("en"))


def sfc(c: Config) -> Column:
    lang, n = stopword_language(F.col("language")), F.col("n_words")
    seen = F.col("stop_n") / n
    expected = F.when(lang == "de", STOPWORD_SHARE["de"]).otherwise(STOPWORD_SHARE["en"])
    raw = F.abs(seen - expected)
    score = T.lerp_score(raw, 0.0, STOPWORD_BAND)
    just = F.concat(fmt("Stopword share %.1f%% deviates %.1f%% from the expected %.0f%% for %s ", seen * 100, raw * 100, expected * 100, lang), F.lit(f"(band ±{STOPWORD_BAND * 100:.0f}%)."))
    full = result("SFC", T.rounded(raw, 6), score, T.status_of(score), {"expected": expected, "band": STOPWORD_BAND, "lang": lang}, "|share of function words - expected share|", fmt("%.0f%% of %d words are function words; about %.0f%% are expected.", seen * 100, n, expected * 100), texts(fmt("observed %.1f%% vs expected %.0f%% (%s); deviation %.1f%%", seen * 100, expected * 100, lang, raw * 100)), just, low=F.col("low"))
    return F.when(n == 0, na("SFC", "no prose tokens on this page")).otherwise(full)


def ced(c: Config) -> Column:
    kl, hits = F.col("kl"), F.col("mojibake")
    k = F.size(hits)
    hard = k >= c.ced_mojibake_bad
    base = T.lerp_score(kl, c.ced_kl_good, c.ced_kl_bad)
    score = F.when(k > 0, F.least(base, F.greatest(F.lit(0.0), 60.0 - k * 15.0))).otherwise(base)
    score = F.when(hard, F.least(score, F.lit(15.0))).otherwise(score)
    distinct, odd = F.array_distinct(hits), F.col("odd")
    show = lambda n: F.array_join(F.transform(F.slice(distinct, 1, n), lambda h: F.concat(F.lit("'"), h, F.lit("'"))), " ")
    evidence = texts((k > 0, F.concat(F.lit("mojibake: "), show(6))), (F.size(odd) > 0, F.concat(F.lit("over-represented odd chars: "), F.array_join(F.slice(odd, 1, 8), " "))), fmt("entropy=%.2f bits/char, KL=%.3f", F.col("entropy"), kl))
    where = F.transform(F.slice(distinct, 1, 8), lambda h: location("mojibake", "definite", block_with(h), h))
    just = F.concat(fmt(f"KL divergence %.3f (good ≤{c.ced_kl_good}, bad ≥{c.ced_kl_bad}); %d mojibake/encoding hit(s)", kl, k), F.when(hard, f" ≥ hard threshold {c.ced_mojibake_bad} — encoding corruption.").otherwise("."))
    full = result("CED", kl, score, T.status_of(score), {"kl_good": c.ced_kl_good, "kl_bad": c.ced_kl_bad, "mojibake_hard_at": c.ced_mojibake_bad}, "divergence of letters from the language, and a count of decoding artefacts", F.when(k > 0, fmt("%d decoding artefact(s), such as %s.", k, show(3))).otherwise(fmt("No decoding artefact; divergence %.2f.", kl)), evidence, just, where, F.col("low"), hard=hard)
    return F.when(F.col("no_prose"), na("CED", "no prose text on this page")).otherwise(full)


def ppl(c: Config) -> Column:
    raw, good, bad = F.coalesce("surprisal", F.lit(0.0)), F.coalesce("ppl_good", F.lit(0.0)), F.coalesce("ppl_bad", F.lit(1.0))
    score = T.lerp_score(raw, good, bad)
    worst = F.col("worst")
    lines = F.transform(worst, lambda s: F.concat(fmt("[%.2f bits] ", s["bits"]), F.substring(s["sentence"], 1, 80)))
    evidence = F.when(F.size(worst) > 0, lines).otherwise(texts(fmt("page surprisal %.2f bits/char", raw)))
    note = "" if c.perplexity_backend == "ngram" else f" (requested '{c.perplexity_backend}' backend unavailable; used ngram fallback)"
    low = F.lit(True) if c.perplexity_backend == "ngram" else F.col("low")
    just = fmt("Page surprisal %.2f bits/char vs document calibration (fluent ≤%.2f, degraded ≥%.2f).", raw, good, bad)
    full = result("PPL", raw, score, T.status_of(score), {"good_bound": F.round(good, 3), "bad_bound": F.round(bad, 3), "backend": c.perplexity_backend}, "mean surprisal of character trigrams against the document's pages" + note, fmt("%.2f bits a character; fluent pages of this document have %.2f.", raw, good), evidence, just, low=low)
    return F.when(F.col("no_prose"), na("PPL", "no prose text on this page")).otherwise(full)


def ttr_parts(words: Column) -> dict[str, Column]:
    counted = T.let(F.array_distinct(F.transform(words, F.lower)), lambda t: F.struct(F.size(t).alias("types"), F.size(F.filter(t, lambda x: ~T.is_pronounceable(x))).alias("junk")))
    n, k = F.size(words), counted["types"]
    ratio, junk = k / n, counted["junk"] / k
    low, high = T.expected_band(n)
    dist = F.when(ratio < low, low - ratio).when(ratio > high, ratio - high + F.when(junk > 0.3, 0.1).otherwise(0.0)).otherwise(0.0)
    return {"n": n, "types": k, "ratio": ratio, "low": low, "high": high, "junk": junk, "score": F.greatest(F.lit(0.0), 100.0 - (dist / 0.30) * 100.0)}


def ttr(c: Config) -> Column:
    p = F.col("diversity")
    n, ratio, low, high = p["n"], p["ratio"], p["low"], p["high"]
    score = T.rounded(T.rounded(p["score"], 6), 1)  # the status is that of the score as shown
    tail = F.when(ratio < low, "low (looping/repetition)").when(ratio > high, "high (possible fragmentation)").otherwise("in-band")
    note = F.when(ratio > high, fmt("; %.0f%% of unique types are unpronounceable", p["junk"] * 100)).otherwise("")
    evidence = texts(F.concat(fmt("TTR=%.2f over %d tokens; expected %.2f–%.2f; tail=%s", ratio, n, low, high, tail), note))
    full = result("TTR", T.rounded(ratio, 6), score, T.status_of(score), {"expected_low": F.round(low, 2), "expected_high": F.round(high, 2)}, "distinct words / words, against the band of the length", fmt("%d distinct words of %d.", p["types"], n), evidence, fmt("Type-token ratio %.2f (%s); expected band %.2f–%.2f for %d tokens.", ratio, tail, low, high, n), low=F.col("low"))
    return F.when(n < 10, na("TTR", "too few prose tokens for diversity (<10)")).otherwise(full)


def word_shapes(tokens: Column, longest: int) -> dict[str, Column]:
    """Cores of tokens that are merged, split off, broken by a hyphen, or mixed with digits."""
    cores = F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, "^[.,;:!?()\\[\\]\"'“”·]+|[.,;:!?()\\[\\]\"'“”·]+$", "")), lambda t: t != "")
    return {
        "merged": F.filter(cores, lambda t: (F.length(t) > longest) & t.rlike(r"\p{L}")),
        "single": F.filter(cores, lambda t: (F.length(t) == 1) & t.rlike(r"\p{L}") & ~F.lit(SINGLE_LETTERS).contains(t)),
        "hyphen": F.filter(cores, lambda t: t.endswith("-") & (F.length(t) > 1)),
        "alnum": F.filter(cores, T.is_alnum_confusion),
    }


def wsa(c: Config) -> Column:
    n = F.col("n_raw")
    s = {k: F.col("shapes")[k] for k in ("merged", "single", "hyphen", "alnum")}
    bad = F.size(s["merged"]) + F.size(s["single"]) + F.size(s["hyphen"]) + F.size(s["alnum"])
    raw = bad / n
    score = T.lerp_score(raw, c.wsa_good, c.wsa_bad)
    some = lambda k: F.size(s[k]) > 0
    first = lambda k: F.try_element_at(s[k], F.lit(1))
    listed = lambda k, m: F.array_join(F.slice(s[k], 1, m), ", ")
    found = texts((some("merged"), F.concat(F.lit(f"merged (>{c.l_max_token}c): '"), F.substring(first("merged"), 1, 40), F.lit("…'"))), (some("single"), F.concat(F.lit("over-segmented singles: "), listed("single", 6))), (some("hyphen"), F.concat(F.lit("mid-word hyphen break: '"), first("hyphen"), F.lit("'"))), (some("alnum"), F.concat(F.lit("alnum confusion (l↔1,O↔0): "), listed("alnum", 5))))
    evidence = F.when(bad > 0, found).otherwise(texts(fmt("no word-shape anomalies in %d tokens", n)))
    at = lambda kind, sure, k, m: F.transform(F.slice(s[k], 1, m), lambda t: location(kind, sure, block_with(t), t))
    where = F.concat(at("merged_word", "definite", "merged", 3), at("alnum_confusion", "definite", "alnum", 3), at("hyphen_break", "statistical", "hyphen", 2))
    just = fmt(f"Word-shape anomaly rate %.1f%% (good ≤{c.wsa_good * 100:.0f}%%, bad ≥{c.wsa_bad * 100:.0f}%%); %d/%d tokens affected.", raw * 100, bad, n)
    full = result("WSA", raw, score, T.status_of(score), {"good": c.wsa_good, "bad": c.wsa_bad, "l_max": c.l_max_token}, "(merged + single letters + hyphen breaks + digits in words) / tokens", fmt("%d of %d tokens are oddly shaped.", bad, n), evidence, just, where, F.col("low"))
    return F.when(n == 0, na("WSA", "no prose tokens on this page")).otherwise(full)


def punctuation_parts(text: Column, words: Column) -> dict[str, Column]:
    sents = T.sentences(text)
    n = F.size(sents)
    ended = F.size(F.filter(sents, lambda s: s.rlike(r"[.!?]$"))) / n
    long = F.size(F.filter(sents, lambda s: F.size(T.word_tokens(s)) > 60))
    gaps, before = F.regexp_count(text, F.lit(" {3,}")), F.regexp_count(text, F.lit(rf"{T.SPACE}+[,.;:!?]"))
    unmatched = T.bracket_defects(text)
    rate = (unmatched + long + gaps * 0.5 + before * 0.25) / (F.greatest(F.lit(1), F.size(words)) / 100.0)
    open_ended = F.coalesce((ended < 0.5) & (n >= 2), F.lit(False))
    return {"unmatched": unmatched, "long": long, "gaps": gaps, "before": before, "ended": F.coalesce(ended, F.lit(0.0)), "open": open_ended, "raw": rate + F.when(open_ended, 1.0).otherwise(0.0)}


def psw(c: Config) -> Column:
    p = F.col("punct")
    raw, score = p["raw"], T.lerp_score(p["raw"], 0.5, 6.0)
    found = texts((p["unmatched"] > 0, fmt("%d unmatched bracket/quote(s)", p["unmatched"])), (p["long"] > 0, fmt("%d implausibly long sentence(s)", p["long"])), (p["gaps"] > 0, fmt("%d abnormal multi-space gap(s)", p["gaps"])), (p["open"], fmt("only %.0f%% of sentences end with . ! ?", p["ended"] * 100)))
    evidence = F.when(F.size(found) > 0, found).otherwise(texts(F.lit("punctuation well-formed")))
    just = fmt("%d unmatched bracket/quote(s) and %.1f punctuation defects per 100 words (good ≤0.5, bad ≥6).", p["unmatched"], raw)
    full = result("PSW", raw, score, T.status_of(score), {"defects_per_100w_good": 0.5, "bad": 6.0}, "(unmatched + long sentences + odd spaces) / 100 words, and sentence ends", fmt("About %.1f defects in 100 words.", raw), evidence, just, low=F.col("low"))
    return F.when(F.col("no_prose"), na("PSW", "no prose text on this page")).otherwise(full)


def xsa(c: Config) -> Column:
    rep, ratio, count, gram = F.col("trigram_rep"), F.col("gzip_ratio"), F.coalesce("top_count", F.lit(0)), T.nz(F.col("top_ngram"))
    md, cer, wer, chunk, html = (F.col(x) for x in ("md_recall", "cer", "wer", "chunk_recall", "html_similarity"))
    loop, far = count > c.xsa_repeat_max, F.coalesce(cer > c.xsa_cer_bad, F.lit(False))
    hard = loop | far
    low_rep = F.least(T.lerp_score(rep, 0.1, 0.6), T.lerp_score(ratio, 3.0, 8.0), F.when(count > 1, T.lerp_score(count, 1.0, c.xsa_repeat_max + 3.0)))
    recall_score = lambda r: F.when(r.isNotNull(), T.lerp_score(1 - r, 0.15, 0.60))
    subs = [F.when(loop, 0.0).otherwise(low_rep), recall_score(md), F.when(cer.isNotNull(), T.lerp_score(cer, 0.02, c.xsa_cer_bad * 2)), recall_score(chunk), F.when(html.isNotNull(), T.lerp_score(1 - html, 0.1, 0.7))]
    score = F.array_min(F.array(*subs))
    used = texts(F.lit("repetition"), (md.isNotNull(), F.lit("JSON↔MD")), (cer.isNotNull(), F.lit("native-CER")), (chunk.isNotNull(), F.lit("JSON↔chunk")), (html.isNotNull(), F.lit("JSON↔HTML")))
    warn = f"{c.xsa_md_sim_warn * 100:.0f}%%"
    said = lambda v, name, why: F.when(v < c.xsa_md_sim_warn, fmt(f"{name} %.0f%% (< {warn}) — {why}", v * 100)).when(v.isNotNull(), fmt(f"{name} %.0f%%", v * 100))
    evidence = texts(
        F.when(loop, fmt(f"repeated span '%s' ×%d (>{c.xsa_repeat_max}) — likely VLM loop", gram, count)).when(count > 1, fmt(f"top {c.xsa_repeat_ngram}-gram '%s' ×%d", gram, count)),
        fmt("trigram repetition %.0f%%, gzip ratio %.1f", rep * 100, ratio),
        said(md, "JSON↔MD word coverage", "content missing from MD"),
        F.when(far, fmt(f"CER %.1f%% (> {c.xsa_cer_bad * 100:.0f}%%) vs native text, WER %.1f%%", cer * 100, wer * 100)).when(cer.isNotNull(), fmt("CER %.1f%%, WER %.1f%% vs native text", cer * 100, wer * 100)),
        said(chunk, "JSON↔chunk coverage", "page content disagrees with output_chunks"),
        said(html, "JSON↔HTML similarity", "JSON and HTML disagree"),
    )
    where = F.when((count > 1) & (gram != ""), F.array(location("repetition", F.when(loop, "definite").otherwise("statistical"), block_with(gram), gram))).otherwise(F.expr(NO_LOCATIONS))
    just = F.concat(fmt("Worst-of agreement score %.0f/100 across %d sub-part(s) (%s)", score, F.size(used), F.array_join(used, ", ")), F.when(hard, " — HARD repetition/native flag.").otherwise("."))
    example = F.when(loop, fmt("'%s' occurs %d times.", gram, count)).when(far, fmt("%.0f%% of characters differ from the native text.", cer * 100)).when(chunk < c.xsa_md_sim_warn, fmt("%.0f%% of the words are in the chunk.", chunk * 100)).when(md < c.xsa_md_sim_warn, fmt("%.0f%% of the words are in the markdown.", md * 100)).otherwise(fmt("The most frequent run occurs %d time(s); the sources agree.", count))
    return result("XSA", rep, score, T.status_of(score), {"repeat_hard_ngram": c.xsa_repeat_ngram, "repeat_hard_max": c.xsa_repeat_max, "md_sim_warn": c.xsa_md_sim_warn, "cer_bad": c.xsa_cer_bad}, F.concat(F.lit("worst of: "), F.array_join(used, " + ")), example, evidence, just, where, F.col("low"), hard=hard)


#: One expression a metric, over the columns of `features`.  Further metrics are added here and to constants.METRICS.
REGISTRY = {"IFR": ifr, "BCC": bcc, "BGC": bgc, "HMW": hmw, "TSI": tsi, "LVR": lvr, "OOV": oov, "SFC": sfc, "CED": ced, "PPL": ppl, "TTR": ttr, "WSA": wsa, "PSW": psw, "XSA": xsa}
assert list(REGISTRY) == KEYS


#: Columns that features are made of and metrics do not read.
SOURCES = ["text", "prose", "body", "md_text", "html_text", "html_plain", "native_text", "chunk_text"]


def features(pages: DataFrame, config: Config, lexicon: DataFrame | None = None) -> DataFrame:
    """pages with everything that metrics read: texts and tokens, language, document medians and fluency bounds, unknown
    words, repeated runs, and agreement with other sources.  Pages with their texts are written once; each relation that is
    joined to them reads its own columns of that, and all meet in small rows first, so texts are shuffled once."""
    p = held(C.page_languages(with_text(pages)), "pages")
    lexicon = lexicon if lexicon is not None else C.default_lexicon(p)
    fluency, bounds = C.page_fluency(p)
    small = p.select(*C.PAGE).distinct().join(C.median_blocks(p), "doc_id", "left").join(bounds, "doc_id", "left")
    small = small.join(C.invalid_tokens(p, lexicon), C.PAGE, "left").join(fluency, C.PAGE, "left")
    p = p.join(held(small, "page-features"), C.PAGE, "left")
    first, then = _once("features", config, _feature_columns)
    return p.withColumns(first).withColumns(then).withColumns({"n_words": F.size("words"), "n_raw": F.size("raw_words"), "top_ngram": F.col("top.top_ngram"), "top_count": F.col("top.top_count")}).drop("words", "raw_words", "top")


#: Expressions by what they are, session and configuration: building thousands of them takes longer than a small run.
_built: dict[tuple, object] = {}


def _once(what: str, config: Config, build):
    key = (what, id(SparkContext._active_spark_context), repr(config))
    if key not in _built:
        _built[key] = build(config)
    return _built[key]


def _feature_columns(config: Config) -> tuple[dict[str, Column], dict[str, Column]]:
    """What a page's own columns give, in two steps."""
    body = F.when(F.col("prose") != "", F.col("prose")).otherwise(F.col("text"))
    first = {"words": T.word_tokens(F.col("prose")), "raw_words": T.raw_tokens(F.col("prose")), "no_prose": T.is_blank(F.col("prose")), "body": body, "html_plain": T.normalize(T.strip_html(F.col("html_text")))}
    shapes = word_shapes(F.col("raw_words"), config.l_max_token)
    punct = punctuation_parts(F.col("prose"), F.col("words"))
    then = {
        "low": (F.size("words") < config.short_page_token_floor) | (T.nz(F.col("language")) == ""),
        "kl": T.rounded(T.kl_divergence(F.col("prose"), F.col("language")), 6),
        "entropy": T.shannon_entropy(F.col("prose")),
        "odd": T.odd_letters(F.col("prose"), F.col("language")),
        "stop_n": stopword_count(F.col("words"), stopword_language(F.col("language"))),
        "diversity": F.struct(*[v.alias(k) for k, v in ttr_parts(F.col("words")).items()]),
        "judged": F.filter(F.transform(F.filter("blocks", lambda b: T.nz(b["html"]).contains("<")), lambda b: F.struct(b.alias("b"), M.malformed(b["html"]).alias("why"))), lambda x: x["why"].isNotNull()),
        "mojibake": T.mojibake_hits(F.col("prose")),
        "shapes": F.struct(*[v.alias(k) for k, v in shapes.items()]),
        "punct": F.struct(*[v.alias(k) for k, v in punct.items()]),
        "tables": M.analyze_tables(F.transform(F.filter("blocks", lambda b: b["is_table"]), lambda b: T.nz(b["html"]))),
        "top": C.top_ngram(F.col("body"), config.xsa_repeat_ngram),
        "trigram_rep": T.trigram_repetition(F.col("body")),
        "gzip_ratio": M.gzip_ratio(F.col("body")),
        "md_recall": T.text_recall(F.col("text"), F.col("md_text")),
        "chunk_recall": T.text_recall(F.col("body"), F.col("chunk_text")),
        "cer": T.character_error_rate(F.col("native_text"), F.col("body")),
        "wer": T.word_error_rate(F.col("native_text"), F.col("body")),
        "html_similarity": M.sequence_similarity(T.normalize(F.col("text")), F.when(~T.is_blank(F.col("html_text")), F.col("html_plain"))),
    }
    return first, then


def _metric_array(config: Config) -> Column:
    return F.array(*[build(config) for build in REGISTRY.values()]).alias("metrics")


def page_metrics(pages: DataFrame, config: Config = Config(), lexicon: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """doc_id, page_no, image_path, token_count, blocks, metrics: the fourteen results of each page in order."""
    f = held(features(pages, config, lexicon).drop(*SOURCES), "features")  # two plans of half the size compile far sooner
    return f.select("doc_id", "page_no", "image_path", F.col("n_words").cast("long").alias("token_count"), _once("metrics", config, _metric_array))


def metric_rows(metrics: DataFrame) -> DataFrame:
    """One row a metric."""
    return metrics.select("doc_id", "page_no", F.explode("metrics").alias("m")).select("doc_id", "page_no", "m.*")
