"""What metrics need of a whole document: page languages, the median block count, the lexicon, the trigram model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import STOPWORDS, WHITELIST
from ..functions.text import is_blank, is_numbery, is_pronounceable, language_by_stopwords, let, ngrams, normalize, sentences, word_tokens
from ..session import held

PAGE = ["doc_id", "page_no"]
ADD_K = 0.1
#: Lexicons of at most so many words are broadcast.  Of larger ones, the words on more than a `RARE`th of all pages' words
#: are broadcast and the others joined by shuffle; where the lexicon does not count pages, all are joined in salted copies.
BROADCAST_WORDS = 500_000
SALTS = 32
RARE = 50_000
#: Pages of a document that are scored together, and distinct trigrams of pages that a task counts before it gives them on.
CHUNK = 32
MODEL_ENTRIES = 1 << 20


def page_languages(pages: DataFrame) -> DataFrame:
    """pages with `language` filled: given or detected on the prose, else on the text; gaps take the document's most
    frequent language, the first page's on ties."""
    found = F.coalesce("language", language_by_stopwords(F.col("prose")), language_by_stopwords(F.col("text")))
    detected = pages.withColumn("language", found)
    per = detected.where("language is not null").groupBy("doc_id", "language").agg(F.count("*").alias("n"), F.min("page_no").alias("first"))
    mode = per.groupBy("doc_id").agg(F.max_by("language", F.struct(F.col("n"), -F.col("first"))).alias("doc_language"))
    return detected.join(mode, "doc_id", "left").withColumn("language", F.coalesce("language", "doc_language")).drop("doc_language")


def block_count(blocks: Column, json_count: Column) -> Column:
    return F.coalesce(json_count, F.size(blocks))


def median_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, median_blocks over pages that have blocks or a true count."""
    some = pages.where((F.coalesce("num_blocks_json", F.lit(0)) != 0) | (F.size("blocks") > 0))
    return some.groupBy("doc_id").agg(F.median(block_count(F.col("blocks"), F.col("num_blocks_json")).cast("double")).alias("median_blocks"))


def countable_tokens(text: Column) -> Column:
    return F.filter(word_tokens(text), lambda w: ~is_numbery(w))


def lexicon_key(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"^['’\-]+|['’\-]+$", ""))


def valid_by_shape(token: Column) -> Column:
    """Empty once stripped, whitelisted, a capitalised pronounceable word, or a short word in capitals."""
    core = F.regexp_replace(token, r"^['’\-]+|['’\-]+$", "")
    capital = core.rlike(r"^\p{Lu}")
    shouted = (F.upper(token) == token) & (F.lower(token) != token) & (F.length(token) <= 5)
    return (core == "") | F.lower(core).isin(WHITELIST) | (capital & is_pronounceable(core)) | shouted


def default_lexicon(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """lang, token, n (pages): words that occur on `least_pages` pages or more of a language, and all stopwords and
    whitelisted words.  A stand-in for a dictionary, which is a relation of the caller's."""
    words = pages.select(*PAGE, F.substring(F.coalesce("language", F.lit("en")), 1, 2).alias("lang"), F.explode(F.array_distinct(F.transform(countable_tokens(F.col("prose")), lexicon_key))).alias("token"))
    common = words.groupBy("lang", "token").agg(F.count("*").alias("n"))
    spark = pages.sparkSession
    given = [(k, w) for k, v in STOPWORDS.items() for w in v] + [(k, w) for k in STOPWORDS for w in WHITELIST]
    added = spark.createDataFrame(given, "lang string, token string").select("lang", "token", F.lit(least_pages).cast("long"))
    return common.where(F.col("n") >= least_pages).union(added).groupBy("lang", "token").agg(F.max("n").alias("n"))


def invalid_tokens(pages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, page_no, n_countable, n_bad, n_gibberish, bad: array<struct<n, first, token, gibberish>> by count
    (largest first, first occurrence on ties)."""
    # dealt out as texts, a page's words are counted where they are: a row a word would take many times the disk
    dealt = pages.select(*PAGE, "language", "prose").repartition(*PAGE)
    tokens = dealt.select(*PAGE, F.substring(F.coalesce("language", F.lit("en")), 1, 2).alias("lang"), F.posexplode(countable_tokens(F.col("prose"))).alias("pos", "token"))
    per = tokens.groupBy(*PAGE, "lang", "token").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    pages_of_word = F.sum("n") if "n" in lexicon.columns else F.lit(None).cast("long")
    known = held(lexicon.groupBy(F.col("token").alias("key")).agg(F.array_join(F.collect_set("lang"), ",").alias("langs"), pages_of_word.alias("pages")), "lexicon")
    per = per.withColumn("key", lexicon_key(F.col("token")))
    # a page asks for each of its words once, so every page asks for the commonest: no task may gather those rows
    salt = F.pmod(F.xxhash64(*PAGE), F.lit(SALTS))
    words, asked = known.agg(F.count("*"), F.sum("pages")).first()
    # Spark takes copies to be as small as the file they come from, and would broadcast large tables: hence the hints
    if words <= BROADCAST_WORDS:
        per = per.join(F.broadcast(known), "key", "left")
    elif asked is None:
        copies = known.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))).hint("merge")
        per = per.withColumn("salt", salt).join(copies, ["key", "salt"], "left")
    else:
        hot = F.col("pages") > asked // RARE
        per = per.join(F.broadcast(known.where(hot).select("key", F.col("langs").alias("hot_langs"))), "key", "left")
        # what is known by now is dealt out under keys that no word has
        rest = F.when(F.col("hot_langs").isNull(), F.col("key")).otherwise(F.concat(F.lit(" "), salt.cast("string")))
        per = per.withColumn("rest", rest).join(known.where(~hot).select(F.col("key").alias("rest"), "langs").hint("merge"), "rest", "left")
        per = per.withColumn("langs", F.coalesce("hot_langs", "langs"))
    known_word = (F.find_in_set(F.col("lang"), F.col("langs")) > 0) | (F.find_in_set(F.lit("en"), F.col("langs")) > 0)
    bad = ~(F.coalesce(known_word, F.lit(False)) | valid_by_shape(F.col("token")))
    per = per.withColumn("bad", bad).withColumn("gibberish", ~is_pronounceable(F.col("token")))
    entry = F.struct((-F.col("n")).alias("order"), F.col("first").alias("first"), F.col("n").cast("int").alias("n"), F.col("token"), F.col("gibberish"))
    return per.groupBy(*PAGE).agg(
        F.sum("n").alias("n_countable"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("n_bad"),
        F.sum(F.when(F.col("bad") & F.col("gibberish"), F.col("n")).otherwise(0)).alias("n_gibberish"),
        F.array_sort(F.collect_list(F.when(F.col("bad"), entry))).alias("bad"),
    )


def prepared(text: Column) -> Column:
    return F.concat(F.lit(" "), normalize(text), F.lit(" "))


def trigram_codes(text: str) -> np.ndarray:
    """Character trigrams of a prepared text, in order, each as three code points in one number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sum of the counts of each."""
    known, at = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *codes]), return_inverse=True)
    return known, np.bincount(at, weights=np.concatenate([np.zeros(0), *counts]), minlength=len(known))


def trigram_bits(x: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of each trigram of x by a document's counts: its third character after the two before, add-`ADD_K`."""
    letter = np.uint64(21)
    context, first = np.unique(codes >> letter, return_index=True)
    sums = np.add.reduceat(counts, first) if len(first) else counts
    v = len(np.unique(np.concatenate([codes >> np.uint64(42), (codes >> letter) & np.uint64(0x1FFFFF), codes & np.uint64(0x1FFFFF)])))

    def found(keys, values, k):
        if not len(keys):
            return np.zeros(len(k))
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where(keys[at] == k, values[at], 0.0)

    return -np.log2((found(codes, counts, x) + ADD_K) / (found(context, sums, x >> letter) + ADD_K * max(v, 1)))


def _page_models(batches):
    """Counts of trigrams by document: one row a document and task, or more where a task's grow large."""
    held_, size = {}, 0

    def flush():
        rows = [(d, *summed(*zip(*parts, strict=True))) for d, parts in held_.items()]
        held_.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["doc_id", "codes", "counts"])

    for batch in batches:
        for doc, pages in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for page in pages.as_py():
                part = np.unique(trigram_codes(page["prepared"]), return_counts=True)
                held_.setdefault(doc, []).append(part)
                size += len(part[0])
            if size > MODEL_ENTRIES:
                yield flush()
                size = 0
    if held_:
        yield flush()


def _score_chunk(doc, pages: list[dict], model: list[dict] | None) -> list[tuple]:
    """page_no, surprisal, worst sentences of the pages of a chunk, by the model given or, without one, by their own counts."""
    unit, of, x, split = {}, [], [], []
    for page in pages:
        own = trigram_codes(page["prepared"])
        for pos, codes in [(-1, own), *((k, trigram_codes(s["prepared"])) for k, s in enumerate(page["sentences"]))]:
            of.append(np.full(len(codes), unit.setdefault((page["page_no"], pos), len(unit))))
            x.append(codes)
        split += [(page["page_no"], k, s["sentence"]) for k, s in enumerate(page["sentences"])]
    if model is not None:
        codes, counts = summed([np.frombuffer(m["codes"], dtype=np.uint64) for m in model], [np.frombuffer(m["counts"], dtype=np.float64) for m in model])
    else:
        codes, counts = np.unique(np.concatenate([trigram_codes(page["prepared"]) for page in pages]), return_counts=True)
    if doc is None:  # pages of no document have no model
        codes, counts = codes[:0], counts[:0]
    at, bits = np.concatenate(of), trigram_bits(np.concatenate(x), codes, counts.astype(np.float64))
    n = np.bincount(at, minlength=len(unit))
    mean = np.bincount(at, weights=bits, minlength=len(unit)) / np.maximum(n, 1)
    worst: dict = {}
    for page_no, pos, sentence in split:
        u = unit[page_no, pos]
        b = float(mean[u]) if n[u] else None
        worst.setdefault(page_no, []).append(((b is not None, -(b or 0.0), pos, sentence), {"order": None if b is None else -b, "pos": pos, "bits": b, "sentence": sentence}))
    first = lambda page_no: [w for _, w in sorted(worst.get(page_no, []), key=lambda w: w[0])[:3]]
    return [(page_no, float(mean[u]), first(page_no)) for (page_no, pos), u in unit.items() if pos == -1 and n[u]]


_WORST = pa.list_(pa.struct([("order", pa.float64()), ("pos", pa.int32()), ("bits", pa.float64()), ("sentence", pa.string())]))


def _scored_pages(batches):
    for batch in batches:
        for doc, pages, model in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            rows = _score_chunk(doc, pages.as_py(), model.as_py())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], _WORST)], ["doc_id", "page_no", "surprisal", "worst"])


def page_fluency(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page_no, surprisal: mean bits a character of the page, worst: array<struct<order, pos, bits, sentence>>) of
    pages with prose, and the bounds of a document.

    Trigrams are counted and looked up in chunks of `CHUNK` pages of a document: only texts are shuffled, once, and the counts
    of documents of more than one chunk.  A row a trigram would take dozens of times the disk of the texts."""
    some = pages.where(~is_blank(F.col("prose"))).select(F.col("doc_id").cast("string"), F.col("page_no").cast("int"), "prose")
    chunks = some.groupBy("doc_id", F.floor(F.col("page_no") / CHUNK).alias("chunk")).agg(F.collect_list(F.struct("page_no", "prose")).alias("pages"))
    chunks = held(chunks.select("doc_id", "pages"), "chunks")
    many = chunks.groupBy("doc_id").count().where("count > 1").select("doc_id")
    split = F.transform("pages", lambda p: F.struct(p["page_no"].alias("page_no"), prepared(p["prose"]).alias("prepared"), F.transform(sentences(p["prose"]), lambda s: F.struct(s.alias("sentence"), prepared(s).alias("prepared"))).alias("sentences")))
    model = "array<struct<codes: binary, counts: binary>>"
    if many.head(1):
        texts = F.transform("pages", lambda p: F.struct(prepared(p["prose"]).alias("prepared")))
        parts = chunks.join(many, "doc_id", "left_semi").select("doc_id", texts.alias("pages")).mapInArrow(_page_models, "doc_id string, codes binary, counts binary")
        models = held(parts.groupBy("doc_id").agg(F.collect_list(F.struct("codes", "counts")).cast(model).alias("model")), "models")
        units = chunks.join(models, "doc_id", "left").select("doc_id", split.alias("pages"), "model")
    else:
        units = chunks.select("doc_id", split.alias("pages"), F.lit(None).cast(model).alias("model"))
    scored = units.mapInArrow(_scored_pages, "doc_id string, page_no int, surprisal double, worst array<struct<order: double, pos: int, bits: double, sentence: string>>")
    per_page = held(scored, "fluency")
    return per_page, fluency_bounds(per_page)


def fluency_bounds(per_page: DataFrame) -> DataFrame:
    """doc_id, ppl_good, ppl_bad from the document's own pages."""
    sorted_ = per_page.where("surprisal > 0").groupBy("doc_id").agg(F.sort_array(F.collect_list("surprisal")).alias("s"))
    n = F.size("s")
    at = lambda i: F.element_at("s", (i + 1).cast("int"))
    low = at(F.greatest(F.lit(0), F.floor(0.25 * n) - 1))
    high = at(F.least(n - 1, F.floor(0.90 * n)))
    mid = at(F.floor(n / 2))
    return sorted_.select("doc_id", F.when(n >= 4, low).otherwise(mid).alias("ppl_good"), F.when(n >= 4, F.greatest(high, low * 1.5 + 0.5)).otherwise(mid * 1.8 + 0.8).alias("ppl_bad"))


def top_ngram(text: Column, n: int) -> Column:
    """struct<top_ngram, top_count>: the most frequent run of n words of a text, the first on ties; null without any."""
    grams = F.array_sort(F.transform(ngrams(word_tokens(F.lower(text)), n), lambda g, i: F.struct(g.alias("gram"), i.alias("pos"))))
    none = F.expr("named_struct('gram', cast(null as string), 'c', 0, 'first', 0, 'top_ngram', cast(null as string), 'top_count', 0, 'top_first', 0)")

    def step(a, x):
        same = a["gram"].eqNullSafe(x["gram"])
        c, first = F.when(same, a["c"] + 1).otherwise(1), F.when(same, a["first"]).otherwise(x["pos"])
        better = (c > a["top_count"]) | ((c == a["top_count"]) & (first < a["top_first"]))
        best = [F.when(better, new).otherwise(a[k]).alias(k) for k, new in (("top_ngram", x["gram"]), ("top_count", c), ("top_first", first))]
        return F.struct(x["gram"].alias("gram"), c.alias("c"), first.alias("first"), *best)

    return let(F.aggregate(grams, none, step), lambda a: F.when(a["top_ngram"].isNotNull(), F.struct(a["top_ngram"].alias("top_ngram"), a["top_count"].alias("top_count"))))


def top_ngrams(pages: DataFrame, n: int) -> DataFrame:
    """doc_id, page_no, top_ngram, top_count: the most frequent run of n words, the first on ties."""
    text = F.when(F.col("prose") != "", F.col("prose")).otherwise(F.col("text"))
    grams = pages.select(*PAGE, F.posexplode(ngrams(word_tokens(F.lower(text)), n)).alias("pos", "gram"))
    per = grams.groupBy(*PAGE, "gram").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    return per.groupBy(*PAGE).agg(F.max_by("gram", F.struct(F.col("c"), -F.col("first"))).alias("top_ngram"), F.max("c").cast("int").alias("top_count"))
