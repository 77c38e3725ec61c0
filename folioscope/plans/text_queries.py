"""Queries over page text on the driver's tables, each with the SQL that must agree.

Pages come from `documents` (page = doc_id, document = source) or `conversations` (document = conv_id, page = turn + 1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..constants import LETTERS, STOPWORDS, VOWELS, WHITELIST
from ..functions import markup as M
from ..functions import text as T
from ..operators import context as C
from ..operators import metrics as X
from ..operators.pages import from_texts, with_text
from ..session import spread

R6 = lambda c: T.rounded(c, 6)
LONG = lambda c: c.cast("long")

# SQL fragments
WORD_SQL = r"[\p{L}\p{Nl}\p{No}]+(?:[''’\-][\p{L}\p{Nl}\p{No}]+)*"
SPACE_SQL = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def words_sql(t: str) -> str:
    return f"regexp_extract_all(coalesce({t}, ''), '{WORD_SQL}')"


def strip_sql(t: str) -> str:
    return f"regexp_replace(coalesce({t}, ''), '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def sentences_sql(t: str) -> str:
    marked = f"regexp_replace({strip_sql(t)}, '([.!?]){SPACE_SQL}+', '\\1' || chr(1), 'g')"
    return f"[x FOR x IN [{strip_sql('y')} FOR y IN string_split({marked}, chr(1))] IF x <> '']"


def pronounceable_sql(t: str) -> str:
    """As a CASE over the letters of a lower-cased token."""
    only = f"regexp_replace(lower({t}), '[^\\p{{L}}]', '', 'g')"
    vowels = f"len(regexp_replace({only}, '[^{VOWELS}]', '', 'g'))"
    from ..constants import ILLEGAL_BIGRAMS

    odd = f"regexp_matches({only}, '[^{VOWELS}]{{5,}}|{'|'.join(ILLEGAL_BIGRAMS)}')"
    return f"CASE WHEN len({only}) <= 2 THEN true ELSE {vowels} / len({only}) BETWEEN 0.18 AND 0.90 AND NOT {odd} END"


def lerp_sql(v: str, good: float, bad: float) -> str:
    return f"round((1.0 - greatest(0.0, least(1.0, (({v}) - {good}::DOUBLE) / ({bad}::DOUBLE - {good}::DOUBLE)))) * 100.0, 1)"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    c = spread(spark.read.parquet(f"{d}/conversations.parquet"))
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "role", "text")


TURNS = "turns AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, role, coalesce(text, '') AS text FROM conversations)"


def pages_of(spark, d) -> DataFrame:
    return with_text(from_texts(turns(spark, d)))


def word_token_counts(spark, d):
    w = T.word_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", LONG(F.size(w)).alias("n_words"), LONG(F.size(F.array_distinct(F.transform(w, F.lower)))).alias("n_types"), F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("")).alias("first_word"))


def raw_token_counts(spark, d):
    r = T.raw_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", LONG(F.size(r)).alias("n_tokens"), LONG(F.coalesce(F.array_max(F.transform(r, F.length)), F.lit(0))).alias("longest"))


def token_classes(spark, d):
    r = T.raw_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", LONG(F.size(F.filter(r, T.is_numbery))).alias("n_numbery"), LONG(F.size(F.filter(r, T.is_url_or_email))).alias("n_addresses"), LONG(F.size(F.filter(r, T.is_alnum_confusion))).alias("n_confused"))


def sentence_stats(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", LONG(F.size(s)).alias("n_sentences"), LONG(F.size(F.filter(s, lambda x: x.rlike(r"[.!?]$")))).alias("n_ended"), LONG(F.size(F.filter(s, lambda x: F.size(T.word_tokens(x)) > 60))).alias("n_long"))


def strip_html_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.strip_html(F.col("html")).alias("plain"))


def tag_inventory(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    t = p.select("page_id", F.explode(M.tags(F.col("html"))).alias("t"))
    return t.groupBy("page_id", F.col("t.name").alias("tag")).agg(F.sum(F.when(F.col("t.close"), 0).otherwise(1)).alias("opened"), F.sum(F.when(F.col("t.close"), 1).otherwise(0)).alias("closed"))


def html_malformed(spark, d):
    """Whole pages cut before each block of theirs; null where a part is well-formed."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    parts = F.split("html", r"(?=<(?:head|body|nav|div|article|footer|p|h1)\b)")
    blocks = p.select("page_id", F.posexplode(parts).alias("ord", "html")).where("html <> ''")
    return blocks.select("page_id", LONG(F.col("ord")).alias("ord"), M.malformed(F.col("html")).alias("reason"))


def ttr(spark, d):
    p = X.ttr_parts(T.word_tokens(F.col("text")))
    return docs(spark, d).select("doc_id", LONG(p["n"]).alias("n"), R6(p["ratio"]).alias("ttr"), R6(p["low"]).alias("band_low"), R6(p["high"]).alias("band_high"), R6(p["score"]).alias("score")).where("n >= 10")


TTR_SQL = f"""
WITH w AS (SELECT doc_id, [lower(x) FOR x IN {words_sql('text')}] AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, list_distinct(ws) AS ts FROM w WHERE len(ws) >= 10),
r AS (SELECT doc_id, n, len(ts) / n AS ttr, len([x FOR x IN ts IF NOT ({pronounceable_sql('x')})]) / len(ts) AS junk,
        greatest(0.35, least(0.95, 1.6 / sqrt(n) + 0.30)) AS center FROM t),
b AS (SELECT *, greatest(0.20, center - 0.22) AS lo, least(0.99, center + 0.20) AS hi FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, round(ttr, 6) AS ttr, round(lo, 6) AS band_low, round(hi, 6) AS band_high,
  round(greatest(0.0, 100.0 - (CASE WHEN ttr < lo THEN lo - ttr WHEN ttr > hi THEN ttr - hi + CASE WHEN junk > 0.3 THEN 0.1 ELSE 0.0 END ELSE 0.0 END / 0.30::DOUBLE) * 100.0), 6) AS score
FROM b
"""


def stopword_conformance(spark, d):
    w, lang = T.word_tokens(F.col("text")), X.stopword_language(F.col("lang"))
    n = F.size(w)
    k = X.stopword_count(w, lang)
    raw = F.abs(k / n - F.when(lang == "de", 0.42).otherwise(0.45))
    return docs(spark, d).where(n > 0).select("doc_id", lang.alias("used_lang"), LONG(k).alias("n_stop"), R6(raw).alias("raw"), T.lerp_score(raw, 0.0, 0.18).alias("score"))


SFC_SQL = f"""
WITH w AS (SELECT doc_id, CASE WHEN substr(lang, 1, 2) IN ('de', 'en') THEN substr(lang, 1, 2) ELSE 'en' END AS used_lang, [lower(x) FOR x IN {words_sql('text')}] AS ws FROM documents),
k AS (SELECT doc_id, used_lang, len(ws) AS n, CASE used_lang WHEN 'de' THEN len([x FOR x IN ws IF x IN {in_list(STOPWORDS['de'])}]) ELSE len([x FOR x IN ws IF x IN {in_list(STOPWORDS['en'])}]) END AS n_stop FROM w WHERE len(ws) > 0),
r AS (SELECT *, abs(n_stop / n - CASE used_lang WHEN 'de' THEN 0.42::DOUBLE ELSE 0.45::DOUBLE END) AS raw FROM k)
SELECT doc_id, used_lang, CAST(n_stop AS BIGINT) AS n_stop, round(raw, 6) AS raw, {lerp_sql('raw', 0.0, 0.18)} AS score FROM r
"""


def doc_pages(spark, d) -> DataFrame:
    rows = docs(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text", F.col("lang").alias("language"))
    return with_text(from_texts(rows))


def lexical_validity(spark, d):
    p = doc_pages(spark, d)
    bad = C.invalid_tokens(p, C.default_lexicon(p))
    ratio = (F.col("n_countable") - F.col("n_bad")) / F.col("n_countable")
    return bad.select(LONG(F.col("page_no")).alias("page_no"), LONG(F.col("n_countable")).alias("n_countable"), LONG(F.col("n_bad")).alias("n_bad"), LONG(F.col("n_gibberish")).alias("n_gibberish"), R6(ratio).alias("ratio"), T.rounded(T.lexical_score(ratio), 1).alias("score"))


def top_unknown_words(spark, d):
    p = doc_pages(spark, d)
    bad = C.invalid_tokens(p, C.default_lexicon(p)).select("page_no", F.posexplode(F.slice("bad", 1, 8)).alias("pos", "b"))
    return bad.select(LONG(F.col("page_no")).alias("page_no"), LONG(F.col("pos") + 1).alias("rank"), "b.token", LONG(F.col("b.n")).alias("n"), F.col("b.gibberish").alias("gibberish"))


_LEX = f"""
WITH toks AS (SELECT doc_id AS page_no, coalesce(substr(lang, 1, 2), 'en') AS lang, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM
    (SELECT doc_id, lang, [x FOR x IN {words_sql('text')} IF NOT regexp_matches(x, '^[\\p{{Nd}}.,:/%\\-+°×x ]+$')] AS ws FROM documents)),
keyed AS (SELECT *, regexp_replace(token, '^[''’\\-]+|[''’\\-]+$', '', 'g') AS core FROM toks),
lex AS (SELECT lang, lower(core) AS key FROM keyed GROUP BY lang, lower(core) HAVING count(DISTINCT page_no) >= 3
    UNION SELECT 'en', unnest({['', *STOPWORDS['en'], *WHITELIST]}) UNION SELECT 'de', unnest({['', *STOPWORDS['de'], *WHITELIST]})),
per AS (SELECT page_no, lang, token, any_value(core) AS core, count(*) AS n, min(pos) AS first FROM keyed GROUP BY page_no, lang, token),
judged AS (SELECT per.*, NOT ({pronounceable_sql('token')}) AS gibberish,
    NOT (core = '' OR EXISTS (SELECT 1 FROM lex WHERE lex.key = lower(core) AND lex.lang IN (per.lang, 'en'))
      OR lower(core) IN {in_list(WHITELIST)} OR (regexp_matches(core, '^\\p{{Lu}}') AND {pronounceable_sql('core')})
      OR (upper(token) = token AND lower(token) <> token AND len(token) <= 5)) AS bad FROM per)
"""
LEX_SQL = (
    _LEX
    + """, s AS (SELECT page_no, CAST(sum(n) AS BIGINT) AS n_countable, CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS n_bad, CAST(coalesce(sum(n) FILTER (bad AND gibberish), 0) AS BIGINT) AS n_gibberish FROM judged GROUP BY page_no),
r AS (SELECT *, (n_countable - n_bad) / n_countable AS ratio FROM s)
SELECT page_no, n_countable, n_bad, n_gibberish, round(ratio, 6) AS ratio,
  round(CASE WHEN ratio >= 0.95 THEN 100.0 WHEN ratio <= 0.60 THEN 0.0 WHEN ratio >= 0.80 THEN (ratio - 0.80::DOUBLE) / 0.15::DOUBLE * 40 + 60 ELSE (ratio - 0.60::DOUBLE) / 0.20::DOUBLE * 60 END, 1) AS score FROM r
"""
)
TOP_UNKNOWN_SQL = (
    _LEX
    + """, r AS (SELECT page_no, token, n, gibberish, row_number() OVER (PARTITION BY page_no ORDER BY n DESC, first) AS rank FROM judged WHERE bad)
SELECT page_no, rank, token, n, gibberish FROM r WHERE rank <= 8
"""
)


def oov_gibberish(spark, d):
    return lexical_validity(spark, d).where("n_bad > 0").select("page_no", R6(F.col("n_gibberish") / F.col("n_bad")).alias("raw"), T.lerp_score(F.col("n_gibberish") / F.col("n_bad"), 0.0, 0.5).alias("score"))


OOV_SQL = f"SELECT page_no, round(n_gibberish / n_bad, 6) AS raw, {lerp_sql('n_gibberish / n_bad', 0.0, 0.5)} AS score FROM ({LEX_SQL}) WHERE n_bad > 0"


def char_entropy(spark, d):
    return docs(spark, d).select("doc_id", R6(T.shannon_entropy(F.col("text"))).alias("entropy"))


def kl_divergence(spark, d):
    kl = T.kl_divergence(F.col("text"), F.col("lang"))
    return docs(spark, d).select("doc_id", R6(kl).alias("kl"))


_CHARS = "chars AS (SELECT doc_id, lang, unnest(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]', '', 'g'), '')) AS ch FROM documents), cc AS (SELECT doc_id, lang, ch, count(*) AS n FROM chars WHERE ch <> '' GROUP BY ALL), tot AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM cc)"
ENTROPY_SQL = f"WITH {_CHARS} SELECT doc_id, round(coalesce(e, 0.0), 6) AS entropy FROM documents LEFT JOIN (SELECT doc_id, -sum(n / total * log2(n / total)) AS e FROM tot GROUP BY doc_id) USING (doc_id)"
_BASE = " UNION ALL ".join(f"SELECT '{k}' AS base, unnest({list(v)}) AS ch, unnest({list(v.values())}::DOUBLE[]) AS q" for k, v in LETTERS.items())
KL_SQL = f"""WITH {_CHARS}, base AS ({_BASE}),
k AS (SELECT doc_id, greatest(0.0, sum(n / total * log2(n / total / coalesce(q, 1e-6)))) AS kl FROM tot LEFT JOIN base ON base.ch = tot.ch AND base.base = CASE WHEN substr(lang, 1, 2) = 'de' THEN 'de' ELSE 'en' END GROUP BY doc_id)
SELECT doc_id, round(coalesce(kl, 0.0), 6) AS kl FROM documents LEFT JOIN k USING (doc_id)"""


def mojibake_hits(spark, d):
    broken = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("é"), F.lit("Ã©"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" â€œx� a­b"))).otherwise(F.col("text"))
    hits = T.mojibake_hits(broken)
    return docs(spark, d).select("doc_id", LONG(F.size(hits)).alias("n_hits"), (F.size(hits) >= 3).alias("hard"))


def hits_sql(t: str) -> str:
    odd = r"\x{FFFD}|Ã[\x{80}-\x{BF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ]|Â[\x{A0}-\x{BF}]|â€[\x{9C}\x{9D}\x{99}™œ“”˜]|â€"
    control = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\p{Cf}]"
    return f"len(regexp_extract_all({t}, '{odd}')) + len(regexp_extract_all({t}, '{control}'))"


MOJIBAKE_SQL = f"""
WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, 'é', 'Ã©') WHEN 1 THEN text || ' â€œx' || chr(65533) || ' a' || chr(173) || 'b' ELSE text END AS t FROM documents),
h AS (SELECT doc_id, {hits_sql('t')} AS n FROM b)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_hits, coalesce(n, 0) >= 3 AS hard FROM h
"""


def word_shape(spark, d):
    r = T.raw_tokens(F.col("text"))
    s = X.word_shapes(r, 25)
    bad = F.size(s["merged"]) + F.size(s["single"]) + F.size(s["hyphen"]) + F.size(s["alnum"])
    return docs(spark, d).where(F.size(r) > 0).select("doc_id", *[LONG(F.size(v)).alias(f"n_{k}") for k, v in s.items()], T.lerp_score(bad / F.size(r), 0.02, 0.15).alias("score"))


WSA_SQL = rf"""
WITH r AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+') AS raw FROM documents),
c AS (SELECT doc_id, len(raw) AS n, [x FOR x IN [regexp_replace(y, '^[.,;:!?()\[\]"''“”·]+|[.,;:!?()\[\]"''“”·]+$', '', 'g') FOR y IN raw] IF x <> ''] AS cores FROM r WHERE len(raw) > 0),
k AS (SELECT doc_id, n, len([x FOR x IN cores IF len(x) > 25 AND regexp_matches(x, '\p{{L}}')]) AS n_merged,
  len([x FOR x IN cores IF len(x) = 1 AND regexp_matches(x, '\p{{L}}') AND NOT contains('aIiAàáâäéèêëÀ', x)]) AS n_single,
  len([x FOR x IN cores IF x LIKE '%-' AND len(x) > 1]) AS n_hyphen,
  len([x FOR x IN cores IF len(x) >= 4 AND regexp_matches(x, '[A-Za-zÀ-ÿ][0-9]|[0-9][A-Za-zÀ-ÿ]') AND NOT regexp_matches(x, '^[\p{{Nd}}.,:/%\-+°×x ]+$') AND NOT regexp_matches(x, '(?i)https?://|www\.|[^@\s]+@[^@\s]+\.[^@\s]+')]) AS n_alnum FROM c)
SELECT doc_id, CAST(n_merged AS BIGINT) AS n_merged, CAST(n_single AS BIGINT) AS n_single, CAST(n_hyphen AS BIGINT) AS n_hyphen, CAST(n_alnum AS BIGINT) AS n_alnum, {lerp_sql('(n_merged + n_single + n_hyphen + n_alnum) / n', 0.02, 0.15)} AS score FROM k
"""


def bracket_balance(spark, d):
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, ' (a [b) {c "').otherwise(" (fine) [x]"))
    return docs(spark, d).select("doc_id", LONG(T.bracket_defects(text)).alias("unmatched"))


def punctuation_defects(spark, d):
    p = X.punctuation_parts(F.col("text"), T.word_tokens(F.col("text")))
    return docs(spark, d).where(~T.is_blank(F.col("text"))).select("doc_id", LONG(p["long"]).alias("n_long"), LONG(p["gaps"]).alias("n_gaps"), LONG(p["before"]).alias("n_before"), R6(p["ended"]).alias("end_ratio"))


PSW_SQL = rf"""
WITH s AS (SELECT doc_id, text, {sentences_sql('text')} AS ss FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]'))
SELECT doc_id, CAST(len([x FOR x IN ss IF len({words_sql('x')}) > 60]) AS BIGINT) AS n_long, CAST(len(regexp_extract_all(text, ' {{3,}}')) AS BIGINT) AS n_gaps,
  CAST(len(regexp_extract_all(text, '{SPACE_SQL}+[,.;:!?]')) AS BIGINT) AS n_before, round(len([x FOR x IN ss IF regexp_matches(x, '[.!?]$')]) / len(ss), 6) AS end_ratio FROM s
"""


def ngram_repetition(spark, d):
    rep = T.trigram_repetition(F.col("text"))
    return docs(spark, d).select("doc_id", R6(rep).alias("trigram_rep"), T.lerp_score(rep, 0.1, 0.6).alias("score"))


REPETITION_SQL = f"""
WITH w AS (SELECT doc_id, [lower(x) FOR x IN {words_sql('lower(text)')}] AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] ELSE [] END AS gs FROM w),
r AS (SELECT doc_id, CASE WHEN len(gs) > 0 THEN 1 - len(list_distinct(gs)) / len(gs) ELSE 0.0 END AS rep FROM g)
SELECT doc_id, round(rep, 6) AS trigram_rep, {lerp_sql('rep', 0.1, 0.6)} AS score FROM r
"""


def top_ngram(spark, d):
    t = C.top_ngrams(doc_pages(spark, d), 5)
    return t.select(LONG(F.col("page_no")).alias("page_no"), "top_ngram", LONG(F.col("top_count")).alias("top_count"), (F.col("top_count") > 5).alias("hard"))


TOP_NGRAM_SQL = f"""
WITH w AS (SELECT doc_id, {words_sql('lower(text)')} AS ws FROM documents),
g AS (SELECT doc_id, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) AS gram, unnest(range(1, len(ws) - 3)) AS pos FROM w WHERE len(ws) >= 5),
c AS (SELECT doc_id, gram, count(*) AS n, min(pos) AS first FROM g GROUP BY doc_id, gram),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM c)
SELECT doc_id AS page_no, gram AS top_ngram, n AS top_count, n > 5 AS hard FROM r WHERE k = 1
"""


def gzip_ratio(spark, d):
    return docs(spark, d).select("doc_id", R6(M.gzip_ratio(F.col("text"))).alias("gzip_ratio"))


def page_surprisal(spark, d):
    per, _ = C.page_fluency(pages_of(spark, d))
    return per.select(F.col("doc_id").cast("long").alias("doc_id"), LONG(F.col("page_no")).alias("page_no"), R6(F.col("surprisal")).alias("surprisal"))


def fluency_bounds(spark, d):
    _, bounds = C.page_fluency(pages_of(spark, d))
    return bounds.select(F.col("doc_id").cast("long").alias("doc_id"), R6(F.col("ppl_good")).alias("ppl_good"), R6(F.col("ppl_bad")).alias("ppl_bad"))


def worst_sentences(spark, d):
    per, _ = C.page_fluency(pages_of(spark, d))
    w = per.select("doc_id", "page_no", F.posexplode("worst").alias("rank", "s"))
    return w.select(F.col("doc_id").cast("long").alias("doc_id"), LONG(F.col("page_no")).alias("page_no"), LONG(F.col("rank") + 1).alias("rank"), T.rounded(F.col("s.bits"), 5).alias("bits"))


def _norm_sql(t: str) -> str:
    return f"' ' || regexp_replace(lower({strip_sql(t)}), '{SPACE_SQL}+', ' ', 'g') || ' '"


_TRI_CTES = f"""
units AS (SELECT doc_id, page_no, -1 AS pos, text AS u FROM turns WHERE {strip_sql('text')} <> ''
  UNION ALL SELECT doc_id, page_no, unnest(range(len(ss))) AS pos, unnest(ss) AS u FROM (SELECT doc_id, page_no, {sentences_sql('text')} AS ss FROM turns)),
prep AS (SELECT doc_id, page_no, pos, {_norm_sql('u')} AS t FROM units),
tri AS (SELECT doc_id, page_no, pos, unnest([substr(t, i, 3) FOR i IN range(1, len(t) - 1)]) AS g FROM prep),
c3 AS (SELECT doc_id, g, count(*) AS c3 FROM tri WHERE pos = -1 GROUP BY ALL),
c2 AS (SELECT doc_id, substr(g, 1, 2) AS ctx, sum(c3) AS c2 FROM c3 GROUP BY ALL),
v AS (SELECT doc_id, count(DISTINCT ch) AS v FROM (SELECT doc_id, unnest(string_split(t, '')) AS ch FROM prep WHERE pos = -1) GROUP BY doc_id),
scored AS (SELECT tri.doc_id, page_no, pos, avg(-log2((coalesce(c3, 0) + 0.1::DOUBLE) / (coalesce(c2, 0) + 0.1::DOUBLE * v))) AS s
  FROM tri JOIN v USING (doc_id) LEFT JOIN c3 ON c3.doc_id = tri.doc_id AND c3.g = tri.g LEFT JOIN c2 ON c2.doc_id = tri.doc_id AND c2.ctx = substr(tri.g, 1, 2) GROUP BY ALL)
"""
_TRI = f"WITH {TURNS},{_TRI_CTES}"
_BOUNDS_CTES = """, l AS (SELECT doc_id, list(s ORDER BY s) AS xs, count(*) AS n FROM scored WHERE pos = -1 AND s > 0 GROUP BY doc_id),
b AS (SELECT doc_id, n, xs[1 + greatest(0, floor(0.25 * n)::BIGINT - 1)] AS lo, xs[1 + least(n - 1, floor(0.9 * n)::BIGINT)] AS hi, xs[1 + n // 2] AS mid FROM l),
bounds_ AS (SELECT doc_id, CASE WHEN n >= 4 THEN lo ELSE mid END AS ppl_good, CASE WHEN n >= 4 THEN greatest(hi, lo * 1.5 + 0.5) ELSE mid * 1.8::DOUBLE + 0.8::DOUBLE END AS ppl_bad FROM b)
"""


def _surprisal_sql(what: str) -> str:
    """Page and sentence surprisal, or the bounds of documents, of whatever `turns` is in scope."""
    return f"WITH {_TRI_CTES}{_BOUNDS_CTES} SELECT * FROM " + ("scored" if what == "scored" else "bounds_")


SURPRISAL_SQL = _TRI + "SELECT doc_id, page_no, round(s, 6) AS surprisal FROM scored WHERE pos = -1"
BOUNDS_SQL = f"{_TRI}{_BOUNDS_CTES} SELECT doc_id, round(ppl_good, 6) AS ppl_good, round(ppl_bad, 6) AS ppl_bad FROM bounds_"
WORST_SQL = _TRI + ", r AS (SELECT doc_id, page_no, s, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY s DESC, pos) AS rank FROM scored WHERE pos >= 0) SELECT doc_id, page_no, rank, round(s, 5) AS bits FROM r WHERE rank <= 3"


#: Items whose words are held against a batch of documents at a time, and the words of them (one item at least).
TILE_ITEMS, TILE_WORDS = 256, 1 << 14


def _tiles(items: list) -> list[list]:
    out, words = [], 0
    for item in items:
        if not out or len(out[-1]) >= TILE_ITEMS or words + len(item["mine"]) > TILE_WORDS:
            out.append([])
            words = 0
        out[-1].append(item)
        words += len(item["mine"])
    return out


def _incidence(tile: list) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of some items, and which item has which (words by items)."""
    words = pa.array([w for item in tile for w in item["mine"]], pa.large_string()).dictionary_encode()
    has = np.zeros((len(words.dictionary), len(tile)), dtype=np.float32)
    has[np.asarray(words.indices), np.repeat(np.arange(len(tile)), [len(item["mine"]) for item in tile])] = 1
    return words.dictionary, has


def word_recall(spark, d):
    """Recall of every benchmark item's words in every document; items are few and go to every task, null if too short to
    judge.  A document's words are looked up once, and one matrix product counts what it shares with each item."""
    words = lambda c: T.word_tokens(F.lower(T.nz(F.col(c))))
    listed = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.array_distinct(words("text")).alias("mine"))
    kind = listed.schema["item_id"].dataType
    tiles = _tiles(listed.collect())

    def run(batches):
        matrices = [(pa.array([x["item_id"] for x in t], to_arrow_type(kind)), np.array([len(x["mine"]) for x in t]), *_incidence(t)) for t in tiles]
        for b in batches:
            lists = b.column(1)
            flat, n_words = lists.flatten().cast(pa.large_string()), np.asarray(pc.list_value_length(lists)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(n_words)])
            for item_ids, size, vocabulary, has in matrices:
                code = np.asarray(pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1))
                # documents at a time: 4 million cells of words seen, 64 thousand rows of results
                step = max(1, min((1 << 22) // max(len(vocabulary), 1), (1 << 16) // len(size)))
                for i in range(0, b.num_rows, step):
                    j = min(i + step, b.num_rows)
                    seen = np.zeros((j - i, len(vocabulary)), dtype=np.float32)
                    mine, doc = code[at[i] : at[j]], np.repeat(np.arange(j - i), n_words[i:j])
                    seen[doc[mine >= 0], mine[mine >= 0]] = 1
                    both = np.rint(seen @ has).astype(np.float64)
                    judged = (n_words[i:j, None] > 0) & (size >= 10)[None, :]
                    recall = pa.array((both / np.maximum(size, 1)).ravel(), mask=~judged.ravel())
                    pair = np.arange(both.size)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(pair // len(size))), item_ids.take(pa.array(pair % len(size))), recall], ["doc_id", "item_id", "recall"])

    rows = docs(spark, d).select("doc_id", words("text").alias("theirs"))
    schema = StructType([rows.schema["doc_id"], StructField("item_id", kind), StructField("recall", DoubleType())])
    return rows.mapInArrow(run, schema).withColumn("recall", R6(F.col("recall")))


RECALL_SQL = f"""
WITH b AS (SELECT item_id, list_distinct({words_sql("lower(coalesce(text, ''))")}) AS mine FROM benchmark),
d AS (SELECT doc_id, list_distinct({words_sql("lower(coalesce(text, ''))")}) AS theirs FROM documents)
SELECT doc_id, item_id, round(CASE WHEN len(mine) >= 10 AND len(theirs) > 0 THEN len(list_intersect(mine, theirs)) / len(mine) END, 6) AS recall FROM d, b
"""


def _errors(t):
    changed = F.concat(F.regexp_replace("text", "e", "3"), F.when(F.col("page_no") % 2 == 0, " extra word").otherwise(""))
    return t.select("doc_id", "page_no", R6(T.character_error_rate(F.col("text"), changed)).alias("cer"), R6(T.word_error_rate(F.col("text"), changed)).alias("wer"))


def error_rates(spark, d):
    """Character and word error of turns against themselves with one letter and one word changed."""
    return _errors(turns(spark, d))


CER_ONLY_SQL = f"""
WITH {TURNS}, c AS (SELECT doc_id, page_no, text, replace(text, 'e', '3') || CASE WHEN page_no % 2 = 0 THEN ' extra word' ELSE '' END AS hyp FROM turns),
n AS (SELECT doc_id, page_no, trim({_norm_sql('text')}, ' ') AS r, trim({_norm_sql('hyp')}, ' ') AS h FROM c)
SELECT doc_id, page_no, round(levenshtein(r, h) / len(r), 6) AS cer FROM n WHERE r <> ''
"""


def character_error(spark, d):
    """The character error of every turn that has text."""
    return _errors(turns(spark, d)).select("doc_id", "page_no", "cer").where("cer is not null")


def html_similarity(spark, d):
    """Each page's whole text against itself with one letter changed."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    plain = T.normalize(T.strip_html(F.col("html")))
    return p.select("page_id", R6(M.sequence_similarity(plain, F.regexp_replace(plain, "e", "3"))).alias("ratio"))


def language_mode(spark, d):
    p = doc_pages(spark, d).withColumn("language", F.when(F.col("page_no") % 4 == 0, F.lit(None)).otherwise(F.col("language")))
    given = C.page_languages(p.withColumn("prose", F.lit("")).withColumn("text", F.lit("")))
    return given.select("doc_id", LONG(F.col("page_no")).alias("page_no"), "language")


LANG_SQL = """
WITH p AS (SELECT source, doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang FROM documents),
c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM p WHERE lang IS NOT NULL GROUP BY ALL),
m AS (SELECT source, lang AS mode, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS k FROM c)
SELECT p.source AS doc_id, p.doc_id AS page_no, coalesce(lang, mode) AS language FROM p LEFT JOIN m ON m.source = p.source AND k = 1
"""

def engine_metrics(spark, d):
    """What the engine itself gives each conversation page, by metric, for the metrics that SQL can follow to the score.
    Every third document has decoding artefacts put into its pages."""
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(F.replace("text", F.lit("e"), F.lit("Ã©")), F.lit(" â€œx"))).otherwise(F.col("text"))
    rows = turns(spark, d).withColumn("text", broken).withColumn("language", F.lit("en"))
    found = X.metric_rows(X.page_metrics(from_texts(rows)))
    page = F.col("doc_id").cast("long") * 1000 + F.col("page_no")
    return found.where(F.col("applicable") & F.col("key").isin(*ENGINE_KEYS)).select(LONG(page).alias("page"), "key", "raw_value", "score", "status", "hard_fail")


ENGINE_KEYS = ["IFR", "BCC", "LVR", "OOV", "SFC", "CED", "PPL", "TTR", "WSA"]
_BROKEN = """turns AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, role, CASE WHEN conv_id % 3 = 0 THEN replace(coalesce(text, ''), 'e', 'Ã©') || ' â€œx' ELSE coalesce(text, '') END AS text FROM conversations)"""
ENGINE_SQL = rf"""
WITH {_BROKEN}, documents AS (SELECT doc_id * 1000 + page_no AS doc_id, text, 'en' AS lang FROM turns),
full_ AS (SELECT doc_id, text FROM documents WHERE {strip_sql('text')} <> ''),
lex AS ({LEX_SQL}), tri AS ({_surprisal_sql('scored')}), bounds AS ({_surprisal_sql('b')}),
kl AS ({KL_SQL}), k AS (SELECT doc_id, kl, {hits_sql('text')} AS n FROM full_ JOIN kl USING (doc_id)),
ced AS (SELECT doc_id, kl, n, {lerp_sql('kl', 0.15, 1.5)} AS s FROM k),
c2 AS (SELECT doc_id, kl, n, CASE WHEN n > 0 THEN least(s, greatest(0.0, 60.0 - n * 15.0)) ELSE s END AS s FROM ced),
ppl AS (SELECT tri.doc_id * 1000 + page_no AS page, s, ppl_good AS lo, ppl_bad AS hi FROM tri JOIN bounds USING (doc_id) WHERE pos = -1),
blocks AS (SELECT doc_id * 1000 + page_no AS page, doc_id, CASE WHEN {strip_sql('text')} <> '' THEN 1 ELSE 0 END AS n FROM turns),
filled AS (SELECT doc_id FROM blocks GROUP BY doc_id HAVING max(n) = 1),
wsa AS ({WSA_SQL}), raw AS (SELECT doc_id, len(regexp_extract_all(text, '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+')) AS n FROM documents),
every AS (
  SELECT doc_id AS page, 'IFR' AS key, 0.0::DOUBLE AS raw, 100.0::DOUBLE AS score, false AS hard FROM full_
  UNION ALL SELECT page, 'BCC', (1 - n)::DOUBLE, CASE WHEN n = 1 THEN 100.0 ELSE 40.0 END, false FROM blocks JOIN filled USING (doc_id)
  UNION ALL SELECT page_no, 'LVR', ratio, score, ratio < 0.80 FROM (SELECT page_no, (n_countable - n_bad) / n_countable AS ratio, score FROM lex)
  UNION ALL SELECT doc_id, 'OOV', coalesce(n_gibberish / nullif(n_bad, 0), 0.0), CASE WHEN coalesce(n_bad, 0) = 0 THEN 100.0 ELSE {lerp_sql('n_gibberish / n_bad', 0.0, 0.5)} END, false FROM documents LEFT JOIN lex ON page_no = doc_id
  UNION ALL SELECT doc_id, 'SFC', raw, score, false FROM ({SFC_SQL})
  UNION ALL SELECT doc_id, 'CED', kl, CASE WHEN n >= 3 THEN least(s, 15.0) ELSE s END, n >= 3 FROM c2
  UNION ALL SELECT page, 'PPL', s, round(CASE WHEN hi = lo THEN CASE WHEN s = lo THEN 100.0 ELSE 0.0 END ELSE (1.0 - greatest(0.0, least(1.0, (s - lo) / (hi - lo)))) * 100.0 END, 1), false FROM ppl
  UNION ALL SELECT doc_id, 'TTR', ttr, score, false FROM ({TTR_SQL})
  UNION ALL SELECT doc_id, 'WSA', (n_merged + n_single + n_hyphen + n_alnum) / raw.n, score, false FROM wsa JOIN raw USING (doc_id)
)
SELECT page, key, round(raw::DOUBLE, 4) AS raw_value, round(score::DOUBLE, 1) AS score, CASE WHEN round(score::DOUBLE, 1) >= 70 THEN 'good' WHEN round(score::DOUBLE, 1) >= 50 THEN 'warn' ELSE 'bad' END AS status, hard AS hard_fail FROM every
"""

STRIP_SQL = r"""
WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '"') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\x{A0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM b)
SELECT page_id, regexp_replace(t, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS plain FROM c
"""
TAGS_SQL = r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<\s*/?\s*[a-zA-Z][a-zA-Z0-9]*\b[^>]*>')) AS tag FROM pages),
p AS (SELECT page_id, lower(regexp_extract(tag, '<\s*/?\s*([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, regexp_matches(tag, '^<\s*/') AS close, regexp_matches(tag, '/\s*>$') AS own FROM t)
SELECT page_id, name AS tag, CAST(sum(CASE WHEN close THEN 0 ELSE 1 END) AS BIGINT) AS opened, CAST(sum(CASE WHEN close THEN 1 ELSE 0 END) AS BIGINT) AS closed
FROM p WHERE NOT own AND name NOT IN ('br','img','hr','meta','input','col','area','base','link','source') GROUP BY ALL
"""

QUERIES = {
    "word_token_counts": word_token_counts,
    "raw_token_counts": raw_token_counts,
    "token_classes": token_classes,
    "sentence_stats": sentence_stats,
    "strip_html_text": strip_html_text,
    "tag_inventory": tag_inventory,
    "html_malformed": html_malformed,
    "type_token_ratio": ttr,
    "stopword_conformance": stopword_conformance,
    "lexical_validity": lexical_validity,
    "top_unknown_words": top_unknown_words,
    "oov_gibberish": oov_gibberish,
    "char_entropy": char_entropy,
    "kl_divergence": kl_divergence,
    "mojibake_hits": mojibake_hits,
    "word_shape": word_shape,
    "bracket_balance": bracket_balance,
    "punctuation_defects": punctuation_defects,
    "ngram_repetition": ngram_repetition,
    "top_ngram": top_ngram,
    "gzip_ratio": gzip_ratio,
    "page_surprisal": page_surprisal,
    "fluency_bounds": fluency_bounds,
    "worst_sentences": worst_sentences,
    "word_recall": word_recall,
    "character_error": character_error,
    "error_rates": error_rates,
    "html_similarity": html_similarity,
    "language_mode": language_mode,
    "engine_metrics": engine_metrics,
}
SQL = {
    "word_token_counts": f"WITH w AS (SELECT doc_id, {words_sql('text')} AS ws FROM documents) SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_distinct([lower(x) FOR x IN ws])) AS BIGINT) AS n_types, coalesce(ws[1], '') AS first_word FROM w",
    "raw_token_counts": r"WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\s\x{1c}-\x{1f}\x{85}\p{Z}]+') AS ws FROM documents) SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, CAST(coalesce(list_max([len(x) FOR x IN ws]), 0) AS BIGINT) AS longest FROM w",
    "token_classes": r"WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\s\x{1c}-\x{1f}\x{85}\p{Z}]+') AS ws FROM documents) SELECT doc_id, CAST(len([x FOR x IN ws IF regexp_matches(x, '^[\p{Nd}.,:/%\-+°×x ]+$')]) AS BIGINT) AS n_numbery, CAST(len([x FOR x IN ws IF regexp_matches(x, '(?i)https?://|www\.|[^@\s]+@[^@\s]+\.[^@\s]+')]) AS BIGINT) AS n_addresses, CAST(len([x FOR x IN ws IF len(x) >= 4 AND regexp_matches(x, '[A-Za-zÀ-ÿ][0-9]|[0-9][A-Za-zÀ-ÿ]') AND NOT regexp_matches(x, '^[\p{Nd}.,:/%\-+°×x ]+$') AND NOT regexp_matches(x, '(?i)https?://|www\.|[^@\s]+@[^@\s]+\.[^@\s]+')]) AS BIGINT) AS n_confused FROM w",
    "sentence_stats": f"WITH s AS (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents) SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(len([x FOR x IN ss IF regexp_matches(x, '[.!?]$')]) AS BIGINT) AS n_ended, CAST(len([x FOR x IN ss IF len({words_sql('x')}) > 60]) AS BIGINT) AS n_long FROM s",
    "strip_html_text": STRIP_SQL,
    "tag_inventory": TAGS_SQL,
    "type_token_ratio": TTR_SQL,
    "stopword_conformance": SFC_SQL,
    "lexical_validity": LEX_SQL,
    "top_unknown_words": TOP_UNKNOWN_SQL,
    "oov_gibberish": OOV_SQL,
    "char_entropy": ENTROPY_SQL,
    "kl_divergence": KL_SQL,
    "mojibake_hits": MOJIBAKE_SQL,
    "word_shape": WSA_SQL,
    "punctuation_defects": PSW_SQL,
    "ngram_repetition": REPETITION_SQL,
    "top_ngram": TOP_NGRAM_SQL,
    "page_surprisal": SURPRISAL_SQL,
    "fluency_bounds": BOUNDS_SQL,
    "worst_sentences": WORST_SQL,
    "word_recall": RECALL_SQL,
    "character_error": CER_ONLY_SQL,
    "language_mode": LANG_SQL,
    "engine_metrics": ENGINE_SQL,
}
