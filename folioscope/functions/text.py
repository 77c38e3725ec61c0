"""Scalar functions over page text, as Column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ILLEGAL_BIGRAMS, LETTER_FLOOR, LETTERS, VOWELS

WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’\-][\p{L}\p{Nl}\p{No}]+)*"
#: White space as Unicode has it, with the separators U+001C to U+001F.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
NUMBERY = r"^[\p{Nd}.,:/%\-+°×x ]+$"
URL_OR_EMAIL = r"(?i)https?://|www\.|[^@\s]+@[^@\s]+\.[^@\s]+"
MOJIBAKE = "�|Ã[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ]|Â[\xa0-\xbf]|â€[\x9c\x9d\x99™œ“”˜]|â€"
CONTROL = r"[\p{Cc}\p{Cf}&&[^\t\n\r]]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: expressions that a lambda refers to are otherwise computed again for each
    element."""
    return F.transform(F.array(value), body)[0]


def nz(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(nz(text), rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~nz(text).rlike(rf"[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]")


def word_tokens(text: Column) -> Column:
    """Runs of letters with inner apostrophes or hyphens."""
    return F.regexp_extract_all(nz(text), F.lit(f"({WORD})"), F.lit(1))


def raw_tokens(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(nz(text), F.lit(r"([^\s\x{1c}-\x{1f}\x{85}\p{Z}]+)"), F.lit(1))


def is_numbery(token: Column) -> Column:
    return token.rlike(NUMBERY)


def is_url_or_email(token: Column) -> Column:
    return token.rlike(URL_OR_EMAIL)


def sentences(text: Column) -> Column:
    """Pieces between sentence marks and white space, stripped, blank ones dropped."""
    parts = F.split(strip(text), rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals, half away from zero, as the SQL rounds: by the scaled double, not by its decimal string."""
    scale = F.lit(float(10**digits))
    return F.round(x.cast("double") * scale, 0) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lerp_score(value: Column, good: Column | float, bad: Column | float) -> Column:
    """100 at good, 0 at bad, linear between and clamped, one decimal; either may be the larger."""
    value = value.cast("double")
    good, bad = (x if isinstance(x, Column) else F.lit(float(x)) for x in (good, bad))
    part = clamp((value - good) / F.nullif(bad - good, F.lit(0.0)), 0.0, 1.0)
    return F.when(good == bad, F.when(value == good, 100.0).otherwise(0.0)).otherwise(rounded((F.lit(1.0) - part) * 100.0, 1))


def status_of(score: Column, good: float = 70.0, warn: float = 50.0) -> Column:
    return F.when(score >= good, "good").when(score >= warn, "warn").otherwise("bad")


def pct(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def letters(text: Column) -> Column:
    """Lower-cased letters, one array element each."""
    only = F.regexp_replace(F.lower(nz(text)), r"[^\p{L}]", "")
    return F.filter(F.split(only, ""), lambda c: c != "")


def is_pronounceable(token: Column) -> Column:
    """Could the letters be a word of a Latin language?  By share of vowels, runs of consonants and impossible pairs."""
    t = F.regexp_replace(F.lower(token), r"[^\p{L}]", "")
    n = F.length(t)
    share = F.regexp_count(t, F.lit(f"[{VOWELS}]")) / F.nullif(n, F.lit(0))
    odd = t.rlike(f"[^{VOWELS}]{{5,}}|{'|'.join(ILLEGAL_BIGRAMS)}")
    return F.when(n <= 2, True).otherwise((share >= 0.18) & (share <= 0.90) & ~odd)


def char_counts(text: Column) -> Column:
    """array<struct<ch, n>> of lower-cased letters: distinct letters, each counted once by length differences."""
    joined = F.regexp_replace(F.lower(nz(text)), r"[^\p{L}]", "")
    each = lambda t: F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
    return let(joined, lambda t: F.transform(each(t), lambda c: F.struct(c.alias("ch"), (F.length(t) - F.length(F.replace(t, c, F.lit("")))).alias("n"))))


def letter_shares(text: Column) -> Column:
    """array<struct<ch, p>>: the share of each letter."""
    total = lambda per: F.aggregate(per, F.lit(0), lambda a, x: a + x["n"])
    return let(char_counts(text), lambda per: let(total(per), lambda n: F.transform(per, lambda x: F.struct(x["ch"].alias("ch"), (x["n"] / n).alias("p")))))


def shannon_entropy(text: Column) -> Column:
    """Bits a character over lower-cased letters."""
    return F.aggregate(letter_shares(text), F.lit(0.0), lambda a, x: a - x["p"] * F.log2(x["p"]))


def letter_baseline(lang: Column, ch: Column) -> Column:
    """Expected share of a letter, null outside the alphabet; English where the language has none."""
    of = lambda k: F.try_element_at(F.create_map(*[F.lit(v) for pair in LETTERS[k].items() for v in pair]), ch)
    return F.when(F.substring(F.coalesce(lang, F.lit("en")), 1, 2) == "de", of("de")).otherwise(of("en"))


def kl_divergence(text: Column, lang: Column) -> Column:
    """Divergence of the letters of a text from its language's, at least 0."""
    term = lambda x: x["p"] * F.log2(x["p"] / F.coalesce(letter_baseline(lang, x["ch"]), F.lit(LETTER_FLOOR)))
    return F.greatest(F.lit(0.0), F.aggregate(letter_shares(text), F.lit(0.0), lambda a, x: a + term(x)))


def odd_letters(text: Column, lang: Column) -> Column:
    """Letters outside the baseline that add more than 0.15 to the divergence."""
    big = lambda x: x["p"] * F.log2(x["p"] / LETTER_FLOOR) > 0.15
    return F.transform(F.filter(letter_shares(text), lambda x: letter_baseline(lang, x["ch"]).isNull() & big(x)), lambda x: x["ch"])


def mojibake_hits(text: Column) -> Column:
    """Signatures of wrongly decoded text in order, then control and format characters as U+XXXX."""
    found = F.regexp_extract_all(nz(text), F.lit(f"({MOJIBAKE})"), F.lit(1))
    control = F.regexp_extract_all(nz(text), F.lit(f"({CONTROL})"), F.lit(1))
    point = lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.expr("0") + F.ascii(c)), 4, "0"))
    return F.concat(found, F.transform(control, point))


def normalize(text: Column) -> Column:
    """Stripped, lower-cased, white space runs as one space."""
    return F.regexp_replace(F.lower(strip(text)), rf"{SPACE}+", " ")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces."""
    last = lambda t: F.size(t) - n + 1
    at = lambda t: F.when(last(t) >= 1, F.sequence(F.lit(1), last(t))).otherwise(F.expr("cast(array() as array<int>)"))
    return let(tokens, lambda t: F.transform(at(t), lambda i: F.array_join(F.slice(t, i, n), " ")))


def trigram_repetition(text: Column) -> Column:
    return let(ngrams(word_tokens(F.lower(nz(text))), 3), lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0))


def text_recall(page: Column, other: Column) -> Column:
    """Share of a page's distinct words that another text has; null if there is too little to judge."""
    mine = F.array_distinct(word_tokens(F.lower(nz(page))))
    theirs = F.array_distinct(word_tokens(F.lower(nz(other))))
    judged = ~is_blank(other) & (F.size(mine) >= 10) & (F.size(theirs) > 0)
    return F.when(judged, F.size(F.array_intersect(mine, theirs)) / F.size(mine))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    ref, hyp = normalize(reference), normalize(hypothesis)
    return F.when((ref != "") & ~is_blank(hypothesis), F.levenshtein(ref, hyp) / F.length(ref))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over words: each distinct word of the two becomes one private character."""
    sides = F.struct(F.split(normalize(reference), " ").alias("ref"), F.split(normalize(hypothesis), " ").alias("hyp"))
    one = lambda both, w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(both, w) + 0x10000), 8, "0")), "UTF-32")
    coded = lambda both, words: F.array_join(F.transform(words, lambda w: one(both, w)), "")
    rate = let(sides, lambda s: let(F.array_distinct(F.concat(s["ref"], s["hyp"])), lambda both: F.levenshtein(coded(both, s["ref"]), coded(both, s["hyp"])) / F.size(s["ref"])))
    return F.when((normalize(reference) != "") & ~is_blank(hypothesis), rate)


def bracket_defects(text: Column) -> Column:
    """Closers without their opener, openers left over, and one for an odd number of double quotes.  A stack folds over
    the brackets alone, as a string whose last character is the innermost open one."""
    marks = F.regexp_extract_all(nz(text), F.lit(r"([()\[\]{}])"), F.lit(1))
    opener = lambda c: F.translate(c, ")]}", "([{")
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("bad"))

    def step(s, c):
        is_open = c.isin("(", "[", "{")
        fits = F.substring(s["open"], -1, 1) == opener(c)
        kept = F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)
        return F.struct(
            F.when(is_open, F.concat(s["open"], c)).when(fits & (F.length(s["open"]) > 0), kept).otherwise(s["open"]).alias("open"),
            F.when(is_open | (fits & (F.length(s["open"]) > 0)), s["bad"]).otherwise(s["bad"] + 1).alias("bad"),
        )

    left = F.aggregate(marks, start, step, lambda s: s["bad"] + F.length(s["open"]))
    return left + F.regexp_count(nz(text), F.lit('"')) % 2


def expected_band(n: Column) -> tuple[Column, Column]:
    """Type-token ratios that natural prose of n words has."""
    center = clamp(1.6 / F.sqrt(n.cast("double")) + 0.30, 0.35, 0.95)
    low, high = F.greatest(F.lit(0.20), center - 0.22), F.least(F.lit(0.99), center + 0.20)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(1.0)


def lexical_score(ratio: Column) -> Column:
    mid, low = (ratio - 0.80) / 0.15 * 40 + 60, (ratio - 0.60) / 0.20 * 60
    return F.when(ratio >= 0.95, 100.0).when(ratio <= 0.60, 0.0).when(ratio >= 0.80, mid).otherwise(low)


def is_alnum_confusion(token: Column) -> Column:
    """A letter next to a digit in a token of four characters or more that is no number, address or mail."""
    near = token.rlike(r"[A-Za-zÀ-ÿ][0-9]|[0-9][A-Za-zÀ-ÿ]")
    return ~is_numbery(token) & ~is_url_or_email(token) & near & (F.length(token) >= 4)


def language_by_stopwords(text: Column) -> Column:
    """The language whose stopwords fill the largest share of a text of 20 characters or more; null if none occurs."""
    from ..constants import STOPWORDS

    words = word_tokens(F.lower(F.substring(strip(text), 1, 2000)))
    share = {k: F.size(F.filter(words, lambda w, k=k: w.isin(v))) for k, v in STOPWORDS.items()}
    order = sorted(share)
    best = F.greatest(*[share[k] for k in order])
    pick = F.lit(None).cast("string")
    for k in reversed(order):
        pick = F.when(share[k] == best, k).otherwise(pick)
    return F.when((F.length(strip(text)) >= 20) & (best > 0), pick)


def strip_html(html: Column) -> Column:
    """Readable text: breaks become lines, tags spaces, and a few entities are decoded (ampersand first)."""
    text = F.regexp_replace(nz(html), r"<[^>]+>", " ")
    for name, value in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')):
        text = F.replace(text, F.lit(name), F.lit(value))
    text = F.regexp_replace(text, "[ \t\u00a0]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
