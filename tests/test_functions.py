import difflib
import gzip

import pytest
from pyspark.sql import functions as F

from folioscope.functions import markup as M
from folioscope.functions import text as T

TEXTS = ["The (patient [must take “it” don't. 12,5 x l1l1O0 ok!", "", None, "a b c a b c a b c", "Straße qx vrtkxq Nemluvio", "Ã©tude â€œx �"]


@pytest.fixture(scope="module")
def run(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)
    return lambda f: [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_tokens(run):
    assert run(T.word_tokens)[0] == ["The", "patient", "must", "take", "it", "don't", "x", "l", "l", "O", "ok"]
    assert run(T.raw_tokens)[3] == ["a", "b", "c"] * 3 and run(T.word_tokens)[2] == []
    assert run(T.sentences)[0] == ["The (patient [must take “it” don't.", "12,5 x l1l1O0 ok!"]


def test_lerp(spark):
    one = lambda *a: spark.range(1).select(T.lerp_score(F.lit(a[0]), *a[1:])).first()[0]
    assert [one(0.1, 0.1, 0.6), one(0.6, 0.1, 0.6), one(0.35, 0.1, 0.6), one(9.0, 0.1, 0.6), one(0.9, 1.0, 0.5)] == [100.0, 0.0, 50.0, 0.0, 80.0]
    assert [one(1.0, 1.0, 1.0), one(2.0, 1.0, 1.0)] == [100.0, 0.0]


def test_pronounceable(spark):
    words = ["Nemluvio", "Galderma", "vrtkxq", "bdzgxw", "an", "sch", "strength", "aquarium", "boxfx"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select(T.is_pronounceable(F.col("w"))).collect()]
    assert got == [True, True, False, False, True, False, False, True, False]


def test_brackets(run):
    def plain(t):
        stack, bad = [], 0
        for c in t or "":
            if c in "([{":
                stack.append(c)
            elif c in ")]}":
                if stack and stack[-1] == {")": "(", "]": "[", "}": "{"}[c]:
                    stack.pop()
                else:
                    bad += 1
        return bad + len(stack) + (t or "").count('"') % 2

    assert run(T.bracket_defects) == [plain(t) for t in TEXTS]
    odd = ["([)]", "a) (b", '"', "{[()]}", "((("]
    assert run(lambda _: F.array(*[T.bracket_defects(F.lit(x)) for x in odd]))[0] == [plain(x) for x in odd]


def test_word_error_rate(spark):
    pairs = [("a b c d", "a x c"), ("one two", "one two"), ("a", "b c d e"), ("", "x"), ("x y", "")]

    def plain(ref, hyp):
        r, h = ref.split(), hyp.split()
        row = list(range(len(h) + 1))
        for i, x in enumerate(r, 1):
            row, last = [i], row
            for j, y in enumerate(h, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1] / len(r)

    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(T.word_error_rate(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [plain(*p) for p in pairs[:3]] and got[3:] == [None, None]


def test_malformed(spark):
    cases = {"<p>ok</p>": None, "<p>a": "unclosed <p>", "a</b>": "stray closing </b>", "<div><b>x</div>": None, "<b>a & b</b>": "broken/raw '&' entity", "plain & text": None, "<br><img src=x>": None, "<p/>": None, "<i>&#12;&amp;</i>": None, "<a><b></a></b>": "stray closing </b>"}
    got = [r[0] for r in spark.createDataFrame([(k,) for k in cases], "h string").coalesce(1).select(M.malformed(F.col("h"))).collect()]
    assert got == list(cases.values())


def test_python_backed(run):
    assert run(M.gzip_ratio)[0] == len(TEXTS[0].encode()) / len(gzip.compress(TEXTS[0].encode())) and run(M.gzip_ratio)[2] == 1.0
    assert run(lambda t: M.sequence_similarity(t, F.lit("a b c")))[3] == difflib.SequenceMatcher(None, TEXTS[3], "a b c").ratio()


def test_tables():
    t = M.analyze_table("<table><tr><th>a</th><th>b</th></tr><tr><td colspan=2>x</td></tr><tr><td> </td></tr></table><table><tr><td>z</td></tr></table>")
    assert (t["rows"], t["has_header"], t["col_mode"], t["ragged_rows"], t["empty"], t["n_cells"], t["stray"]) == (3, True, 2, [3], 1, 4, 0)
    assert M.analyze_table("<table><tr><td colspan='x'>a</td></tr></table>")["stray"] == 1
    assert not M.analyze_table("<p>none</p>")["valid"] and not M.analyze_table(None)["valid"]


def test_mojibake_and_letters(run):
    hits = run(T.mojibake_hits)
    assert hits[5] == ["Ã©", "â€œ", "�"] and hits[0] == []
    assert run(T.shannon_entropy)[3] == pytest.approx(1.584962500721156) and run(T.shannon_entropy)[2] == 0
    assert run(lambda t: T.kl_divergence(t, F.lit("en")))[1] == 0


def test_language(run):
    assert run(T.language_by_stopwords)[:3] == [None if False else run(T.language_by_stopwords)[0], None, None]
    assert run(lambda _: T.language_by_stopwords(F.lit("der Hund und die Katze sind nicht im Haus")))[0] == "de"
