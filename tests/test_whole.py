"""Queries without SQL over whole tables, against brute force."""

import difflib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import context as C
from folioscope.operators.pages import from_texts, with_text


def test_word_recall_of_every_document_and_item(spark, tmp_path):
    from folioscope.plans import text_queries as Q

    texts = ["one two three four five six seven eight nine ten eleven", "One, two! three", "", None, "ten nine eight seven six five four three two one zero"]
    docs = [(i, texts[i % 5]) for i in range(1, 12)] + [(None, texts[0])]
    items = [(3, texts[0]), (4, texts[4] + " more"), (5, "too few words"), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def recall(item, doc):
        mine, theirs = (set(re.findall("[a-z]+", (t or "").lower())) for t in (item, doc))
        return round(len(mine & theirs) / len(mine), 6) if len(mine) >= 10 and theirs else None

    want = sorted(((i, k, recall(t, x)) for i, x in docs for k, t in items), key=str)
    assert sorted(map(tuple, Q.word_recall(spark, str(tmp_path)).collect()), key=str) == want


def test_word_recall_looks_words_up_once_and_in_tiles_of_items(spark, tmp_path, monkeypatch):
    from folioscope.plans import text_queries as Q

    monkeypatch.setattr(Q, "TILE_ITEMS", 3)
    monkeypatch.setattr(Q, "TILE_WORDS", 40)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = [x + y for x in letters for y in letters]
    docs = [(i if i % 7 else None, " ".join(word[(i * k * 13) % 676] for k in range(1, 3 * i))) for i in range(40)]
    items = [(k if k % 5 else None, " ".join(word[(k * j) % 676] for j in range(5 * k))) for k in range(20)] + [(1, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = []
    for i, x in docs:
        for k, t in items:
            mine, theirs = set(t.split()), set(x.split())
            want.append((i, k, round(len(mine & theirs) / len(mine), 6) if len(mine) >= 10 and theirs else None))
    found = Q.word_recall(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert [t.split(":")[1].split()[0] for t in map(str, found.schema.simpleString()[7:-1].split(","))] == ["bigint", "int", "double"]
    # a document's words are not intersected with each item's
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "Join" not in plan


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_of_every_turn(spark, tmp_path):
    from folioscope.plans import text_queries as Q

    turns = [("a", 0, "yes"), ("a", 1, "the end"), ("b", 0, "a sentence of some length here " * 30), ("b", 1, "see the tree by the lake " * 30), ("c", 0, None), ("c", 1, "")]
    spark.createDataFrame([(*t[:2], "user", t[2]) for t in turns], "conv_id string, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for i, k, t in turns:
        ref = " ".join((t or "").split())
        hyp = " ".join(((t or "").replace("e", "3") + (" extra word" if k % 2 else "")).split())
        want[i, k + 1] = (round(levenshtein(ref, hyp) / len(ref), 6), round(levenshtein(ref.split(), hyp.split()) / len(ref.split()), 6)) if ref else (None, None)
    assert {(r.doc_id, r.page_no): (r.cer, r.wer) for r in Q.error_rates(spark, str(tmp_path)).collect()} == want


def test_html_similarity_of_whole_pages(spark, tmp_path):
    from folioscope.plans import text_queries as Q

    pages = [(1, "<p>the tree</p>"), (2, "<p>" + "word see " * 900 + "</p><b>tail zq</b>"), (3, None), (4, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = {}
    for i, h in pages:
        t = " ".join(re.sub("<[^>]+>", " ", h or "").split())
        want[i] = round(difflib.SequenceMatcher(None, t, t.replace("e", "3")).ratio(), 6) if t else None
    assert {r.page_id: r.ratio for r in Q.html_similarity(spark, str(tmp_path)).collect()} == want


def test_unknown_words_by_broadcast_and_by_salted_joins(spark, monkeypatch):
    from folioscope.operators import context as C
    from folioscope.operators.pages import from_texts, with_text

    rows = [("a", k, "the cat and the zzkrt sat on the mat" if k % 2 else "the the qwrtz le chat", "en" if k % 3 else "fr") for k in range(1, 9)]
    pages = with_text(from_texts(spark.createDataFrame(rows, "doc_id string, page_no int, text string, language string")))
    lexicon = spark.createDataFrame([("en", w) for w in "the cat and sat on mat".split()] + [("fr", "le"), ("fr", "chat")], "lang string, token string")
    found = []
    for limit in (500_000, 1):
        monkeypatch.setattr(C, "BROADCAST_WORDS", limit)
        found.append(sorted((r.page_no, r.n_countable, r.n_bad, [(b.token, b.n) for b in r.bad]) for r in C.invalid_tokens(pages, lexicon).collect()))
    assert found[0] == found[1] and found[0][0] == (1, 9, 1, [("zzkrt", 1)])
    assert [x[2] for x in found[0]] == [1, 3, 1, 3, 1, 1, 1, 3]


def test_large_lexicons_are_not_broadcast_whole(spark, monkeypatch):
    from folioscope.operators import context as C
    from folioscope.operators.pages import from_texts, with_text

    rare = [f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(60)]
    rows = [("a", k, "the cat sat zzkrt " + " ".join(rare[k % 3 :: 3]) + f" q{chr(97 + k)}zrt", "en" if k % 4 else "fr") for k in range(1, 25)]
    pages = with_text(from_texts(spark.createDataFrame(rows, "doc_id string, page_no int, text string, language string")))
    lexicon = C.default_lexicon(pages)
    monkeypatch.setattr(C, "RARE", 20)
    found = []
    for limit, given in ((500_000, lexicon), (1, lexicon), (1, lexicon.drop("n"))):
        monkeypatch.setattr(C, "BROADCAST_WORDS", limit)
        bad = C.invalid_tokens(pages, given)
        found.append(sorted((r.page_no, r.n_countable, r.n_bad, r.n_gibberish, [(b.token, b.n) for b in r.bad]) for r in bad.collect()))
        if limit == 1:  # the file is far below the size that Spark broadcasts by itself
            assert "SortMergeJoin" in bad._jdf.queryExecution().executedPlan().toString()
    assert found[0] == found[1] == found[2] and len(found[0]) == 24
    assert all(x[2] for x in found[0])


@pytest.mark.parametrize("entries", [1 << 20, 1])
def test_fluency_shuffles_texts_not_trigrams(spark, monkeypatch, entries):
    """F2: a document of many chunks is scored by the counts of all its pages, without a row a trigram; odd pages included."""
    rows = [("a", k, f"Page {k} says so. It ends {'x' * (k % 7)} here! Ünïcode 漢字 {k % 5}?") for k in range(1, 2 * C.CHUNK + 9)]
    rows += [("b", 1, "One short page."), ("b", 2, " \n"), ("b", 3, None), (None, 1, "No document at all.")]
    plans, write = [], C.held
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "MODEL_ENTRIES", entries, raising=False)
    monkeypatch.setattr(C, "held", lambda df, name: plans.append(text(df)) or write(df, name))
    per, bounds = C.page_fluency(with_text(from_texts(spark.createDataFrame(rows, "doc_id string, page_no int, text string"))))
    found = {(r.doc_id, r.page_no): r for r in per.collect()}
    assert not any("Generate" in p for p in [*plans, text(per), text(bounds)])
    tri = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]
    ready = lambda t: " " + " ".join(t.lower().split()) + " "
    c3 = Counter(g for d, _, t in rows if d == "a" for g in tri(ready(t)))
    c2, v = Counter(), len({ch for g in c3 for ch in g})
    for g, n in c3.items():
        c2[g[:2]] += n
    bits = lambda t: sum(-math.log2((c3[g] + 0.1) / (c2[g[:2]] + 0.1 * v)) for g in tri(ready(t))) / len(tri(ready(t)))
    assert set(found) == {(d, k) for d, k, t in rows if t and t.strip()}
    for d, k, t in rows:
        if d == "a":
            assert found[d, k].surprisal == pytest.approx(bits(t), abs=1e-9)
            units = [s for s in re.split(r"(?<=[.!?])\s+", t) if s]
            worst = sorted((-bits(s), i) for i, s in enumerate(units))[:3]
            assert [(w.pos, w.sentence) for w in found[d, k].worst] == [(i, units[i]) for _, i in worst]
            assert [w.bits for w in found[d, k].worst] == pytest.approx([-b for b, _ in worst], abs=1e-9)
    assert {r.doc_id for r in bounds.collect()} == {"a", "b"}


def test_top_ngram_of_a_page_is_that_of_rows(spark):
    """the run of words is found within the page as it was by a row a run."""
    texts = ["a b c a b c a b", "x y z", "", None, "One two, one two. ONE two one", "d e f g", "q q q q q q"]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, page_no int, text string")
    pages = with_text(from_texts(rows))
    by_rows = {r.page_no: (r.top_ngram, r.top_count) for r in C.top_ngrams(pages, 2).collect()}
    own = {r.page_no: r.t and tuple(r.t) for r in pages.select("page_no", C.top_ngram(F.col("prose"), 2).alias("t")).collect()}
    assert {k: v for k, v in own.items() if v} == by_rows and len(by_rows) == 5
