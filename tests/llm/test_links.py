"""Near-duplicate links, components, exact search and extraction."""

import itertools
import random

import numpy as np
import pytest

from folioscope.llm import html_extract, neardup_vectors, simhash, topk
from folioscope.llm.components import components


def labels_of(nodes, links):
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(best[a], best[b])
            changed |= best[a] != m or best[b] != m
            best[a] = best[b] = m
    return best


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(500, 500)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = labels_of(nodes, [x for x in links if x[0] != x[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_triples_cover_any_four_positions():
    assert len(simhash.TRIPLES) == 20 and all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in itertools.combinations(range(8), 4))


@pytest.mark.parametrize("tile", [8192, 5])
def test_simhash_links_join_what_all_links_join(spark, tile):
    r = random.Random(5)
    values = [r.getrandbits(64) for _ in range(60)]
    values += [values[0] ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))) for _ in range(80)]
    values = sorted(set(values))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    found = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), 4, tile).collect()
    every = [(a, b) for a, b in itertools.combinations(map(signed, values), 2) if ((a ^ b) % 2**64).bit_count() <= 4]
    nodes = list(map(signed, values))
    assert labels_of(nodes, [(x.a, x.b) for x in found]) == labels_of(nodes, every)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        rows.append((k, rng.normal(size=64).astype(np.float32).tolist(), int(k % 3)))
    for k in range(40):  # near copies of one vector, in its label and in another
        v = np.array(rows[0][1]) + rng.normal(size=64) * 0.08
        rows.append((400 + k, v.astype(np.float32).tolist(), 0 if k % 4 else 1))
    rows += [(500 + k, rows[5][1], 2) for k in range(5)]
    rows += [(600, None, 0), (601, [0.0] * 64, 0), (602, [None] + [1.0] * 63, 0), (603, [float("nan")] + [1.0] * 63, 0), (604, rows[5][1], None), (605, [], 1), (606, [float("inf")] * 64, 1), (607, [1.0, 2.0], 2), (608, [2.0, 4.0], 2)]
    rows.append(rows[7])
    return rows


def brute_links(rows):
    good = []
    for i, (_, v, lab) in enumerate(rows):
        if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float)
            good.append((i, lab, x / np.linalg.norm(x)))
    return [(i, j) for (i, la, x), (j, lb, y) in itertools.combinations(good, 2) if la == lb and len(x) == len(y) and x @ y >= 0.98]


@pytest.mark.parametrize("tile", [1024, 7])
def test_vector_near_duplicates(spark, vectors, tile):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = neardup_vectors.near_duplicates(df, tile=tile).collect()
    links = brute_links(vectors)
    count = [0] * len(vectors)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    ids = [v[0] for v in vectors]
    comp = labels_of(set(ids), [(ids[i], ids[j]) for i, j in links])
    want = sorted((ids[i], count[i], comp[ids[i]], comp[ids[i]] == ids[i]) for i in range(len(ids)))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert neardup_vectors.near_duplicates(df.limit(0)).count() == 0


def test_filter_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    n = 600
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.normal(size=(n, 64))
    w -= (w * x).sum(axis=1, keepdims=True) * x
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * w
    for base in (64, 512, 2048, 4096, 16384):
        a, b = neardup_vectors.decode(x, base), neardup_vectors.decode(y, base)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) > 0.995


def test_decode_lists_exactly_the_exceeding_filters():
    rotation, words, alpha = neardup_vectors.code(64, 64)
    x = np.random.default_rng(1).normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = x @ rotation
    for row, got in zip(t, neardup_vectors.decode(x, 64), strict=True):
        all_sums = (words[0] @ row[:32])[:, None] + words[1] @ row[32:]
        at = alpha
        while (all_sums >= at).sum() < neardup_vectors.LEAST:
            at -= 0.01
        assert sorted(got) == np.flatnonzero(all_sums.ravel() >= at).tolist()


def test_vectors_of_one_id_or_none_stay_apart(spark):
    """Rows of an id are judged by their own vectors; no row is lost or doubled; columns of clashing names are ignored."""
    r = np.random.default_rng(3)
    a, b, c = (r.normal(size=64).tolist() for _ in range(3))
    near = lambda v: (np.array(v) + r.normal(size=64) * 0.01).tolist()
    rows = [(1, a, 0), (1, b, 0), (1, a, 1), (2, near(a), 0), (3, near(b), 0), (3, near(b), 1), (None, near(c), 0), (None, c, 0), (None, near(a), 0), (None, b, 5), (9, c, 0)]
    df = spark.createDataFrame([(*x, 7, "z", 1) for x in rows], "vec_id long, embedding array<double>, label int, rep int, key string, n int")
    got = sorted((-1 if x.vec_id is None else x.vec_id, x.n_links, -1 if x.component_id is None else x.component_id) for x in neardup_vectors.near_duplicates(df).collect())
    want = [(1, 2, 1), (1, 1, 1), (1, 0, 1), (2, 2, 1), (3, 1, 1), (3, 0, 3), (-1, 2, 9), (-1, 2, 9), (-1, 2, 1), (-1, 0, -1), (9, 2, 9)]
    assert got == sorted(want)


def test_components_of_a_star_go_by_broadcast(spark):
    links = [(0, k) for k in range(1, 1500)] + [(k, 5000 + k) for k in range(1, 1500)] + [(9000, 9001)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 3001 and sum(v == 0 for v in got.values()) == 2999 and got[9001] == got[9000] == 9000


@pytest.mark.parametrize("block", [4096, 9])
def test_top_k(spark, vectors, block):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, block=block, most_queries=3).collect()
    ok = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, _ in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in {i: v for i, v in ok if i % 50 == 0}.items():
        scores = sorted((-int(x @ y), j) for j, y in ok if j != q and len(y) == len(x))[:5]
        want |= {(q, k + 1, j, -s) for k, (s, j) in enumerate(scores)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df.where("vec_id = 50"), df.limit(0)).count() == 0


def test_top_k_by_shuffled_parts_huge_components_and_clashing_columns(spark):
    rows = [(0, [1e300, -2.0], 1, 9), (1, [1e17, 5.0], 2, 9), (2, [-1e18, 7.0], 3, 9), (3, [0.0, 0.0], None, 9), (3, [1.0, 1.0], None, 9), (50, [3.0, 4.0], 0, 9), (4, [], 0, 9), (100, [], 0, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, part int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 50 = 0"), df, broadcast=0, most_queries=1).collect()}
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    v = [(i, [clip(int(np.floor(256 * x)) if abs(x) < 1e18 else int(256 * x)) for x in e]) for i, e, _, _ in rows]
    for q, x in v:
        if q % 50 == 0:
            want = sorted((-clip(sum(a * b for a, b in zip(x, y))), j) for j, y in v if j != q and len(y) == len(x))[:5]
            assert [got[q, k + 1] for k in range(len(want))] == [(j, -s) for s, j in want]


def test_elimination_evaluates_few_and_is_exact():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    rows = np.floor(256 * np.array(t["embedding"].to_pylist())).astype(np.int64)
    ids = np.asarray(t["vec_id"])
    asked = np.flatnonzero(ids % 50 == 0)
    pivots = topk.Pivots(rows[:192], rows.shape[1])
    assert len(pivots.points) == 48
    d = pivots.distances(rows)
    assert np.allclose(d[:, 1:] * pivots.scale, np.linalg.norm(rows[:, None, :] - pivots.points[None] * pivots.scale, axis=2), atol=1e-3)
    i, found, score, evaluated = topk.search(ids[asked], rows[asked], ids, rows, pivots, d)
    for j, q in enumerate(asked):
        want = sorted(zip((-(rows @ rows[q])).tolist(), ids.tolist()))
        assert list(zip((-score[i == j]).tolist(), found[i == j].tolist())) == [x for x in want if x[1] != ids[q]][:5]
    assert evaluated < 0.3 * len(asked) * len(rows)


def _energy(cost, edges, side):
    return sum(max(o, 0) if not x else max(-o, 0) for o, x in zip(cost, side)) + sum(w for a, b, w in edges if side[a] != side[b])


def test_whole_pages_are_cut_at_least_cost():
    """Brute force over all labellings of the blocks of whole pages."""
    r = random.Random(5)
    parts = ["<h1>Floods</h1>", "<p>Sh is.</p>", "<p>The river rose in the night, and the town moved its boats.</p>", "<div class=ad>Buy now! It is cheap.</div>", "<ul><li><a href=x>Home</a><li>one thing</ul>", "<aside><h3>More</h3><p>Read on.</p></aside>", "<h2>News</h2>", "<td>x</td>", "<div><div>plain words here</div></div>"]
    changed = 0
    for _ in range(60):
        page = "".join(r.choice(parts) for _ in range(r.randint(2, 8)))
        found = html_extract.blocks(f"<article>{page}</article>" if r.random() < 0.5 else page)[:11]
        cost, edges = html_extract.costs(found), html_extract.smoothness(found)
        side = html_extract.minimum_cut(cost, edges)
        best = min(_energy(cost, edges, x) for x in itertools.product([0, 1], repeat=len(found)))
        assert abs(_energy(cost, edges, side) - best) < 1e-9
        changed += sum((c > 0) != k for c, k in zip(cost, side))
    assert changed > 20


def test_the_flow_decides_on_real_pages(monkeypatch):
    import pyarrow.parquet as pq

    flow, calls = html_extract._flow, []
    monkeypatch.setattr(html_extract, "_flow", lambda *a: calls.append(1) or flow(*a))
    pages, cut, blocks, changed = 0, 0, 0, 0
    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        before = len(calls)
        found = html_extract.blocks(html)
        cost = html_extract.costs(found)
        side = html_extract.minimum_cut(cost, html_extract.smoothness(found))
        text = " ".join(b.text for b, k in zip(found, side) if k)
        article = html_extract.blocks(html[html.index("<article>") : html.index("</article>")])
        assert text == " ".join(b.text for b in article)
        pages, cut, blocks, changed = pages + 1, cut + (len(calls) > before), blocks + len(found), changed + sum((c > 0) != k for c, k in zip(cost, side))
    assert cut > 0.5 * pages and changed > 0.02 * blocks


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        t = time.time()
        html_extract.main_text("<div><b>" * n + "<p>words in it.</p></i></x>" * 100 + "<li></li><p></p>" * n)
        took.append(time.time() - t)
    assert took[1] < 12 * took[0] + 1


def test_parts_inside_an_article():
    prose = "The river rose in the night and the town moved its boats to the upper meadow, where they stayed until spring. " * 3
    item = "".join(f"<li>thing {k}</li>" for k in range(8))
    page = f'<article><h1>Floods</h1><p>{prose}</p><p class="notice">{prose.upper()}</p><p>{prose}</p><ul>{item}</ul><div class="ad">{prose.upper()}</div><p>{prose}</p><section class="comments"><h2>Comments</h2><div class="comment"><p>{prose.upper()}</p><p>Yes.</p></div></section></article>'
    text = html_extract.main_text(page)
    assert "BOATS" not in text and "Comments" not in text and "Yes." not in text
    assert text.startswith("Floods The river") and "thing 0 thing 1" in text and text.count("upper meadow") == 9


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies. Accept them now, dear reader.</div><nav><ul><li><a href=x>Home</a></ul></nav><div class="sidebar"><p>Popular posts, and more.</p></div>
<main><article><h1>Title &eacute;</h1><p>First   text, <a href=x>a <b>link</b></a>.<div class=ad>Buy now! It is cheap.</div><p>Second<br>line &amp; more.<ul><li>one<li>two</ul></article>
<section id="comments"><p>Nice article, I liked it very much.</p></section></main><form><label>Mail</label></form><!-- x --><footer>&copy; me</footer></body>"""


def test_extraction(spark):
    assert html_extract.main_text(PAGE) == "Title é First text, a link. Second line & more. one two"
    plain = "<div><p>This is a long paragraph of a page without an article. It has two sentences.</p></div><div><a href=q>Next</a></div>"
    assert html_extract.main_text(plain).startswith("This is") and "Next" not in html_extract.main_text(plain)
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<script>x") == ""
    rows = [(1, "u", PAGE, "old", 5), (1, "u", PAGE, "old", 5), (2, None, None, None, None), (3, "u", "<p>" + "Long text here. " * 30_000 + "</p>", "", 1)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and got[3].n_chars == 16 * 30_000 - 1
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_html_names_do_not_silence_an_article():
    prose = "The river rose in the night and the town moved its boats to the upper meadow, where they stayed until spring. " * 3
    for name in ("single no-sidebar", "has-sidebar", "search-results", "comments-open"):
        for at in (f'<html class="{name}"><body>', f'<body id="x" class="{name}">', f'<body><div class="{name if "sidebar" in name else "page"}">'):
            assert html_extract.main_text(f"{at}<p>{prose}</p><p>{prose}</p>").count("upper meadow") == 6, at
    for at in ('<section id="discussion">', '<div id="search-methods">'):
        page = f'<article><h1>Floods</h1><p>{prose}</p>{at}<h2 id="related-work">Earlier floods</h2><p>{prose}</p><p>{prose}</p></section></div></article>'
        text = html_extract.main_text(page)
        assert text.count("upper meadow") == 9 and "Earlier floods" in text
    assert "Earlier floods" in html_extract.main_text(f'<article><p>{prose}</p><h2 id="related-work">Earlier floods</h2><p>{prose}</p></article>')
    links = "".join(f'<li><a href="/{k}">Story {k}</a></li>' for k in range(5))
    page = f'<article><p>{prose}</p><div class="related">{links}</div><div class="comments"><p>Great post!</p></div></article><div class="sidebar"><p>{prose.upper()}</p></div>'
    assert html_extract.main_text(page) == prose.strip()


def test_exploded_rows_are_not_broadcast(spark):
    """Spark sizes an explode as its input: rows of many keys must be joined by shuffle, however small the file they come from."""
    from pyspark.sql import functions as F

    from folioscope.llm.common import join_counted, materialize, sized

    base = materialize(spark.range(300), "exploded-base")
    rows = base.select(F.explode(F.sequence(F.col("id"), F.col("id") + 99)).alias("key"), F.col("id").alias("node"))
    counted = materialize(rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m")), "exploded-counts")
    cold = join_counted(rows, counted, "key", "k", "m", 10**6, most=100)
    hot = join_counted(rows, counted, "key", "k", "m", 100, most=350)
    few = join_counted(rows, counted, "key", "k", "m", 100)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(cold) and "SortMergeJoin" in plan(cold)
    assert "SortMergeJoin" in plan(hot) and "BroadcastHashJoin" in plan(hot)
    assert "SortMergeJoin" not in plan(few)
    for df in (cold, hot, few):
        assert df.agg(F.count("*"), F.sum("m")).first() == rows.join(counted, F.col("key") == F.col("k")).agg(F.count("*"), F.sum("m")).first()
    assert "Broadcast" not in plan(base.join(sized(counted, 398), F.col("id") == F.col("k")))
    assert "BroadcastHashJoin" in plan(base.join(sized(counted, 399), F.col("id") == F.col("k")))
