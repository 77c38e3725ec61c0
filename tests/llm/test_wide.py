import random

import numpy as np
import pytest

from folioscope.llm import simhash, simhash_wide as S

from .conftest import prose
from .test_links import labels_of


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def edited(t, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"x{r.randrange(10**6)}" for w in t.split())


def test_recall_and_precision():
    """Edited copies at similarity 0.85 and above share a posting and verify; unrelated texts do not."""
    bits, hit, n = S.most_bits(), 0, 0
    for k in range(120):
        a = prose(1000 + k, 300)
        b = edited(a, 0.012, k)
        x, y = shingles(a), shingles(b)
        if len(x & y) / len(x | y) < 0.85:
            continue
        f, g = (S.majority(S.shingles(t)).view(np.uint8) for t in (a, b))
        n += 1
        hit += any(f[p] == g[p] and f[q] == g[q] for p, q in S.PAIRS) and np.unpackbits(f ^ g).sum() <= bits
    assert n > 40 and hit / n > 0.93
    far = [S.majority(S.shingles(prose(k, 200))).view(np.uint8) for k in range(60)]
    assert min(np.unpackbits(far[i] ^ far[j]).sum() for i in range(60) for j in range(i)) > 2 * bits


@pytest.mark.parametrize("tile", [8192, 20])
def test_estimated_links_join_what_all_links_join(spark, monkeypatch, tile):
    """The byte-position index against the same test on all pairs, short and long postings, whole and in tiles."""
    monkeypatch.setattr(S.postings.links, "__defaults__", (None, False, tile, 500))
    base = prose(5, 200)
    texts = [prose(i, 150) for i in range(30)] + [edited(base, 0.01, i) for i in range(70)] + [base]
    fp = {S.number(f): f for f in (S.majority(S.shingles(t)) for t in texts)}
    nodes = spark.createDataFrame([(i, *f.view(np.int64).tolist()) for i, f in fp.items()], ["fp", *S.COLUMNS])
    v = {i: f.view(np.uint8) for i, f in fp.items()}
    ok = lambda f, g: any(f[p] == g[p] and f[q] == g[q] for p, q in S.PAIRS) and np.unpackbits(f ^ g).sum() <= S.most_bits() and (f == g).sum() >= S.SHARED
    ids = sorted(v)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if ok(v[a], v[b])]
    found = [(r.a, r.b) for r in S.estimated_links(nodes).collect()]
    assert len(links) > 500 and labels_of(ids, found) == labels_of(ids, links)


def test_edge_cases_of_exact_groups(spark, odd_docs, no_docs):
    kept = simhash.drop_near_copies(odd_docs, S.exact_groups, S.fingerprint)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and ids.count(3) == 1 and ids.count(100) == 0 and ids.count(104) == 1 and ids.count(None) == 1
    assert sum(i in (101, 102, 103) for i in ids) == 1
    assert S.exact_groups(no_docs).count() == 0 and simhash.drop_near_copies(no_docs, S.exact_groups, S.fingerprint).count() == 0


@pytest.mark.parametrize("tile", [4 << 20, 40_000])
def test_exact_groups_join_all_pairs_at_the_similarity(spark, no_docs, monkeypatch, tile):
    """Against true Jaccard similarity of all pairs: pairs just above 0.8 link, pairs just below do not."""
    monkeypatch.setattr(S, "TILE", tile)
    texts, above = [], 0
    for k in range(150):
        a = prose(7000 + k, 100 + 3 * k)
        texts += [(2 * k, a), (2 * k + 1, edited(a, 0.012 + 0.012 * (k % 3), k))]
    base = prose(5, 200)
    texts += [(1000 + i, edited(base, 0.01, i)) for i in range(70)] + [(2000, base), (2001, prose(5, 150)), (2002, None), (2003, " "), (2004, "a b c"), (2005, "A b  c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.exact_groups(docs).collect()}
    sets = {i: shingles(t.lower()) or {tuple(t.lower().split())} if t else {()} for i, t in texts}
    ids, pairs = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                pairs.append((a, b))
                above += both < 0.83 * len(sets[a] | sets[b])
    assert above > 20 and got == labels_of(ids, pairs)
    assert S.exact_groups(no_docs).count() == 0
