"""Operators that look at each text: classifiers, language model, packing, files, mixing."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import block_coder, lm, mixing, packing, quality, range_coder, simhash, subwords, token_files, tokens, toxicity
from folioscope.llm.common import split_words


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_split_words():
    texts = [" a  b\n", None, "", "c\x0bd e", "\t"]
    flat, off = split_words(pa.array(texts))
    assert [flat[off[i] : off[i + 1]].to_pylist() for i in range(len(texts))] == [words(t) for t in texts]


def test_windows_are_ngrams():
    cp, starts = subwords.codepoints(pa.array(["abc", "", "é\x02"]), 1, 1)
    h, w = subwords.windows(cp, starts, 3)
    assert w.tolist() == [0, 0, 0, 2, 2] and len(set(h.tolist())) == 5
    assert subwords.windows(cp[:1], np.array([0, 1]), 3)[0].size == 0


@pytest.mark.parametrize("op,label,mod,held", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifier_learns_and_is_whole(spark, op, label, mod, held):
    """Separable texts: held-out ones are told apart; every row is scored."""
    good, bad = "the river runs by the old stone garden wall", "xqzt!! vrkk!! wpfq!! zzzt!! idiotz!!"
    rows = [(i, (good if i % 2 else bad) + f" w{i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in op.score(docs, op.fit(docs, marks)).collect()}
    want = {i: y if label == "quality" else 1 - y for i, _, y in rows}
    out = [i for i in got if crc(i, mod) == held]
    assert len(got) == 200 and len(out) > 10
    assert sum((got[i] >= 0.3) == bool(want[i]) for i in out) / len(out) > 0.95


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifier_edges(spark, odd_docs, no_docs, labels, op):
    model = op.fit(odd_docs, labels)
    got = op.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert op.score(no_docs, model).count() == 0
    unlabelled = op.fit(odd_docs, labels.limit(0))
    assert {r.score for r in op.score(odd_docs, unlabelled).collect()} == ({0.5} if op is quality else {0.0})
    keep = quality.classify if op is quality else toxicity.keep_clean
    kept = keep(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum((r.score >= 0.3) == (op is quality) for r in got)


def test_held_out_labels_are_not_used(spark, labels, odd_docs):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(odd_docs, x) for x in (labels, flipped))
    assert np.allclose(a.weight, b.weight) and a.bias == b.bias


def brute_kneser_ney(classes):
    """Log ratio (second class to first) of every seen 5-gram and of every seen context, with dictionaries of strings."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    grams = [{n: collections.Counter() for n in range(1, order + 1)} for _ in classes]
    for found, texts in zip(grams, classes):
        for w in " ".join(texts).split():
            p = "\x01" * (order - 1) + w + "\x02"
            for n in range(1, order + 1):
                found[n].update(p[i : i + n] for i in range(len(p) - n + 1))
    shared = {}
    for n in range(1, order):
        kinds = collections.Counter(g[1:] for g in set(grams[0][n + 1]) | set(grams[1][n + 1]))
        if n == 1:
            total, t = sum(kinds.values()), len(kinds)
            shared[1] = {g: (max(c - d, 0) + d * t / (t + 1)) / total for g, c in kinds.items()}
            continue
        every = set(grams[0][n]) | set(grams[1][n])
        mass, kept = collections.Counter(), collections.Counter()
        for g in every:
            mass[g[:-1]] += kinds[g]
            kept[g[:-1]] += kinds[g] > 0
        shared[n] = {}
        for g in every:
            m = max(mass[g[:-1]], 1e-9)
            below = shared[n - 1].get(g[1:], 1e-6)
            shared[n][g] = max(max(kinds[g] - d, 0) / m + min(d * kept[g[:-1]] / m, 1) * below, 1e-12)
    every = sorted(set(grams[0][order]) | set(grams[1][order]))
    logs, backoffs = [], []
    for found in grams:
        count, mass = found[order], collections.Counter()
        for g, c in count.items():
            mass[g[:-1]] += c
        lam = {h: d * sum(g[:-1] == h for g in count) / mass[h] if mass[h] else 1.0 for h in {g[:-1] for g in every}}
        for h, m in mass.items():  # what is discounted is what backs off: a distribution
            assert abs(sum(max(c - d, 0) for g, c in count.items() if g[:-1] == h) / m + lam[h] - 1) < 1e-9
        logs.append({g: math.log(max(count[g] - d, 0) / max(mass[g[:-1]], 1) + lam[g[:-1]] * shared[order - 1].get(g[1:], 1e-6)) for g in every})
        backoffs.append({h: math.log(x) for h, x in lam.items()})
    return {g: logs[1][g] - logs[0][g] for g in every}, {h: backoffs[1][h] - backoffs[0][h] for h in backoffs[0]}


def test_kneser_ney_against_dictionaries():
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 6))) for _ in range(60)) for _ in range(4)]
    classes = texts[:2], [*texts[2:], texts[0][:40]]
    want_gram, want_context = brute_kneser_ney(classes)
    gram, context = toxicity.kneser_ney(*[toxicity.grams_of(pa.array(x)) for x in classes])
    seen = 0
    for w in sorted({w for x in classes for t in x for w in t.split()}):
        cp, starts = subwords.codepoints(pa.array([w]), toxicity.ORDER - 1, 1)
        p = "\x01" * (toxicity.ORDER - 1) + w + "\x02"
        for table, wanted, n in ((gram, want_gram, toxicity.ORDER), (context, want_context, toxicity.ORDER - 1)):
            keys, _ = subwords.windows(cp, starts, n)
            for i, got in enumerate(table.get(keys, math.nan)):
                if p[i : i + n] in wanted:
                    assert abs(got - wanted[p[i : i + n]]) < 1e-9
                    seen += 1
    assert seen > 300 and len(gram.key) == len(want_gram) and len(context.key) == len(want_context)


@pytest.mark.parametrize("op,label,precision,recall", [(quality.op1_quality, "quality", 0.97, 0.97), (toxicity.op10_toxicity, "toxic", 0.8, 0.65)])
def test_held_out_quality_on_real_labels(spark, op, label, precision, recall):
    d = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{d}/labels.parquet").where(f"{label} is not null").selectExpr("doc_id", f"{label} as y")
    rows = op(spark, d).where("held_out").join(truth, "doc_id").select("predicted", "y").collect()
    hit = sum(r.predicted and r.y for r in rows)
    assert len(rows) > 500 and hit / sum(r.predicted for r in rows) > precision and hit / sum(r.y for r in rows) > recall


def brute_lm(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    uni = collections.Counter()
    for i, t in rows:
        if crc(i, 7) != 2:
            uni.update([*words(low(t)), None])
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, t in rows:
        toks = [*words(low(t)), None]
        out[i, t] = (len(toks), sum(uni[w] > 0 for w in toks), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in toks))
    return out


def test_lm(spark, odd_docs, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = collections.Counter((i, *[round(x, 5) for x in v]) for (i, _), v in ((k, brute_lm(rows)[k]) for k in rows))
    got = lm.score(odd_docs).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.held_out == (crc(r.doc_id, 7) == 2) and math.isfinite(r.score) and r.score <= 0 for r in got)
    monkeypatch.setattr(lm, "CHUNK", 5000)
    monkeypatch.setattr(lm, "BUCKET_KEYS", 3000)
    again = {(r.doc_id, r.n_tokens): r.score for r in lm.score(odd_docs).collect()}
    assert all(abs(again[r.doc_id, r.n_tokens] - r.score) < 1e-6 * abs(r.score) + 1e-9 for r in got)
    assert lm.score(no_docs).count() == 0


def test_lm_score_against_dictionaries(spark, odd_docs, monkeypatch):
    """Probabilities with the learned weights, from plain counts; over all words and the unknown they sum to one."""
    learned, learn = [], lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: learned.append(learn(*a)) or learned[-1])
    low = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    extra = [(2000 + k, " ".join(random.Random(k).choice("abcdef") for _ in range(30))) for k in range(60)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in lm.score(docs).collect())
    uni, pair = collections.Counter(), collections.Counter()
    for i, t in rows:
        if crc(i, 7) != 2:
            toks = [*low(t), "</end>"]
            uni.update(toks)
            pair.update(zip(["<start>", *toks], toks))
    uni["<start>"] = uni["</end>"]  # as contexts
    n, v = sum(c for w, c in uni.items() if w != "<start>"), len(uni) - 1
    weights = learned[0]

    def p(h, w):
        l2, l1, l0 = weights[min(1 + int(math.log2(uni[h])), lm.LEVELS - 1) if uni[h] else 0]
        return l2 * pair[h, w] / max(uni[h], 1) + l1 * (uni[w] if w != "<start>" else 0) / n + l0 / (v + 1)

    score = lambda toks: sum(math.log10(p(h, w)) for h, w in zip(["<start>", *toks], toks))
    want = sorted((str(i), round(score([*low(t), "</end>"]), 6)) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-5 * abs(b) + 1e-5 for (_, a), (_, b) in zip(got, want))
    for h in ["<start>", "a", "b", *list(uni)[:20]]:
        assert abs(sum(p(h, w) for w in uni if w != "<start>") + p(h, "never seen") - 1) < 1e-9


def test_em_finds_the_mixture():
    import pandas as pd

    cells = pd.DataFrame({"level": [3, 3], "two": [-4, 10_000], "one": [-40, -40], "n": [70, 30]})
    w = lm.learn(cells, 1e-6)
    assert w.shape == (lm.LEVELS, 3) and abs(w[3][0] - 0.7) < 0.02 and np.allclose(w.sum(axis=1), 1)


def test_mixing(spark, odd_docs, no_docs):
    p = mixing.plan(odd_docs)
    rows = p.collect()
    text = {}
    for r in odd_docs.collect():
        text.setdefault(r.doc_id, []).append(r)
    size = collections.Counter()
    for r in odd_docs.collect():
        size[r.source] += len(words(r.text))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, budget = {}, set(order), 1.5 * sum(size.values())
    while left:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if 2 * size[s] <= level * weight[s]]
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= set(over)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
    assert len(rows) == odd_docs.count() and sorted(p.collect(), key=str) == sorted(rows, key=str)
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mixing_meets_targets(spark):
    docs = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text")).withColumnRenamed("id", "doc_id")
    got = mixing.plan(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("k")).collect()
    assert all(abs(r.k - r.t) <= 0.08 * r.t for r in got)


def test_letter_strings_are_encoded_once_a_process_up_to_a_bound(monkeypatch):
    from folioscope.llm import tokens

    path = tokens.default_path()
    tokenizer, _ = tokens.load(path)
    encoded, encode = [], tokens._encode_letters
    monkeypatch.setattr(tokens, "_encode_letters", lambda tok, ends, words: (encoded.append(list(words)), encode(tok, ends, words))[1])
    monkeypatch.setattr(tokens, "KNOWN", 6)
    tokens._known.cache_clear()
    batches = [["Zebra zebra! Éclair µm x1 ...", None], ["ZEBRA (éclair) ok", ""], ["one two three four five six seven eight zebra"], ["zebra, Ok ǅ İstanbul ß! 日本."], ["", None]]
    for texts in batches:
        ids, off = tokens.token_ids(pa.array(texts, pa.large_string()), path)
        want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, tokens.END] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    tokens._known.cache_clear()
    # known ones are left out; what passes the bound is encoded and forgotten
    assert encoded[:2] == [["zebra", "éclair", "µm"], ["ok"]]
    assert len(encoded[2]) == 9 and encoded[3] == ["zebra", "ok", "ß"]


def test_token_ids_match_the_tokenizer():
    path = tokens.default_path()
    tokenizer, _ = tokens.load(path)
    texts = ["", None, "  ", "don't I'LL x y éA ́a Σίσυφος 1234 ½ 漢字 'S a's's x\x1cy ok!!! (a) b-c", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "İstanbul ǅ ﬀ a b"]
    ids, off = tokens.token_ids(pa.array(texts), path)
    for i, t in enumerate(texts):
        assert list(ids[off[i] : off[i + 1]]) == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 2047, 2048, 2049, 9000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), rng.zipf(1.3, n) % 49_408, np.zeros(n, dtype=int), np.arange(n) % 7 * 7000):
        data = range_coder.encode(ids.astype(np.uint32))
        assert (range_coder.decode(data) == ids).all()


def test_range_coder_writes_the_same_bytes_from_flat_tables_of_counts_in_floats():
    rng = np.random.default_rng(5)
    # long runs drive counts over the limit; the code is that of the first writer of the format
    ids = np.concatenate([np.zeros(3000, dtype=np.int64), rng.zipf(1.3, 3000) % 500, np.arange(1500) % 7 * 7000]).astype(np.uint32)
    data = range_coder.encode(ids)
    assert (len(data), zlib.crc32(data)) == (3222, 990560473)
    assert (range_coder.decode(data) == ids).all()
    lanes = range_coder.Lanes(3, 10)
    lanes.look(3)
    event = np.array([range_coder.NEW, 0, 5])
    start, wide = lanes.range(3, event)
    assert (start + wide == lanes.upto[np.arange(3), event]).all() and start[1] == 0


def test_range_coder_learns_and_checks():
    ids = (np.arange(20_000) % 50).astype(np.uint32)
    data = range_coder.encode(ids)
    assert len(data) < len(ids) / 2  # 16 bits an id would take twice the number of ids
    broken = bytearray(data)
    broken[-40] ^= 0x55
    with pytest.raises(ValueError):
        range_coder.decode(bytes(broken))
    with pytest.raises(ValueError):
        range_coder.decode(b"x" * 64)


@pytest.mark.parametrize("n", [0, 1, 2, 60, 2049, 5000])
def test_block_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), rng.zipf(1.3, n) % 49_408, np.zeros(n, dtype=int), rng.integers(0, 2**32 - 1, n)):
        ids = ids.astype(np.uint32)
        for stops in (None, rng.random(n) < 0.5, np.zeros(n, dtype=bool)):
            assert (block_coder.decode(block_coder.encode(ids, stops)) == ids).all()


def test_block_coder_takes_a_step_a_word_and_checks():
    path = tokens.default_path()
    text = " ".join(f"thoningin erersh, {w}ndstha. eawhly" for w in "the of and there ndtion".split() * 300)
    ids, _ = tokens.token_ids(pa.array([text, "", "a"]), path)
    stops = tokens.stops(ids, path)
    data = block_coder.encode(ids, stops)
    assert (block_coder.decode(data) == ids).all()
    # a word and its marks are one unit, or units of four ids; the end id ends one
    units, distinct, _, most = block_coder.MORE.unpack_from(data, range_coder.HEADER.size)
    assert most == 4 and units < len(ids) / 2 and distinct < 40
    assert stops[-1] and stops[ids == tokens.END].all()
    assert len(data) < len(range_coder.encode(ids)) and (block_coder.decode(range_coder.encode(ids)) == ids).all()
    for at in (-3, len(data) // 2, 60):
        broken = bytearray(data)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            block_coder.decode(bytes(broken))


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    tokenizer, _ = tokens.load(tokens.default_path())
    path = str(tmp_path / "files")
    token_files.write(odd_docs, path, segment=4000, part_bytes=60_000)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda i: (i is not None, i))
    want = collections.Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in odd_docs.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    digests = {r.start: r.ids_crc32 for r in token_files.read_digests(spark, path).collect()}
    assert all(digests[r.start] == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in got)
    token_files.write(no_docs, str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def check_packing(rows, want, window=2048):
    by_doc = collections.defaultdict(list)
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at < window and at & (at - 1) == 0
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == want


def test_packing(spark, odd_docs, no_docs):
    tokenizer, _ = tokens.load(tokens.default_path())
    want = collections.Counter()
    for r in odd_docs.collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    rows = packing.pack(odd_docs).collect()
    check_packing(rows, want)
    text = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows[:60]:
        ids = tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids[r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(r.ids)
    check_packing(packing.pack(odd_docs, shard=2000).collect(), want)
    assert packing.pack(no_docs).count() == 0


def test_routes_bring_texts_of_shared_words_together(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    texts = [" ".join(["the"] * 20 + [word() for _ in range(20)]) for _ in range(60)]
    texts = [t for t in texts for _ in range(2)]
    r.shuffle(texts)
    docs = spark.createDataFrame([(i, t + (" the end" if i % 2 else "")) for i, t in enumerate(texts)] + [(900, None), (901, "a b")], "doc_id long, text string").repartition(6)
    rows = packing.routed(docs).withColumn("task", F.spark_partition_id()).collect()
    route, place = {}, {}
    for r_ in rows:
        route.setdefault((r_.text or "").replace(" the end", ""), set()).add(r_.route)
        place.setdefault(r_.route, set()).add(r_.task)
    assert len(rows) == 122 and all(len(x) == 1 for x in [*route.values(), *place.values()]) and len(route) == 62


def test_packing_follows_bm25():
    docs = [[0, 1, 2, 3], [9, 8, 7], [0, 1, 2, 5], [9, 8, 6]]
    codes, off = np.array(sum(docs, [])), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    index = packing.Index(codes, off)
    assert index.scores(0)[2] > index.scores(0)[1] == 0
    got = packing.pack_shard(np.array([4, 3, 4, 3]), index, window=8)
    assert [p[0] for p in got if p[3] == 0] == [0, 2]  # the seed's neighbour, not the next document


def test_simhash(spark, odd_docs, no_docs):
    import xxhash

    def plain(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        s = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    small = odd_docs
    rows = [(r.doc_id, plain(r.text)) for r in small.collect()]
    got = simhash.groups(small).collect()
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4 and root(i) != root(j):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = collections.Counter((d, f, least.get(root(i))) for i, (d, f) in enumerate(rows))
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.groups(no_docs).count() == 0
    kept = simhash.drop_near_copies(small)
    assert kept.columns == small.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, {c for _, _, c in want if c is not None} | {d for d, _, c in want if c is None}))


@pytest.mark.parametrize("index", ["narrow", "wide"])
def test_rows_of_one_id_with_different_texts_all_stay(spark, index):
    """Rows that share an id, or have none, are copies only if their texts are; of linked ones a single row stays."""
    from folioscope.llm import simhash_wide

    from .conftest import prose

    a, b, c, d, e, f = (prose(9000 + k, 60) for k in range(6))
    rows = [(None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (7, e), (8, f), (9, f), (None, f), (9, prose(9100, 60)), (3, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.drop_near_copies(docs) if index == "narrow" else simhash.drop_near_copies(docs, simhash_wide.exact_groups, simhash_wide.fingerprint)
    want = [(None, a), (None, b), (None, c), (7, d), (7, e), (8, f), (9, prose(9100, 60)), (3, None)]
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(want)
