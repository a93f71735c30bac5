import random

import numpy as np
import pyarrow as pa
import pytest

from bulwark.llm import kneser_ney as K
from bulwark.llm import pseudo_likelihood as L


def corpus(n=240):
    rng = random.Random(2)
    parts = ["re", "tion", "en", "al", "ma", "du", "che", "ro"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 150))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "moron,", "Scum"])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_probabilities_sum_to_one():
    texts, _ = corpus(40)
    tables = K._tables(K.padded(pa.array(texts, pa.large_string()))[0])
    below = None
    alphabet = np.arange(256, dtype=np.uint64)
    for k in range(3):
        counts = K._Counts(*tables[k])
        context = tables[k][0][7] >> np.uint64(8)
        if k == 0:
            p = counts.probability(alphabet, np.full(256, 1 / 256))
        else:
            keys = (context << np.uint64(8)) | alphabet
            low = K._low(keys, k)
            p = counts.probability(keys, below(low))
        assert p.sum() == pytest.approx(1, abs=1e-9)
        prev, older = counts, below
        below = (lambda keys, c=prev, o=older, k=k: c.probability(keys, np.full(len(keys), 1 / 256) if k == 0 else o(K._low(keys, k))))


def test_table_equals_direct_evaluation():
    texts, labels = corpus(120)
    model = K.fit(texts, labels)
    buf, _ = K.padded(pa.array(["idiot tion zzz"], pa.large_string()))
    fast = model.byte_ratios(buf)
    slow = []
    maps = [dict(zip(k.tolist(), range(len(k)), strict=True)) for k in model.keys]
    for i in range(len(buf)):
        value = 0.0
        for k in range(K.ORDER):
            full = [32] * max(0, k - i) + buf[max(0, i - k) : i + 1].tolist()
            key = int.from_bytes(bytes(full), "big")
            if k:
                before = [32] * max(0, k - i) + buf[max(0, i - k) : i].tolist()
                at = maps[k - 1].get(int.from_bytes(bytes(before), "big")) if i else None
                value += float(model.weight[k - 1][at]) if at is not None else 0.0
            if key in maps[k]:
                value = float(model.ratio[k][maps[k][key]])
        slow.append(value)
    assert np.allclose(fast[1:], slow[1:], atol=1e-4)


def test_held_out_toxicity(spark, documents):
    texts, labels = corpus()
    docs = documents([*texts, None, "", "idiot " * 3])
    table = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    model = K.train(docs.withColumnRenamed("lang", "score"), table, "toxic")
    rows = {r["doc_id"]: r["score"] for r in K.score(docs.withColumnRenamed("lang", "score"), model).collect()}
    assert len(rows) == len(texts) + 3 and all(0 <= s <= 1 for s in rows.values())
    assert np.mean([(rows[i] >= 0.3) == y for i, y in enumerate(labels)]) > 0.97
    assert rows[len(texts) + 2] > 0.5 and rows[len(texts)] < 0.3
    assert K.score(docs.limit(0), model).count() == 0


def test_lookup_finds_every_key_and_nothing_else():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**40, 5000).astype(np.uint64))
    found = K.Lookup(keys).rows(np.concatenate([keys, keys + np.uint64(1)]))
    assert np.array_equal(found[: len(keys)], np.arange(len(keys)))
    want = np.where(np.isin(keys + np.uint64(1), keys), np.searchsorted(keys, keys + np.uint64(1)), -1)
    assert np.array_equal(found[len(keys) :], want)


def test_contexts_stay_inside_texts():
    token, ending, first = L.tokens(pa.array(["a b c", "d", None, "e f."], pa.string()))
    ctx = L.around(np.arange(1, len(token) + 1), first)
    assert first.tolist() == [0, 3, 4, 4, 6] and ending[4] == (ord("e") + 1) * 257 and ending[5] == (ord("f") + 1) * 257
    assert (ctx[3] == 0).all() and ctx[0].tolist() == [0, 0, 0, 2, 3, 0] and ctx[4].tolist() == [0, 0, 0, 6, 0, 0]


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    ctx, target = rng.integers(0, L.INPUTS, (5, L.SIDES)), rng.integers(0, L.CLASSES, 5)
    net = L.Network(rng.standard_normal(L.Network.SIZE).astype(np.float32) * 0.3)
    before, memory = net.flat.copy(), np.zeros(L.Network.SIZE, np.float32)
    net.step(ctx, target, memory)
    moved = np.flatnonzero(memory > 1e-6)
    for at in moved[:: max(1, len(moved) // 25)]:
        v = []
        for e in (1e-2, -1e-2):
            f = before.copy()
            f[at] += e
            v.append(-L.Network(f).log_probability(ctx, target).astype(float).mean())
        assert (v[0] - v[1]) / 2e-2 == pytest.approx(float(np.sqrt(memory[at]) * np.sign(before[at] - net.flat[at])), rel=0.05, abs=2e-3)


def test_order_matters_to_the_score(spark, documents):
    rng = random.Random(0)
    phrase = "the cat sat on a mat and then it ran to her door".split()
    texts = [" ".join(phrase * rng.randint(3, 8)) + f" end{i}" for i in range(300)]
    shuffled = []
    for t in texts[:30]:
        w = t.split()
        rng.shuffle(w)
        shuffled.append(" ".join(w))
    model = L.train(documents(texts * 2))
    mean = lambda ts: np.mean([r["log_likelihood"] / r["n_words"] for r in L.score(documents(ts), model).collect()])
    assert mean(texts[:30]) > mean(shuffled) + 0.3
    rows = {r["doc_id"]: r for r in L.score(documents([None, "", "cat"]).withColumnRenamed("lang", "n_unseen"), model).collect()}
    assert rows[0]["n_words"] == rows[1]["n_words"] == 0 and rows[0]["log_likelihood"] == 0 and rows[2]["log_likelihood"] < 0
    assert L.train(documents(texts).limit(0)).counts.sum() == 0


def by_brute_force(model, corpus, text):
    """(sum of log-probabilities, words no other text has), word by word."""
    known, net = model.vocabulary, L.Network(model.flat)
    hash_of = lambda w: L.tokens(pa.array([w], pa.string()))
    counted = [w for t in corpus for w in (t or "").lower().split()]
    mine = text.lower().split()
    rank = {w: int(known.ranks(hash_of(w)[0])[0]) for w in {*counted, *mine}}
    ending = {w: hash_of(w)[1] for w in rank}
    cls = {w: int(known.classes(np.array([rank[w]]), ending[w])[0]) for w in rank}
    ids = [int(known.inputs(np.array([rank[w]]), ending[w])[0]) for w in mine]
    n, total = {w: counted.count(w) for w in rank}, np.zeros(L.CLASSES)
    types = np.ones(L.CLASSES)
    for w in set(counted):
        total[cls[w]] += n[w]
        types[cls[w]] += 1
    out = unseen = 0
    for i, w in enumerate(mine):
        ctx = [ids[i + d] if 0 <= i + d < len(mine) else 0 for d in (-3, -2, -1, 1, 2, 3)]
        x = np.concatenate([net.embed[c] for c in ctx]).astype(float)
        z = np.tanh(x @ net.w1 + net.b1) @ net.w2 + net.b2
        own, own_class = mine.count(w), sum(cls[v] == cls[w] for v in mine)
        p = np.exp(z[cls[w]]) / np.exp(z).sum() * (max(n[w] - own, 0) + L.ADDED) / (max(total[cls[w]] - own_class, 0) + L.ADDED * types[cls[w]])
        out += np.log(p)
        unseen += n[w] <= own
    return out, unseen


@pytest.mark.parametrize("frequent", [4, 1 << 16])
def test_scores_match_brute_force_at_any_partitioning(spark, documents, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    monkeypatch.setattr(L, "SHARD_WORDS", 900)
    monkeypatch.setattr(L, "CHUNK_WORDS", 200)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("re", "tion", "wor", "da") for b in ("s", "ing", "ed,", "e", "Y", "", "12")]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.9 else f"only{rng.randint(0, 200)}" for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [texts[0], texts[1], "alone here forever", None, ""]
    docs = documents(texts)
    model, other = L.train(docs.repartition(2)), L.train(docs.repartition(11, "text"))
    assert np.array_equal(model.flat, other.flat) and model.counts.sum() == sum(len((t or "").split()) for t in texts)
    rows = {r["doc_id"]: r for r in L.score(docs.repartition(5), other).collect()}
    assert len(rows) == len(texts)
    for i in (0, 1, 5, 9, 62):
        want, unseen = by_brute_force(model, texts, texts[i])
        assert rows[i]["log_likelihood"] == pytest.approx(want, abs=2e-3) and rows[i]["n_unseen"] == unseen
    assert rows[0]["n_unseen"] == 0 and rows[62]["n_unseen"] == 3


def test_both_sides_beat_unigrams(spark, documents):
    rng = random.Random(1)
    tongues = [[f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k}{e}" for k in range(60)] for e in ("th", "ion", "ich", "os")]
    texts = [" ".join(rng.choice(t) for _ in range(120)) for t in tongues for _ in range(60)]
    docs = documents(texts)
    rows = L.score(docs, L.train(docs)).collect()
    words = [w for t in texts for w in t.split()]
    unigram = np.mean([np.log(words.count(w) / len(words)) for w in set(words) for _ in range(words.count(w))])
    mean = sum(r["log_likelihood"] for r in rows) / sum(r["n_words"] for r in rows)
    assert mean > unigram + 0.8  # log 4 is what the language says
