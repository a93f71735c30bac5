import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from bulwark.llm.components import connected_components
from bulwark.llm import near_duplicates as N
from bulwark.llm.near_duplicates import minhash, near_duplicates, odd_sketch, parity, rare_prefixes, sets_of

WORD = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", "   ", "one two", "One  TWO", "one two three four five", "É é x y z"]
    for _ in range(25):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randint(3, 120))))
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(60):  # a large group around the threshold, and exact copies
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [" ".join(base)] * 15 + [" ".join(base).upper()]
    out.append(" ".join(rng.choice(words) for _ in range(20_000)))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force(spark, documents, seed):
    texts = corpus(seed)
    want = brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(documents(texts)).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [2, 5])
def test_hot_buckets_dealt_by_rare_shingles_lose_nothing(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT", hot)
    texts = corpus(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(documents(texts).withColumnRenamed("source", "component_id")).collect()}
    assert got == brute(texts)


def test_documents_that_share_a_passage_do_not_meet(spark, documents):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    passage = [rng.choice(words) for _ in range(300)]
    texts = [" ".join(passage + [rng.choice(words) for _ in range(100)]) for _ in range(400)]
    texts += [t.replace("w1 ", "x ") for t in texts[:3]]
    keys = rare_prefixes(documents(texts).select("doc_id", "text")).groupBy("key").count().where("count > 1")
    assert keys.selectExpr("sum(count * (count - 1) / 2)").first()[0] < 2000  # of 81,000 pairs
    rows = near_duplicates(documents(texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i if i < 400 else i - 400 for i in range(403)}


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        near_duplicates(spark.createDataFrame([("x", "a b c")], "doc_id string, text string"))


def test_null_ids_repeated_rows_and_empty_table(spark, documents):
    t = "a b c d e f g h i j"
    rows = near_duplicates(documents([t, t, "z y x w v u", t], ids=[5, None, 7, 5])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in rows) == [("5", 6, "5", True), ("5", 6, "5", True), ("7", 2, "7", True), ("None", 6, "None", True)]
    assert near_duplicates(documents([t]).limit(0)).count() == 0


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(0)
    flat = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0.95, 0.9, 0.8):
        n = 1000
        extra = int(n * (1 - share) / (1 + share))
        a, b = np.unique(flat[: n + extra]), np.unique(np.concatenate([flat[:n], flat[2000 : 2000 + extra]]))
        true = n / (n + 2 * extra)
        s = odd_sketch(minhash([a, b]))
        z = int(np.bitwise_count(s[0] ^ s[1]).sum())
        m = s.shape[1] * 64
        assert abs(1 + m / 2 * np.log(1 - 2 * z / m) / (2 * 192) - true) < 0.1
        p = parity([a, b])
        assert np.bitwise_count(p[0] ^ p[1]).sum() <= 2 * extra


def test_sets_do_not_depend_on_the_batch():
    texts = ["a b c d e f", "", "g h", None, "a b c d e f"]
    whole = sets_of(pa.array(texts, pa.string()))
    for t, s in zip(texts, whole, strict=True):
        assert np.array_equal(sets_of(pa.array([t], pa.string()))[0], s)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (400, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {i: 200 for i in (200, 201, 202)}
    assert got == want
