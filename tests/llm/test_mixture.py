import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bulwark.llm.common import materialise
from bulwark.llm.mixture import draw, mix, mixed_documents, permuted, render, scattered, scattered_np, source_table


def shares(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 3, "c": 5, None: 40}, {"é": 7, "z": 900, "A": 0}, {"only": 12}, {None: 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_table(df).collect()}
    assert got == pytest.approx(shares(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        size, key = np.full(n, n), np.full(n, 7)
        got = permuted(np.arange(n), size, key, key)
        assert sorted(got) == list(range(n))
    assert not np.array_equal(got, permuted(np.arange(n), size, key + 1, key))


def test_draws_are_multinomial_by_shard_and_meet_the_quotas(spark):
    quotas = [9000, 3, 6000, 1, 5001]
    table = spark.createDataFrame([(i + 1, q, sum(quotas[:i])) for i, q in enumerate(quotas)], "sid long, quota long, offset long")
    rows = [tuple(r) for r in draw(table, sum(quotas), len(quotas)).select("shard", "slot", "sid", "j").collect()]
    assert sorted(r[1] for r in rows) == list(range(sum(quotas)))
    assert sorted(r[2:] for r in rows) == [(i + 1, j) for i, q in enumerate(quotas) for j in range(q)]
    shards = np.zeros((5, len(quotas)))
    for shard, _, sid, _ in rows:
        shards[shard, sid - 1] += 1
    want = np.outer(shards.sum(axis=1), np.array(quotas) / sum(quotas))
    z = (shards - want) / np.sqrt(want * (1 - np.array(quotas) / sum(quotas)))
    assert np.abs(z[:, [0, 2, 4]]).max() < 4 and np.abs(z[:, [0, 2, 4]]).max() > 0.3  # scatters like a draw, not like shares


def test_numbers_agree_between_columns_and_arrays(spark):
    at = spark.range(0, 10_000, 97).select("id", scattered(3, F.col("id")).alias("x")).collect()
    assert [r["x"] for r in at] == scattered_np(3, np.array([r["id"] for r in at])).tolist()


def corpus():
    rng = random.Random(0)
    texts = [" ".join(f"w{i}.{k}" for k in range(rng.randint(1, 400))) for i in range(120)]
    sources = [rng.choice(["hot"] * 6 + ["b", "c", "d", None]) for _ in texts]
    return texts + [None, "", " \n"], sources + ["b", None, "new"]


def test_mix_contract(spark, documents):
    texts, sources = corpus()
    docs = documents(texts, sources)
    rows = mix(docs).documents.collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["size"] for r in rows} == size and len(rows) == len(texts)
    per = {}
    for i, s in enumerate(sources):
        per[s] = per.get(s, 0) + size[i]
    want = shares(per)
    taken = dict.fromkeys(per, 0)
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == per[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(64, 0.05 * want[s])
    again = mix(docs.repartition(7)).documents.collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_blocks_hold_the_words_that_are_taken(spark, documents):
    texts, sources = corpus()
    docs = materialise(documents(texts, sources).withColumn("key", F.monotonically_increasing_id()))
    plan = mix(docs, key="key")
    blocks = render(plan, docs).collect()
    slots = sorted(r["slot"] for r in blocks)
    assert slots == list(range(len(slots)))
    seen = {}
    for r in blocks:
        for w in r["text"].split(" "):
            d = int(w[1:].split(".")[0])
            seen[d] = seen.get(d, 0) + 1
    assert seen == {r["doc_id"]: r["taken"] for r in plan.documents.collect() if r["taken"]}


def test_mixed_documents_hold_the_words_that_are_taken(spark, documents):
    texts, sources = corpus()
    texts = [t and t.replace(" ", "  \n", 3) for t in texts] + ["\n w9000.0 \t w9000.1\n"] * 2
    docs = documents(texts, [*sources, "hot", "hot"])
    rows = mixed_documents(docs).collect()
    taken, copies = {}, {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert r["n_chars"] == len(r["text"]) and len(set(w)) == len(w)
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(w)
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert taken == {r["doc_id"]: r["taken"] for r in mix(docs).documents.collect() if r["taken"]} and max(copies.values()) <= 3
    whole = [r for r in rows if len(re.findall(r"\S+", r["text"])) == len((texts[r["doc_id"]] or "").split())]
    assert whole and all(r["text"] == texts[r["doc_id"]].strip() for r in whole)
    assert mixed_documents(docs.limit(0)).collect() == [] and rows[0].asDict().keys() == set(docs.columns)


def test_one_very_long_document(spark, documents):
    rows = mix(documents(["w " * 300_000, "a b c"], ["x", "y"])).documents.collect()
    # y takes its three words three times, x what is left
    assert sorted((r["size"], r["taken"]) for r in rows) == [(3, 9), (300_000, pytest.approx(299_994, abs=64))]


def test_repeated_rows_and_empty_table(spark, documents):
    docs = documents(["a b c d"] * 3, ["s"] * 3, [4, 4, None])
    rows = mix(docs.withColumn("size", F.lit(7)).withColumn("taken", F.lit(7))).documents.collect()
    assert len(rows) == 3 and sum(r["taken"] for r in rows) == 12 and {r["size"] for r in rows} == {4}
    assert mix(docs.limit(0)).documents.count() == 0
