import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bulwark.llm import nbsvm
from bulwark.llm.common import held_out, labelled_texts, training_labels
from bulwark.llm.quality_rules import KINDS, NEVER, OTHER, OWN, ROUNDS, RULES, START_FAULT, START_GOOD, fit, judge, with_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    at = {}
    for i, x in enumerate(wins):
        at.setdefault(x, []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def sample():
    rng = random.Random(1)
    w = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Über", "of", "the", "a"]) + rng.choice(["", "", "x", "y", "z"]) for _ in range(n))
    good = [w(rng.randint(25, 200)) + ".\n" + w(30) for _ in range(60)]
    bad = [" | ".join(w(1) for _ in range(60)) for _ in range(10)] + [w(60).upper().replace(" ", "!! ") for _ in range(10)]
    odd = [None, "", "\n\n", "a b", "x " * 300, "line one is here\n" * 30, "\x0b\x0c\r\t", "word " + "y" * 5000, "a b c d e f g h a b c d e f g h"]
    return good, bad, odd


def test_counts_match_brute_force(spark, documents):
    good, bad, odd = sample()
    texts = good[:10] + bad + odd
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in with_counts(documents(texts)).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_votes_keep_clean_and_drop_bad_texts(spark, documents):
    good, bad, odd = sample()
    rows = {r["doc_id"]: r for r in judge(documents(good + bad + odd).withColumnRenamed("lang", "kept")).collect()}
    assert all(rows[i]["kept"] for i in range(len(good)))
    assert not any(rows[i]["kept"] for i in range(len(good), len(good) + len(bad)))
    for i in range(len(good) + len(bad), len(rows)):
        n, _, _, _, rep = counts(odd[i - len(good) - len(bad)])
        assert rows[i]["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert not (rows[i]["kept"] and rows[i]["base_failed"])
    assert judge(documents(good).limit(0)).count() == 0


def em_by_rows(votes, rounds=ROUNDS):
    """Posterior of the good class: the same model on one row per document."""
    kinds = np.array([KINDS.index(r.kind) + 1 for r in RULES])
    many = ((votes == 0).sum(axis=1) > 1).astype(int)
    mine = np.stack([(votes[:, kinds == k] == 0).sum(axis=1) for k in range(len(KINDS) + 1)], axis=1)
    w = np.array(START_FAULT)[many][:, None] * mine
    w[:, 0] = np.array(START_GOOD)[many]
    never = np.where(mine > 0, 0.0, NEVER)
    never[:, 0] = 0.0
    w /= w.sum(axis=1, keepdims=True)
    for _ in range(rounds + 1):
        total = w.sum(axis=0)
        fits = never + np.log((total + 1) / (total.sum() + len(total)))
        for j in range(len(RULES)):
            for k in range(len(total)):
                added = OWN if kinds[j] == k else OTHER
                share = [(w[votes[:, j] == v, k].sum() + added[v]) / (total[k] + sum(added)) for v in range(3)]
                fits[:, k] += np.log(np.array(share)[votes[:, j]])
        w = np.exp(fits - fits.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
    return w[:, 0]


def test_expectation_maximisation_matches_numpy(spark, documents):
    good, bad, odd = sample()
    table = with_counts(documents(good + bad + odd))
    votes = [r.vote() for r in RULES]
    rows = table.select(*votes, fit(table).posterior(votes).alias("p")).collect()
    assert np.allclose([r["p"] for r in rows], em_by_rows(np.array([list(r)[:-1] for r in rows])))


def test_posterior_outweighs_single_votes():
    """One bad vote that its kind contradicts does not decide, and two that agree do."""
    rng = np.random.default_rng(0)
    votes = np.full((600, len(RULES)), 2)
    votes[500:560, :2] = 0  # symbols and long words
    votes[560:, 0] = votes[560:, 7] = 0  # symbols and single letters
    votes[rng.integers(0, 500, 4), 3] = 0
    kept = em_by_rows(votes) >= 0.5
    assert kept[:500].all() and not kept[500:].any()


def test_clean_documents_stay_where_faults_are_rare():
    rng = np.random.default_rng(1)
    votes = rng.choice([1, 2, 2, 2], (3000, len(RULES)))
    votes[rng.integers(0, 3000, 20), rng.integers(0, len(RULES), 20)] = 0
    assert (em_by_rows(votes) >= 0.5)[(votes == 0).sum(axis=1) == 0].all()


def test_sample_takes_one_text_per_id(spark, documents):
    docs = documents(["a b", "c d", "c d", None, "e" * 50, "f"], ids=[1, 2, 2, 3, 4, 2])
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id long, quality int")
    held = {r["doc_id"] for r in labels.where(held_out()).collect()}
    took = lambda d, most: sorted((r["doc_id"], r["text"]) for r in labelled_texts(d, labels, "quality", 10, most).collect())
    whole = took(docs, 1000)
    assert whole == took(docs.repartition(5, "text"), 1000) and {i for i, _ in whole} == {1, 2, 3, 4} - held
    assert 4 not in {i for i, _ in took(docs, 40)}  # its text is longer than all of the sample


def test_held_out_rule_and_bounded_sample(spark):
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["h"] for r in ids.select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
    labels = ids.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).unionAll(spark.createDataFrame([(None, 1), (3, None), (3, 1)], "doc_id long, quality int"))
    sample = training_labels(labels, "quality", 20).collect()
    assert len(sample) == 40 and not any(got[r["doc_id"]] for r in sample)
    assert len({r["doc_id"] for r in sample}) == 40


def test_classifier_on_held_out_texts(spark, documents):
    good, bad, odd = sample()
    docs = documents((good + bad) * 3 + odd)
    n = 3 * (len(good) + len(bad))
    labels = spark.createDataFrame([(i, int(i % (len(good) + len(bad)) < len(good))) for i in range(n)], "doc_id long, quality int")
    model = nbsvm.train(docs, labels, "quality")
    rows = {r["doc_id"]: r for r in nbsvm.score(docs, model).withColumn("h", held_out()).collect()}
    assert len(rows) == n + len(odd) and all(0 <= r["score"] <= 1 for r in rows.values())
    right = [(rows[i]["score"] >= 0.7) == (i % (len(good) + len(bad)) < len(good)) for i in range(n) if rows[i]["h"]]
    assert np.mean(right) > 0.95
    again = nbsvm.train(docs.repartition(5), labels, "quality")
    assert np.allclose(model.weights, again.weights)


def test_classifier_without_labels_or_rows(spark, documents):
    docs = documents(["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = nbsvm.train(docs, none, "quality")
    assert [r["score"] for r in nbsvm.score(docs, model).collect()] == [0.5, 0.5]
    assert nbsvm.score(docs.limit(0), model).count() == 0


def test_dual_coordinate_descent_finds_the_margin():
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))] * 5
    w, b = nbsvm.dual_coordinate_descent(rows, np.array([1.0, -1.0] * 5), np.full(10, 10.0), epochs=200)
    assert w[0] + b == pytest.approx(1, abs=0.02) and w[1] + b == pytest.approx(-1, abs=0.02)
