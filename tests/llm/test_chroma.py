import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from bulwark.llm import chroma, recordings


def tune(seed, notes=60):
    return chroma.melody(np.random.default_rng(seed).normal(size=notes))


def test_same_tune_matches_and_others_do_not():
    a = chroma.fingerprint(tune(1))
    noisy = chroma.fingerprint(tune(1) + np.random.default_rng(0).normal(0, 0.05, len(tune(1))).astype(np.float32))
    other = chroma.fingerprint(tune(2))
    assert chroma.bit_error(a, noisy, 0)[0] < 0.1 < 0.3 < chroma.bit_error(a, other, 0)[0]


def test_shifted_recording_aligns_by_the_histogram():
    long = np.concatenate([tune(3), tune(4)])
    a, b = chroma.fingerprint(long), chroma.fingerprint(long[5 * chroma.HOP :])
    hist = chroma.offset_histogram(a, b)
    assert max(hist, key=hist.get) == 5
    error, offset = recordings.align(a[None, :], b[None, :])
    assert offset[0, 0] == 5 and error[0, 0] < 0.02


def test_short_and_silent():
    assert len(chroma.fingerprint(np.zeros(10))) == 0
    assert len(chroma.fingerprint(np.zeros(60_000))) > 0


def wav(samples, rate=chroma.RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_media_columns(spark):
    df = spark.createDataFrame([(1, bytearray(wav(tune(1)))), (2, bytearray(b"broken")), (3, None)], "id long, media binary")
    rows = {r["id"]: r for r in recordings.with_fingerprints(df, "id", "media").collect()}
    assert chroma.bit_error(np.array(rows[1]["items"], np.uint32), chroma.fingerprint(tune(1)), 0)[0] < 0.02
    assert list(rows[2]["items"]) == [] and rows[3]["cls"] is None
    slow = recordings.decode_wav(wav(tune(1), rate=2 * chroma.RATE))
    assert len(slow) == pytest.approx(len(tune(1)) / 2, abs=2)


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 64))
    vectors = [base[i % 12] + rng.normal(0, 0.02, 64) for i in range(60)] + [base[0]] * 4
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None)], "id long, v array<double>").repartition(4)
    prints = recordings.with_fingerprints(df, "id", "v", lambda v: chroma.melody(v or []))
    got = {r["id"]: r for r in recordings.search(prints, F.col("id") % 10 == 0).collect()}
    fp = {i: chroma.fingerprint(chroma.melody(v)) for i, v in enumerate(vectors)}
    cls = {i: f.tobytes() for i, f in fp.items()}
    assert len(got) == 65 and got[900]["match_id"] is None and got[900]["n_items"] == 0
    for i in fp:
        assert got[i]["class_id"] == min(j for j in fp if cls[j] == cls[i])
        hits, classes = [], set()
        for q in range(0, 64, 10):
            error, offset = recordings.align(fp[i][None, :], fp[q][None, :])
            if q != i and cls[q] == cls[i]:
                hits.append((0.0, q))
            elif cls[q] != cls[i] and error[0, 0] <= recordings.MOST_ERROR:
                first = min(j for j in range(0, 64, 10) if cls[j] == cls[q])
                hits.append((float(error[0, 0]), first))
                classes.add(cls[q])
        assert got[i]["n_matches"] == len(classes)
        assert (got[i]["bit_error"], got[i]["match_id"]) == (min(hits) if hits else (None, None))
