import random
import zlib

import numpy as np
import pytest
from edge_cases import documents, empty

from entitymill.llm import quality_cnn as cnn


def random_net(seed=0):
    rng = np.random.default_rng(seed)
    return cnn.ByteNet(
        rng.normal(0, 0.5, (cnn.WIDTH, 256, cnn.FILTERS)), rng.normal(0, 0.1, cnn.FILTERS), rng.normal(0, 0.5, 2 * cnn.FILTERS), np.array(0.3)
    )


def texts():
    rng = random.Random(1)
    sizes = [0, 1, 5, 6, cnn.STEP - 5, cnn.STEP - 4, cnn.STEP, cnn.STEP + 1, 3 * cnn.STEP, 5000]
    return [None, *(bytes(rng.randrange(1, 256) for _ in range(n)) for n in sizes)]


def plain_score(net, text):
    """One window at a time."""
    text = text or b""
    chunks = (len(text) + cnn.WIDTH - 2) // cnn.STEP + 1
    end = chunks * cnn.STEP
    padded = text + bytes(end - len(text))
    best = np.zeros((chunks, cnn.FILTERS))
    for at in range(end - cnn.WIDTH + 1):
        z = net.b + sum(net.w[j, padded[at + j]] for j in range(cnn.WIDTH))
        best[at // cnn.STEP] = np.maximum(best[at // cnn.STEP], z)
    pooled = np.concatenate([best.mean(axis=0), best.max(axis=0)])
    return 1 / (1 + np.exp(-(pooled @ net.v + net.c)))


def test_scores_equal_window_by_window():
    net = random_net()
    want = [plain_score(net, t) for t in texts()]
    assert np.allclose(net.score(texts()), want, atol=1e-4)
    assert np.allclose([net.score([t])[0] for t in texts()], net.score(texts()), atol=1e-6)


def test_every_byte_counts():
    net = random_net()
    text = b"a" * 3000
    changed = [text[:k] + b"\xff" + text[k + 1 :] for k in (0, 255, 256, 1500, 2999)]
    assert len(set(net.score([text, *changed]).tolist())) == 6


def test_gradients():
    sample = [t for t in texts() if t]
    y = np.array([k % 2 for k in range(len(sample))], float)
    net = random_net()
    grads = cnn._gradients(net, sample, y)

    def loss(**change):
        p = cnn.ByteNet(**{"w": net.w, "b": net.b, "v": net.v, "c": net.c, **change}).score(sample)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    def slope(name, at, step):
        up, down = getattr(net, name).copy(), getattr(net, name).copy()
        up[at] += step
        down[at] -= step
        return (loss(**{name: up}) - loss(**{name: down})) / (2 * step)

    assert slope("c", (), 1e-3) == pytest.approx(grads["c"], rel=0.02, abs=1e-4)
    for k in (0, 5, 40):
        assert slope("v", k, 1e-3) == pytest.approx(grads["v"][k], rel=0.02, abs=1e-4)
    for k in (0, 9):
        assert slope("b", k, 1e-3) == pytest.approx(grads["b"][k], rel=0.05, abs=2e-3)
    # A single weight moves the loss as its gradient says, as long as no other window wins.
    large = np.unravel_index(np.argsort(-np.abs(grads["w"]), axis=None)[:5], grads["w"].shape)
    for at in zip(*large, strict=True):
        assert slope("w", at, 1e-3) == pytest.approx(grads["w"][at], rel=0.1, abs=2e-3)


def test_whole_texts_are_learned_from(spark, monkeypatch):
    """As many rows as the bounds hold, each with all of its text; a row too large ends the sample."""
    from pyspark.sql import functions as F

    docs = documents(spark, [(i, chr(97 + i % 26) * (40_000 if i == 7 else 10 + i)) for i in range(60)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    seen = []
    monkeypatch.setattr(cnn, "fit", lambda texts, y, epochs: seen.append((texts, y.tolist())))
    cnn.fit_labelled(docs, labels)
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    texts, y = seen[-1]
    assert sorted(texts) == sorted((chr(97 + i % 26) * (40_000 if i == 7 else 10 + i)).encode() for i in learned)
    assert y == [1 if len(t) == 40_000 else len(t) % 2 for t in texts]
    cnn.fit_labelled(docs, labels, train_rows=12)
    assert seen[-1][0] == texts[:12]
    cnn.fit_labelled(docs, labels, train_bytes=500)
    some = seen[-1][0]
    assert some == texts[: len(some)] and sum(map(len, some)) <= 500 < sum(map(len, texts[: len(some) + 1]))
    cnn.fit_labelled(docs, labels, train_bytes=5)
    assert seen[-1][0] == []


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_without_both_labels_scores_are_constant(y):
    net = cnn.fit([b"some text"] * len(y), np.array(y))
    assert len(set(net.score([b"", b"a", b"b" * 1000]).tolist())) == 1


def test_edge_rows(spark):
    docs = documents(spark, clashes=["kept", "fp", "_part", "_y", "_id"])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (8, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    net = cnn.fit_labelled(docs, labels, epochs=2)
    got = cnn.score_quality(docs, net).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 6)}) == 1
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got if r.doc_id is not None}
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert cnn.score_quality(empty(spark), net).count() == 0
    assert cnn.score_quality(docs, cnn.fit_labelled(empty(spark), labels)).count() == docs.count()


def test_held_out_accuracy(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in contract.queries()["op7_quality_cnn"](spark, folder).collect()]
    held = [r for r in got if r.held_out and r.doc_id in labels]
    good = np.array([r.score for r in held if labels[r.doc_id] == 1])
    bad = np.array([r.score for r in held if labels[r.doc_id] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert np.mean(good >= 0.3) > 0.97
