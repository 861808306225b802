import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from edge_cases import LONG_TEXT, documents, empty

from entitymill.llm import quality_rules as q


def plain_counts(text):
    """The base statistics, straight from their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_base_statistics():
    rng = random.Random(2)
    parts = ["a", "b", "cc", "é", "#", "|", "\n", " ", "\t", "\x0b", "\x1c", "\x85", " ", "\r\n", "A!", "9."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40)))
        assert q.counts_of(text.encode())[:5] == plain_counts(text), repr(text)
    assert q.counts_of(LONG_TEXT.encode())[:5] == plain_counts(LONG_TEXT)


def test_scores_never_rise_along_monotone_features():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(q.MONOTONE)))
    y = (x[:, 2] + 0.5 * np.sin(9 * x[:, 4]) + rng.normal(0, 0.4, 3000) < 0.6).astype(float)
    trees = q.fit_trees(x, y, list(q.MONOTONE.values()))
    base = rng.random((200, x.shape[1]))
    for f, way in enumerate(q.MONOTONE.values()):
        rows = np.repeat(base, 50, axis=0)
        rows[:, f] = np.tile(np.linspace(0, 1, 50), len(base))
        steps = np.diff(trees.score(rows).reshape(len(base), 50), axis=1)
        if way:
            assert (way * steps >= -1e-12).all()
    assert np.abs(trees.score(x) - y).mean() < 0.4


def test_flat_arrays_score_like_walking_the_trees():
    rng = np.random.default_rng(1)
    x = rng.random((500, len(q.MONOTONE)))
    trees = q.fit_trees(x, (x[:, 0] > 0.5).astype(float), list(q.MONOTONE.values()), trees=10)

    def walk(row, at):
        while trees.left[at] != at:
            at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
        return trees.value[at]

    want = [1 / (1 + np.exp(-trees.start - sum(walk(row, r) for r in trees.roots))) for row in x]
    assert np.allclose(trees.score(x), want)
    assert ((trees.score(x) > 0.5) == (x[:, 0] > 0.5)).mean() > 0.99


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0, 0.0]])
def test_without_both_labels_scores_are_constant(y):
    trees = q.fit_trees(np.zeros((len(y), len(q.MONOTONE))), np.array(y), list(q.MONOTONE.values()))
    assert len(set(trees.score(np.random.default_rng(0).random((5, len(q.MONOTONE)))))) == 1


def test_edge_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.apply_rules(docs, labels).collect()
    want = sorted(str((d.doc_id, plain_counts(d.text))) for d in docs.collect())
    assert sorted(str((r.doc_id, [r[c] for c in q.BASE])) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.score <= 1
    assert q.apply_rules(empty(spark), labels).count() == 0
    assert q.apply_rules(docs, labels.limit(0)).count() == docs.count()


def test_held_out_rows(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = contract.queries()["op2_quality_rules"](spark, folder).collect()
    assert {r.doc_id: [r[c] for c in q.BASE] for r in got} == {i: plain_counts(t) for i, t in docs.items()}
    held = [r for r in got if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed]
    good = [r.kept for r in held if labels[r.doc_id] == 1]
    bad = [r.kept for r in held if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5
