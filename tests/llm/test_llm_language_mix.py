import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from edge_cases import PROSE, documents, empty

from entitymill.llm import language_mix as lm


def folder_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_em_finds_shares_and_never_loses_likelihood():
    rng = np.random.default_rng(0)
    chance = rng.dirichlet(np.full(500, 0.3), size=3) + 1e-6
    chance /= chance.sum(axis=1, keepdims=True)
    share = np.array([0.6, 0.3, 0.1])
    weight = share @ chance
    found, value = lm._em(chance, weight, rounds=500, close=1e-9)
    assert np.allclose(found, share, atol=1e-3)
    values = [lm._em(chance, weight, rounds=k, close=0)[1] for k in range(1, 20)]
    assert all(b >= a - 1e-12 for a, b in zip(values, values[1:], strict=False)) and value >= values[-1]


def test_counts_are_those_of_all_rows(spark):
    docs = documents(spark, [(1, PROSE), (1, PROSE), (2, None), (3, "the sea")])
    got = {r.bucket: r.n for r in lm.gram_counts(docs).collect()}
    want = np.zeros(lm.BUCKETS, int)
    for t in (PROSE, PROSE, "the sea"):
        want += np.bincount(lm.gram_buckets(t.encode()), minlength=lm.BUCKETS)
    assert got == {i: want[i] for i in np.flatnonzero(want)}


def test_mixtures(spark):
    docs = folder_docs(spark)
    languages = lm.learn(docs)
    by = {}
    for r in docs.where("length(text) > 2000").orderBy("doc_id").collect():
        # Some documents hold a passage in another language.
        held = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        if held and len(languages.mixture(r.text[:1500].encode())) == 1:
            by.setdefault(r.lang, r.text[:1500])
    mixed = languages.mixture(("\n".join([by["fr"], by["de"]])).encode())
    assert {n for n, _ in mixed} == {"fr", "de"} and abs(mixed[0][1] - 0.5) < 0.15
    assert [n for n, _ in languages.mixture((by["es"] * 3).encode())] == ["es"]


def plain_mixture(languages, text, penalty):
    """EM and the choice of languages, one n-gram after the other."""
    if text is None or not any(c.isalpha() for c in text):
        return []
    grams = lm.gram_buckets(text.encode()).tolist()
    chance = languages.chance.tolist()

    def em(some):
        share = [1 / len(some)] * len(some)
        for _ in range(40):
            new = [0.0] * len(some)
            for g in grams:
                mixed = sum(s * chance[k][g] for s, k in zip(share, some))
                for i, k in enumerate(some):
                    new[i] += share[i] * chance[k][g] / mixed / len(grams)
            done = max(abs(a - b) for a, b in zip(new, share)) < 1e-3
            share = new
            if done:
                break
        return share, sum(np.log(sum(s * chance[k][g] for s, k in zip(share, some))) for g in grams)

    share, _ = em(range(len(chance)))
    order = sorted(range(len(chance)), key=lambda k: -share[k])
    found = (order[:1], [1.0], sum(np.log(chance[order[0]][g]) for g in grams) / lm.GRAM)
    for k in range(2, len(order) + 1):
        share, value = em(order[:k])
        value = value / lm.GRAM - (k - 1) * (penalty + 0.5 * np.log(len(grams)))
        if value <= found[2]:
            break
        found = (order[:k], share, value)
    return sorted(((languages.names[k], s) for k, s in zip(found[0], found[1])), key=lambda x: -x[1])


def test_mixtures_equal_a_plain_version(spark):
    docs = folder_docs(spark)
    languages = lm.learn(docs)
    texts = [r.text[:300] for r in docs.where("text is not null").orderBy("doc_id").limit(25).collect()]
    texts += [a + " " + b for a, b in zip(texts[::2], texts[1::2])] + ["a", "½ ½", "② ③", "Ⅷ 12", "", None, "ß"]
    for text in texts:
        for penalty in (6.0, 0.5):
            got = languages.mixture(None if text is None else text.encode(), penalty)
            want = plain_mixture(languages, text, penalty)
            assert [n for n, _ in got] == [n for n, _ in want], text
            assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)


def test_numerals_are_no_letters(spark):
    languages = lm.learn(folder_docs(spark))
    rows = [(1, "½ ½ ½"), (2, "② ③"), (3, "Ⅷ 12"), (4, "½ sea and ships")]
    got = {r.doc_id: r.lang_pred for r in lm.identify(documents(spark, rows), languages).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == "en"


def test_first_query_of_a_process(tmp_path):
    """Workers that don't have the package on their path get it from the driver."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as c\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('rows', c.queries()['op8_language_mixture'](spark, '/root/testdata/sf0.001').count())\n"
    )
    script = tmp_path / "first.py"
    script.write_text(code)
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script), root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in out.stdout, out.stderr[-2000:]


def test_edge_rows(spark):
    languages = lm.learn(folder_docs(spark))
    got = lm.identify(documents(spark, clashes=["kept", "fp"]), languages).collect()
    assert len(got) == documents(spark).count()
    for r in got:
        if r.doc_id in (3, 4, 5, 6, 11, 12):
            assert (r.lang_pred, r.score, r.languages) == ("und", 0.0, "")
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.lang_pred for r in got if r.doc_id in (1, 8)} == {"en"}
    assert lm.identify(empty(spark), languages).count() == 0
    nothing = lm.learn(empty(spark))
    assert {r.lang_pred for r in lm.identify(documents(spark), nothing).collect()} == {"und"}


def test_too_many_languages_are_refused(spark):
    rows = [(i, f"l{i}", PROSE if i < 5 else None) for i in range(lm.MOST_LANGUAGES + 9)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert lm.learn(docs, folds=None).names == ["l0", "l1", "l2", "l3", "l4"]
    assert len(lm.learn(docs, folds=None, most=5).names) == 5
    with pytest.raises(ValueError, match="5 values in lang"):
        lm.learn(docs, folds=None, most=4)
    with pytest.raises(ValueError, match="at most 100"):
        lm.learn(docs.withColumn("text", docs.lang), folds=None)


def test_held_out_accuracy(spark):
    import __spark_entry__ as contract

    truth = {r.doc_id: r.lang for r in folder_docs(spark).collect()}
    got = contract.queries()["op8_language_mixture"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.97
