import re

import corpus_pipeline
import numpy as np
import pytest
from edge_cases import documents, empty

from entitymill.llm import packing, quality_cnn, secrets, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "secret scans", "packing"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]

    first = stages[0](spark, docs, FOLDER).cache()
    net = quality_cnn.fit_labelled(docs, labels)
    rows = [r for r in docs.collect() if net.score([r.text.encode()])[0] >= 0.3]
    assert sorted(first.collect()) == sorted(rows)

    second = stages[1](spark, first, FOLDER).cache()
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append(r)
    rows = [min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values()]
    assert sorted(second.collect()) == sorted(rows)

    third = stages[2](spark, second, FOLDER).cache()
    rows.sort(key=lambda r: r.doc_id)
    prints = [simhash.fingerprint(simhash.shingle_hashes(r.text.encode(), 3)) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        new = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(rows))]
        if new == label:
            break
        label = new
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    assert sorted(third.collect()) == sorted(rows)

    fourth = stages[3](spark, third, FOLDER).cache()
    words = secrets.automaton()
    want = {r.doc_id: secrets.redacted(r.text, secrets.find_spans(r.text, words)) for r in rows}
    got = fourth.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert not any(secrets.find_spans(r.text, words) for r in got)

    pieces = stages[4](spark, fourth, FOLDER).collect()
    assert {p.doc_id for p in pieces} == set(want)
    assert sum(p.length for p in pieces) == packing.tokenized(fourth).agg({"doc_tokens": "sum"}).first()[0]


@pytest.mark.parametrize("k", range(4))
def test_edge_rows(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    docs = documents(spark)
    kept = stage(spark, docs, FOLDER)
    assert kept.schema == docs.schema and 0 < kept.count() <= docs.count()
    assert stage(spark, empty(spark), FOLDER).count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as contract

    assert contract.queries()["pipeline"](spark, FOLDER).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_sequences_of_the_output_hold_all_tokens(spark):
    pieces = corpus_pipeline.run(spark, FOLDER).cache()
    by_id = {}
    for s in packing.sequences(pieces).collect():
        assert s.length == sum(len(p.ids) // 4 for p in s.pieces)
        for p in s.pieces:
            by_id.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    want = {r.doc_id: np.frombuffer(r.ids, "<u2").astype("<u4").tobytes() for r in packing.tokenized(docs).collect()}
    assert {i: b"".join(ids for _, ids in sorted(pieces)) for i, pieces in by_id.items()} == want
