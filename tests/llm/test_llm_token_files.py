import random
import uuid
import zlib

import numpy as np
import pytest
from edge_cases import TEXTS, documents, empty
from tokenizers import Tokenizer

from entitymill.llm import token_files
from entitymill.llm.common import scratch


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_files.TOKENIZER)


def wanted(rows, tokenizer):
    """(id, start, tokens, checksum) of every row, in the order of ids; equal ids in any order of their own."""
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    return sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)


def check(found, rows, tokenizer):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found)
    assert got == wanted(rows, tokenizer)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order)


def test_edge_rows(spark, tokenizer):
    path = scratch(spark, "test-token-files")
    token_files.write_ids(documents(spark).repartition(3), path, block_bytes=500, blocks_a_file=2)
    found = token_files.read_ids(spark, path, ids=True).collect()
    check(found, TEXTS, tokenizer)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in found)


def test_empty_table(spark):
    path = scratch(spark, "test-token-files")
    token_files.write_ids(empty(spark), path)
    assert token_files.read_ids(spark, path).count() == 0
    assert token_files.read_dictionary(spark, path) == b""


def test_many_blocks_and_single_documents(spark, tokenizer):
    rng = random.Random(3)
    words = ["sea", "ship", "lorry", "Straße", "it's", "éa", "12", "漢"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(200)))) for i in range(-200, 900)]
    rng.shuffle(rows)
    path = scratch(spark, "test-token-files")
    token_files.write_ids(documents(spark, rows).repartition(5), path, block_bytes=2_000, blocks_a_file=3)
    check(token_files.read_ids(spark, path).collect(), rows, tokenizer)
    assert len(token_files.read_dictionary(spark, path)) > 100
    texts = dict(rows)
    for entry in token_files.index(spark, path).where("doc_id % 150 = 0").collect():
        want = [*tokenizer.encode(texts[entry.doc_id], add_special_tokens=False).ids, 1]
        assert token_files.fetch(spark, path, entry) == want


def test_another_dictionary_and_cut_files_are_refused(spark):
    path = scratch(spark, "test-token-files")
    token_files.write_ids(documents(spark, [(1, "one two three")]), path, dictionary=b"a" * 500)
    data = spark.read.format("binaryFile").load(f"{path}/blocks").first().content
    with pytest.raises(ValueError, match="another dictionary"):
        token_files._decompressor(b"b" * 500, token_files.Block(memoryview(data), 0).digest)
    for stop in (10, len(data) - 1, len(data) - 20):
        with pytest.raises(ValueError, match="cut off"):
            token_files.Block(memoryview(data)[:stop], 0)
    with pytest.raises(ValueError, match="no block"):
        token_files.Block(memoryview(b"x" + bytes(data)), 0)


def test_a_shared_dictionary_helps_short_documents(spark):
    rng = random.Random(5)
    words = [uuid.UUID(int=rng.getrandbits(128)).hex[:6] for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=12))) for i in range(600)]
    sizes = []
    for dictionary in (None, b""):
        path = scratch(spark, "test-token-files")
        token_files.write_ids(documents(spark, rows), path, dictionary=dictionary)
        found = token_files.index(spark, path).selectExpr("sum(frame_stop - frame_start) as n").first()
        sizes.append(found.n)
    assert sizes[0] < 0.7 * sizes[1]


def test_query(spark, tokenizer):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(contract.queries()["op13_token_files"](spark, folder).collect(), rows, tokenizer)
