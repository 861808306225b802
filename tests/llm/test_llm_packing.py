import random
import zlib
from itertools import product

import numpy as np
import pytest
from edge_cases import LONG_WORD, documents, empty
from tokenizers import Tokenizer

from entitymill.llm import packing
from entitymill.llm.word_encoder import WordEncoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.TOKENIZER)


def test_word_by_word_equals_whole_texts(tokenizer):
    rng = random.Random(4)
    parts = ["Hello", "it's", "WE'LL", "12", "a", "é", "é", "́", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "<|endoftext|>",
             "<|startoftext|>", "<|", "|>", "漢", "İ", "ΑΣ", "\U0001f600", "!!", "...", ".", ",", ")", "ß", "÷", "ÿ.", "z;", "'s", "퟿", "%$#", "ﬁ"]
    encoder = WordEncoder(packing.TOKENIZER, most=50)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text.encode(), block=7), "<u2").tolist() == want, repr(text)


@pytest.mark.parametrize(("dims", "depth"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, depth):
    n = 2**depth
    cells = np.array(list(product(range(n), repeat=dims)))
    keys = packing.hilbert_key((cells + 0.5) / n, depth)
    assert sorted(keys) == list(range(n**dims))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_tail_is_cut_at_powers_of_two():
    for total in [*range(0, 300), 4095, 4096, 4097, 12_345]:
        cuts = [*packing.tail_cuts(total, 64), total]
        sizes = np.diff(cuts)
        assert cuts[0] == total - total % 64
        assert all(s & (s - 1) == 0 for s in sizes.tolist()) and len(set(sizes.tolist())) == len(sizes)


def check_packing(pieces, texts, tokenizer, length):
    """``texts``: (id, text) rows; every id in one piece, sequences gapless and full."""
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts]
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    sizes = []
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        sizes.append(at)
    assert all(s == length or (s < length and s & (s - 1) == 0) for s in sizes)
    assert sum(s < length for s in sizes) <= length.bit_length()
    by_id = {}
    for p in pieces:
        by_id.setdefault(p.doc_id, []).append(p)
    rows = {}
    for i, x in ids:
        rows.setdefault(i, []).append(x)
    for i, copies in rows.items():
        want = []
        for p in by_id[i]:
            some = [x for x in copies if len(x) == p.doc_tokens]
            assert zlib.crc32(np.array(some[0][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
            want.append((p.doc_tokens, p.length))
        assert sum(n for _, n in want) == sum(len(x) for x in copies)


def test_edge_rows(spark, tokenizer):
    rows = [(1, "one two three"), (1, "one two three"), (None, "one"), (2, None), (3, ""), (None, None), (4, LONG_WORD), (5, "İ 漢字 <|endoftext|>")]
    pieces = packing.pack(documents(spark, rows), length=256).collect()
    check_packing(pieces, rows, tokenizer, 256)
    assert packing.pack(empty(spark)).count() == 0
    nothing = packing.pack(documents(spark, [(9, None)])).collect()
    assert [(p.start, p.length, p.offset, p.doc_tokens) for p in nothing] == [(0, 1, 0, 1)]


def test_query(spark, tokenizer):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check_packing(contract.queries()["op3_curve_packing"](spark, folder).collect(), texts, tokenizer, 4096)


def test_sequences_follow_the_curve(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    curve = {r.doc_id: r.curve for r in packing.tokenized(docs).collect()}
    pieces = packing.pack(docs).collect()
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    keys = [curve[i] for i in order]
    assert keys == sorted(keys)
    whole = packing.sequences(packing.pack(docs)).collect()
    assert {r.sequence_id: r.length for r in whole} == {s: sum(p.length for p in pieces if p.sequence_id == s) for s in {p.sequence_id for p in pieces}}
