import random

import numpy as np
import pytest
from edge_cases import LONG_WORD, documents, empty

from entitymill.llm import sentencepiece_nbest as sp


@pytest.fixture(scope="module")
def lattice():
    return sp.Lattice(sp.MODEL, 4)


def all_segmentations(lattice, text):
    """(score, ids) of every way through the whole lattice, without units or heuristics."""
    out, pieces = [], {}

    def edges(at):
        node, end, found = lattice.tree.get(text[at]), at + 1, []
        while node is not None:
            if "" in node:
                found.append((end, *node[""]))
            node = node.get(text[end]) if end < len(text) else None
            end += 1
        if not any(e == at + 1 for e, _, _ in found):
            ids = tuple(lattice.byte_id[b] for b in text[at].encode())
            found.append((at + 1, sum(lattice.score[i] for i in ids), ids))
        return found

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
            return
        for end, s, new in pieces.setdefault(at, edges(at)):
            go(end, score + s, ids + new)

    go(0, 0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_n_best_equal_all_segmentations(n):
    lattice = sp.Lattice(sp.MODEL, n)
    rng = random.Random(n)
    parts = ["th", "e", "an", " ", "  ", "a", "é", "\n", "漢", "\U0001f600", "s", "x", "\t"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        want = all_segmentations(lattice, sp.BLANK + text.replace(" ", sp.BLANK))
        got = lattice.encode(text)
        assert [s for s, _ in got] == [s for s, _ in want[:n]], repr(text)
        ids = [tuple(np.frombuffer(i, "<u2").tolist()) for _, i in got]
        assert len(set(ids)) == len(ids)
        allowed = {}
        for s, i in want:
            allowed.setdefault(s, set()).add(i)
        assert all(i in allowed[s] for (s, _), i in zip(got, ids, strict=True))
        assert all(lattice.decode(i) == text for i in ids)


def test_ties_are_settled_alike(lattice):
    text = "the the the the and the"
    fresh = sp.Lattice(sp.MODEL, 4)
    assert lattice.encode(text) == fresh.encode(text) == fresh.encode(text)


def test_forgetting_changes_nothing():
    small, large = sp.Lattice(sp.MODEL, 3, most=2), sp.Lattice(sp.MODEL, 3)
    for text in ("one two three four", "five two one", "x" * 200 + " one", "one"):
        assert small.encode(text) == large.encode(text)


def test_long_units(lattice):
    found = lattice.encode(LONG_WORD)
    assert len(found) == 4 and all(lattice.decode(np.frombuffer(i, "<u2").tolist()) == LONG_WORD for _, i in found)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_edge_rows(spark):
    docs = documents(spark)
    got = sp.segment(docs, 3).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.round_trip == (r.doc_id != 10)  # holds the blank mark itself
        if r.doc_id in (3, 4, 6):
            assert (r.n_found, r.n_pieces, r.score, r.scores, r.ids_crc32) == (1, 0, 0, "0", "0")
    assert sp.segment(empty(spark)).count() == 0
    with_ids = sp.segment(documents(spark, [(1, "the sea")]), 2, with_ids=True).collect()
    assert [np.frombuffer(bytes(i), "<u2").size > 0 for i in with_ids[0].ids] == [True, True]


def test_query(spark):
    import __spark_entry__ as contract

    lattice = sp.Lattice(sp.MODEL, 3)
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = contract.queries()["op6_sentencepiece_n_best"](spark, folder).collect()
    assert len(got) == len(texts) and all(r.round_trip and r.n_found == 3 for r in got)
    for r in got[:40]:
        # The whole text as one lattice, without the split into units.
        whole = lattice.n_best(sp.BLANK + texts[r.doc_id].replace(" ", sp.BLANK), 3)
        assert r.scores == ",".join(str(s) for s, _ in whole)
