import random
from itertools import combinations

import numpy as np
import xxhash
from edge_cases import documents, empty

from entitymill.llm import simhash
from entitymill.llm.components import components


def plain_fingerprint(text, size=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum((x >> i) & 1 for x in h) > len(h))


def plain_components(values, radius):
    """Value -> least value reachable, by comparing all pairs."""
    near = np.bitwise_count(np.array(values, np.uint64)[:, None] ^ np.array(values, np.uint64)[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_covering_masks_catch_every_pair_of_positions():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in combinations(range(64), radius):
            difference = sum(1 << b for b in bits)
            assert any((m & difference) == 0 for m in masks)


def test_links_connect_exactly_what_all_pairs_do(spark):
    rng = random.Random(3)
    values = {0}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            values.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
    # Many fingerprints around one: more than a small bucket holds.
    center = rng.getrandbits(64)
    values |= {center ^ (1 << a) ^ (1 << b) for a, b in rng.sample(list(combinations(range(64), 2)), 400)}
    values = sorted(values, key=signed)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = simhash.links(frame, 2)
    for r in found.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
    roots = {r.node: r.root for r in components(found).collect()}
    label = plain_components(values, 2)
    assert {v: roots.get(signed(v), signed(v)) for v in values} == {v: signed(values[k]) for v, k in zip(values, label, strict=True)}


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}
    assert components(edges.where("a > 5000")).count() == 0


def test_edge_rows(spark):
    found = simhash.near_duplicates(documents(spark)).collect()
    docs = documents(spark).collect()
    assert sorted(map(str, [(r.doc_id, r.fp) for r in found])) == sorted(str((d.doc_id, signed(plain_fingerprint(d.text)))) for d in docs)
    component = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert component[1] == component[2] == 1
    assert component[3] == component[4] == component[5] == component[6] == 3
    assert component[8] == component[9] == 8
    assert simhash.near_duplicates(empty(spark)).count() == 0
    only_null = simhash.near_duplicates(documents(spark, [(None, "a b c d")])).collect()
    assert [r.component_id for r in only_null] == [None]


def test_drop_keeps_one_row_of_each_group(spark):
    docs = documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 7, 8, 10, 11, 12]
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_query(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    ids = sorted(prints)
    label = plain_components([prints[i] for i in ids], 2)
    got = contract.queries()["op9_simhash_near_dedup"](spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", ids[k]) for i, k in zip(ids, label, strict=True)}


def test_hex_digits(spark):
    rows = spark.createDataFrame([(0,), (-1,), (255,)], "fp long").select(simhash.hex_digits().alias("x")).collect()
    assert [r.x for r in rows] == ["0" * 16, "f" * 16, "00000000000000ff"]
