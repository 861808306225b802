import hashlib
import re

from compare import assert_same, connect
from edge_cases import documents, empty
from pyspark.sql import functions as F

from entitymill.llm import exact_dedup
from entitymill.llm.common import scratch

COPIES = [
    (10, "a b  c"), (11, "abc"), (9, "a\tb\nc"), (8, "a bc"), (None, "ab c "), (12, "abd"), (12, "abd"), (13, None), (14, ""),
    (15, " \r\n"), (16, "a bc"), (None, None), (17, "\x1cabc"),
]


def written(spark, docs, files=1):
    path = scratch(spark, "test-docs")
    docs.repartition(files).write.parquet(path)
    return path


def plain(rows):
    """(id, keep, size, sha) of each row by comparing all texts; rows as (id, text)."""
    normal = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, normal, strict=True):
        group = [r for r, m in zip(rows, normal, strict=True) if m == n]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out.append((i, keep, len(group), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(map(str, out))


def check(marked, rows):
    got = marked.collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == plain(rows)
    kept = [(r.keep_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_edge_rows(spark):
    from edge_cases import TEXTS

    rows = [*COPIES, *TEXTS]
    check(exact_dedup.mark_duplicates(spark, written(spark, documents(spark, rows))), rows)
    assert exact_dedup.mark_duplicates(spark, written(spark, empty(spark))).count() == 0


def test_many_batches_give_the_same(spark):
    rows = COPIES * 3
    path = written(spark, documents(spark, rows), files=7)
    check(exact_dedup.mark_duplicates(spark, path, files_a_batch=2), rows)


def test_state_goes_on_with_new_files(spark):
    path, checkpoint = written(spark, documents(spark, COPIES)), scratch(spark, "test-state")
    first = exact_dedup.digest_state(spark, path, checkpoint=checkpoint).agg(F.sum("n")).first()[0]
    documents(spark, [(1, "abc"), (2, "new")]).write.mode("append").parquet(path)
    state = exact_dedup.digest_state(spark, path, checkpoint=checkpoint).collect()
    assert first == len(COPIES) and sum(r.n for r in state) == len(COPIES) + 2
    abc = [r for r in state if bytes(r.digest) == hashlib.sha256(b"abc").digest()]
    assert [(r.n, r.place.chars, r.place.minus_id) for r in abc] == [(6, 6, -10)]


def test_equal_digests_of_other_bytes_are_told_apart(spark):
    rows = COPIES * 2 + [(i, f"text {i % 9}") for i in range(100, 140)]
    path = written(spark, documents(spark, rows), files=3)
    check(exact_dedup.mark_duplicates(spark, path, digest=lambda text: F.crc32(text.cast("binary")) % 4), rows)


def test_drop_keeps_columns_and_one_row_of_each_text(spark):
    docs = documents(spark, COPIES)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.schema == docs.schema
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in COPIES})
    assert exact_dedup.drop_duplicates(empty(spark)).count() == 0


def test_query(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.001"
    got = contract.queries()["op5_exact_dedup"](spark, folder).toPandas()
    assert_same(got, connect(folder).execute(contract.oracle_sql()["op5_exact_dedup"]).df())
