import gzip
import hashlib
import time

import pytest
from compare import assert_same, connect

from entitymill.llm import warc
from entitymill.llm.common import scratch

INNER = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n\r\nWARC/1.0\r\nContent-Length: ٣\r\nWARC-Type: a\r\n\r\n"
BIG = "<p>äö</p>" * 20


def pages(spark, rows):
    rows = [(i, u, h, "x", "y") for i, u, h in rows]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest string")


def round_trip(spark, rows, records_a_file=5_000, payloads=True):
    path = scratch(spark, "test-archives")
    warc.write_archives(warc.page_records(pages(spark, rows).coalesce(1)), path, records_a_file)
    return path, warc.read_archives(spark, path, payloads).collect()


def test_round_trip_with_magic_inside_payloads(spark):
    fake = "".join(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:{i}>\r\nContent-Length: 0\r\n\r\n\r\n\r\n" for i in range(50))
    rows = [(i, f"http://a b/%20é\r\nX: {i}", h) for i, h in enumerate([INNER, "", fake, BIG, "a" * 99, "a" * 99, BIG, fake, BIG + "!", LONG])]
    rows += [(None, None, None), (None, "u", BIG), (3, "again", BIG), (-5, "u", "a" * 100), (-4, "u", "a" * 100)]
    _, got = round_trip(spark, rows)
    assert len(got) == len(rows)
    assert sorted(str((r.page, r.url)) for r in got) == sorted(str((i, u)) for i, u, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.page, []).append(r)
    for i, _, html in rows[:10]:
        raw = (html or "").encode()
        r = by[i][0]
        if i != 3:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        if r.kind == "response":
            assert r.payload == raw
    kinds = {i: [(r.kind, r.refers_to) for r in by[i]] for i in by if i is not None}
    assert sorted(map(str, kinds[3])) == sorted(map(str, [("response", None), ("revisit", 3)]))
    assert kinds[6] == [("revisit", 3)] and kinds[7] == [("revisit", 2)]
    assert kinds[4] == kinds[5] == [("response", None)]
    assert kinds[-5] == [("response", None)] and kinds[-4] == [("revisit", -5)]
    assert sorted(str((r.kind, r.refers_to)) for r in by[None]) == ["('response', None)", "('revisit', 3)"]


LONG = "long " * 60_000


def test_many_records_in_several_files(spark):
    rows = [(i, "u", INNER + str(i % 700)) for i in range(1500)]
    path, got = round_trip(spark, rows, records_a_file=400, payloads=False)
    assert sorted(r.page for r in got) == list(range(1500))
    assert len({r.file for r in got}) == 4
    assert sum(r.kind == "revisit" for r in got) == 800
    assert warc.candidates(spark, path).count() > 1500


def test_reached_records_equal_a_walk_from_the_start(spark):
    path, got = round_trip(spark, [(i, "u", INNER * (i % 4) + str(i)) for i in range(60)])
    file = got[0].file
    data = gzip.decompress(open(file.removeprefix("file:"), "rb").read())
    at, walked = 0, []
    while at < len(data):
        walked.append(at)
        at = warc.parse_at(data, at)["to"]
    assert sorted(r["at"] for r in got) == walked
    assert at == len(data)


def test_damage_ends_the_chain(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:0:{}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record.format(1) + record.format(2) + "junk" + record.format(3)).encode())
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes(b"junk" + record.format(4).encode())
    assert sorted(r.page for r in warc.read_archives(spark, str(tmp_path)).collect()) == [1, 2]


def test_cut_archives_can_be_refused(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:0:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for name, data, n in (("whole", record * 3, 3), ("empty", b"", 0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        assert warc.read_archives(spark, str(tmp_path / name), whole=True).count() == n
    for name, data in (("cut", record * 2 + record[:-1]), ("junk", b"x" + record), ("behind", record + b"\r\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(ValueError, match="cut or damaged"):
            warc.read_archives(spark, str(tmp_path / name), whole=True)


def test_many_magics_take_linear_time():
    data = warc.MAGIC * 200_000 + b"\r\n\r\n"
    start = time.perf_counter()
    assert not any(warc.parse_at(data, m.start()) for m in warc._MAGIC.finditer(data))
    assert time.perf_counter() - start < 5


def test_archives_are_bounded_by_bytes(spark):
    rows = [(i, "u", "x" * 50_000 + str(i)) for i in range(40)] + [(99, "u", "y" * 400_000)]
    path = scratch(spark, "test-warc")
    warc.write_archives(warc.page_records(pages(spark, rows)), path, bytes_a_file=200_000)
    read = warc.read_archives(spark, path, whole=True).collect()
    assert sorted(r.page for r in read) == [*range(40), 99]
    sizes = {}
    for r in read:
        sizes[r.file] = max(sizes.get(r.file, 0), r.to)
    assert all(s <= 201_000 for s in sizes.values() if s < 400_000) and len(sizes) >= 14


def test_empty_table(spark):
    assert round_trip(spark, [])[1] == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    import __spark_entry__ as contract

    got = contract.queries()["op4_warc_boundaries"](spark, folder).toPandas()
    want = connect(folder).execute(contract.oracle_sql()["op4_warc_boundaries"]).df()
    for d in (got, want):
        d["refers_to"] = d["refers_to"].astype("float64")
    assert_same(got, want)
