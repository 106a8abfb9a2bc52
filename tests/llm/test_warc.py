from __future__ import annotations

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from chunkflow.llm import warc
from chunkflow.llm._spark import new_folder

PAGES = "page_id long, url string, html string, payload string, kind string"


def record(i: int, body: bytes, plain: bool = False) -> bytes:
    import hashlib

    member = warc.warc_record(i, f"http://h/{i}", body, hashlib.sha1(body).hexdigest(), None)
    return gzip.decompress(member) if plain else member


def found(data: bytes):
    rows = list(warc.salvage(io.BytesIO(data)))
    return [r["page_id"] for r in rows if r["kind"] == "record"], [(r["offset"], r["length"]) for r in rows if r["kind"] == "gap"]


@pytest.mark.parametrize("plain", [False, True])
def test_salvage_goes_on_after_damage(plain):
    parts = [record(i, b"<p>%d</p>" % i * 50, plain) for i in range(6)]
    whole = b"".join(parts)
    at = [sum(map(len, parts[:i])) for i in range(7)]
    assert found(whole) == ([0, 1, 2, 3, 4, 5], [])
    broken = bytearray(whole)
    broken[at[2] + len(parts[2]) // 2] ^= 0xFF
    assert found(bytes(broken)) == ([0, 1, 3, 4, 5], [(at[2], len(parts[2]))])
    junk = b"\x1f\x8b\x08 not a member WARC/ either" * 3
    ids, gaps = found(whole[: at[3]] + junk + whole[at[3] :])
    assert ids == [0, 1, 2, 3, 4, 5] and gaps == [(at[3], len(junk))]
    ids, gaps = found(whole[:-20])
    assert ids == [0, 1, 2, 3, 4] and gaps == [(at[5], len(parts[5]) - 20)]
    assert found(b"") == ([], []) and found(b"x" * 5000) == ([], [(0, 5000)])


def test_random_damage_loses_only_what_it_hits():
    rng = random.Random(5)
    parts = [record(i, rng.randbytes(300)) for i in range(20)]
    at = [sum(map(len, parts[:i])) for i in range(21)]
    for _ in range(40):
        data, hit = bytearray(b"".join(parts)), set()
        for _ in range(3):
            k = rng.randrange(len(data))
            data[k] ^= 1 + rng.randrange(255)
            hit |= {i for i in range(20) if at[i] <= k < at[i + 1]}
        ids, gaps = found(bytes(data))
        assert set(ids) >= set(range(20)) - hit and len(ids) == len(set(ids))
        assert all(length > 0 for _, length in gaps)


def test_round_trip_with_revisits(spark):
    long = "ä" * 600
    rows = [(1, "http://a\r\nb", long, "p", "k"), (2, None, long, None, None), (3, "u", "short", "", ""), (4, "u", "short", "", ""), (5, "u", None, "", ""), (None, "u", long, "", ""), (2, "u", long, "", ""), (6, "u", "", "", "")]
    pages = spark.createDataFrame(rows, PAGES)
    archives = warc.write_warc(warc.with_revisits(pages), new_folder(spark, "t"), archive_bytes=300)
    got = warc.read_warc(archives).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    key = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert key == [(0, "revisit", 2, 1200), (1, "revisit", 2, 1200), (2, "response", None, 1200), (2, "response", None, 1200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 0)]
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {long, "short", ""}


def test_empty_table_and_missing_archive(spark):
    assert warc.read_warc(warc.write_warc(warc.with_revisits(spark.createDataFrame([], PAGES)), new_folder(spark, "t"))).collect() == []
    lost = warc.read_warc(spark.createDataFrame([("file:///no/such.warc.gz",), (None,)], "path string")).collect()
    assert [(r.kind, r.length) for r in lost] == [("gap", -1)]


def test_members_of_several_records():
    parts = [record(i, b"<p>%d</p>" % i * 30, plain=True) for i in range(5)]
    one = gzip.compress(b"".join(parts))
    assert found(one + record(9, b"x")) == ([0, 1, 2, 3, 4, 9], [])
    broken = bytearray(b"".join(parts))
    broken[len(parts[0]) + len(parts[1]) - 40] ^= 0xFF
    bad = gzip.compress(bytes(broken))
    assert found(bad + record(9, b"x")) == ([0, 2, 3, 4, 9], [(0, len(bad))])
    ids, gaps = found(one[:-9] + record(9, b"x"))
    assert set(ids) >= {0, 1, 2, 3, 9} and len(gaps) == 1


def test_records_before_a_break_come_back():
    """Whatever byte breaks a member, the error doesn't take along what came out before."""
    for n in (3, 400):
        parts = [record(i, random.Random(i).randbytes(60), plain=True) for i in range(n)]
        one = gzip.compress(b"".join(parts))
        for at in (-8, -4):  # checksum, size
            broken = bytearray(one)
            broken[at] ^= 0xFF
            ids, gaps = found(bytes(broken) + record(999, b"x"))
            assert ids == [*range(n - 1), 999] and gaps == [(0, len(one))]
    broken = bytearray(one)
    broken[len(one) // 2 : len(one) // 2 + 40] = b"\xff" * 40
    ids, gaps = found(bytes(broken) + record(999, b"x"))
    assert ids == [*range(len(ids) - 1), 999] and len(ids) > 100 and gaps == [(0, len(one))]


def test_a_length_beyond_the_archive_is_not_followed():
    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            self.most = max(self.most, n)
            return super().read(n)

    good = record(1, b"y" * 200, plain=True)
    at = good.rindex(b"Content-Length: ")
    data = good[:at] + b"Content-Length: 99999999999\r\n" + good[good.index(b"\n", at) + 1 :] + record(2, b"z", plain=True)
    stream = Counted(data)
    assert [r["page_id"] for r in warc.salvage(stream, len(data)) if r["kind"] == "record"] == [2]
    assert stream.most <= 1 << 20


def test_null_ids_revisit_equal_payloads(spark):
    rows = [(None, "a" * 1000), (2, "a" * 1000), (None, "b" * 1000), (None, "b" * 1000), (5, "c" * 1000), (5, "c" * 1000), (6, None), (7, "d" * 999), (8, "d" * 999)]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string").withColumn("_first", F.lit(1))
    got = sorted((r.page_id or 0, r.payload[:1].decode(), r.refers_to) for r in warc.with_revisits(pages).collect())
    assert got == [(0, "a", 2), (0, "b", None), (0, "b", None), (2, "a", None), (5, "c", None), (5, "c", None), (6, "", None), (7, "d", None), (8, "d", None)]
