import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from envspark.llm import warc


def archives(folder):
    return [p.read_bytes() for p in sorted(folder.glob("part-*")) if p.stat().st_size]


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<p>" + "x y z " * 500_000
    rows = [
        (5, "http://a.org/", "same " * 30), (3, "http://b.org/", "same " * 30), (9, None, "same " * 30), (3, "http://b.org/", "same " * 30), (None, "http://n.org/", "same " * 30),
        (7, "http://short.org/", "short"), (8, "http://short.org/", "short"), (10, "x", None), (11, "", ""), (12, "http://c.org/a b\r\nWARC-Type: revisit%0d é", "é" * 50), (13, "http://d.org/", "é" * 50),
        (14, "u", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\nP*M\x18\0\0\0\0" + "q" * 99), (15, "u", big), (16, "u", big), (None, None, None), (17, "u", "a" * 99), (18, "u", "a" * 99), (19, "u", "a" * 100), (20, "u", "a" * 100),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    out = []
    for r in rows:
        body = (r.html or "").encode()
        alike = [x.page_id for x in rows if (x.html or "").encode() == body and x.page_id is not None]
        low = min(alike) if alike and len(body) >= 100 else r.page_id
        out.append((r.page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if low == r.page_id else "revisit", None if low == r.page_id else low))
    return sorted(out, key=repr)


def read_pages(spark, folder):
    page = lambda c: F.regexp_extract(c, r"^urn:page:(\d*)$", 1)
    rows = warc.read_warc(spark, folder).filter("record_type <> 'warcinfo'").withColumns({"page_id": page("record_id"), "low": page("refers_to")}).collect()
    return sorted(((int(r.page_id) if r.page_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.low) if r.low else None) for r in rows), key=repr), rows


def test_round_trip_of_odd_rows(spark, odd_pages, clashing, tmp_path):
    warc.write_warc(clashing(odd_pages), str(tmp_path / "w"))
    found, rows = read_pages(spark, str(tmp_path / "w"))
    assert found == brute(odd_pages.collect())
    bodies = {r.page_id: (r.html or "").encode() for r in odd_pages.collect() if r.page_id is not None}
    for r in rows:
        if r.record_type == "response" and r.page_id:
            assert bytes(r.payload) == bodies[int(r.page_id)]
        elif r.record_type == "revisit":
            assert bytes(r.payload) == b""
    uris = {r.page_id: r.target_uri for r in rows}
    assert uris["12"] == "http://c.org/a%20b%0D%0AWARC-Type:%20revisit%0d%20%C3%A9" and uris["9"] is None and uris["5"] == "http://a.org/"


def test_any_decoder_reads_the_archives(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    (data,) = archives(tmp_path / "w")
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert words.dict_id() and zstandard.get_frame_parameters(next(data[a:] for a in [8 + size + 8])).dict_id == words.dict_id()
    whole = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(warc.unarchive(data))
    assert whole.count(b"WARC/1.1\r\n") == pages.count() + 1
    assert len(data) < 0.8 * sum(len(zstandard.compress(x, 3)) for x in warc.unarchive(data))


def test_frames_of_other_writers():
    noise = bytes(range(256)) * 2000
    texts = [b"", b"a" * 300_000, noise, b"short"]
    for options in ({"write_checksum": True}, {"write_checksum": False}, {"level": -5, "write_content_size": False}):
        data = b"".join(struct.pack("<II", 0x184D2A53, 3) + b"abc" + zstandard.ZstdCompressor(**options).compress(x) for x in texts)
        assert list(warc.unarchive(data)) == texts
    plain = zstandard.train_dictionary(1000, [b"record %d of many " % i * 9 for i in range(500)])
    data = struct.pack("<II", 0x184D2A5D, len(plain)) + plain.as_bytes() + zstandard.ZstdCompressor(dict_data=plain).compress(b"record 7 of many")
    assert list(warc.unarchive(data)) == [b"record 7 of many"]


def test_damage_is_noticed():
    record = warc.warc_record("response", "urn:page:1", "u", hashlib.sha256(b"body").hexdigest(), 4, b"body", None)
    assert warc.parsed(record)[1] == b"body"
    for broken in (record.replace(b"\r\nbody", b"\r\nbodx"), record[:-3]):
        with pytest.raises(ValueError):
            warc.parsed(broken)
    with pytest.raises(ValueError):
        list(warc.unarchive(b"no archive at all"))


def test_no_pages(spark, odd_pages, tmp_path):
    warc.write_warc(odd_pages.limit(0), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_a_dictionary_only_where_one_can_be_built():
    few = list(warc.archive(iter([b"one"]), 3, 1000, 1000))
    assert list(warc.unarchive(b"".join(few)))[1:] == [b"one"]
    many = [b"<html><p>record number %d of this archive</p></html>" % i for i in range(2000)]
    frames = list(warc.archive(iter(many), 3, 4096, 20_000))
    assert struct.unpack_from("<I", frames[0])[0] == 0x184D2A5D and list(warc.unarchive(b"".join(frames)))[1:] == many
