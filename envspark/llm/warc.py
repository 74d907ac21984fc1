"""Operator 13, WARC: records compressed one by one with a Zstandard dictionary built from the archive's own records."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import cut, table
from envspark.session import remove_at_end, shared_path

# Magic numbers of the frame format and field names of the archive format.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
DATA_FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

#: An empty skippable frame, whose eight bytes are all ASCII: what the text sink puts behind every row. Decoders pass over it.
BETWEEN = struct.pack("<II", SKIPPABLE_FRAMES[0], 0)

#: Bytes of a record the training of a dictionary looks at; the record is archived whole.
SEEN = 128 << 10

#: Bytes of records handed on at a time.
BATCH = 16 << 20

RECORD = "record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string"


def _lines(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{name}: {value}\r\n" for name, value in fields).encode()


def warc_record(kind: str, record_id: str, uri: str | None, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit, which has the answer's header only and names the record that holds the payload.

    The answer's header states the full payload's length in both. Characters a
    URI can't hold are percent-encoded.
    """
    block = b"HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]) + b"\r\n"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if uri is not None:
        fields.append(("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\"")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    else:
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _lines(fields) + b"\r\n" + block + b"\r\n\r\n"


def _info() -> bytes:
    block = _lines([("software", "envspark"), ("format", "WARC File Format 1.1")])
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _lines(fields) + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of at most ``size`` bytes; none where the records are too few or too short to build one from."""
    seen = [r[:SEEN] for r in records]
    try:
        return zstandard.train_dictionary(max(256, min(size, sum(map(len, seen)) // 8)), seen, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: Iterator[bytes], level: int, dictionary_bytes: int, sample_bytes: int) -> Iterator[bytes]:
    """The frames of one archive: the dictionary in a skippable frame, then a frame for each record.

    The dictionary is built from the archive's own first records, as many as
    reach ``sample_bytes``; only these are held.
    """
    first: list[bytes] = []
    held = 0
    for record in records:
        first.append(record)
        held += len(record)
        if held >= sample_bytes:
            break
    if not first:
        return
    built = build_dictionary(first, dictionary_bytes)
    options = {"level": level, "write_checksum": True, "write_content_size": True}
    if built is None:
        writer = zstandard.ZstdCompressor(**options)
    else:
        built.precompute_compress(level=level)
        writer = zstandard.ZstdCompressor(dict_data=built, **options)
        packed = zstandard.ZstdCompressor(level=19).compress(built.as_bytes())
        yield struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    yield writer.compress(_info())
    yield from map(writer.compress, first)
    first.clear()
    for record in records:
        yield writer.compress(record)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, read from its headers."""
    magic, size = struct.unpack_from("<II", data, at)
    if magic in SKIPPABLE_FRAMES:
        return at + 8 + size
    if magic != DATA_FRAME:
        raise ValueError(f"no frame begins at byte {at}")
    shape = zstandard.get_frame_parameters(data[at : at + 18])
    at += zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last = bool(head & 1)
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)  # a block of one repeated byte holds that byte only
    return at + 4 * shape.has_checksum


def unarchive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    view = memoryview(data)
    reader = zstandard.ZstdDecompressor()
    at = 0
    while at < len(view):
        end = frame_end(view, at)
        magic = struct.unpack_from("<I", view, at)[0]
        if magic == DICTIONARY_FRAME and at == 0:
            held = bytes(view[8:end])
            raw = reader.decompress(held) if held[:4] == struct.pack("<I", DATA_FRAME) else held
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == DATA_FRAME:
            yield reader.decompressobj().decompress(view[at:end])
        at = end


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parsed(record: bytes) -> tuple[dict, bytes]:
    """A record as read: its RECORD columns and its payload. A response's digest and length are taken from its bytes and held against its header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if not head.startswith(b"WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is not whole")
    kind = fields["warc-type"]
    row = {"record_type": kind, "record_id": fields["warc-record-id"].strip("<>"), "target_uri": fields.get("warc-target-uri"), "payload_bytes": None, "payload_digest": None, "refers_to": None}
    if kind not in ("response", "revisit"):
        return row, block
    answer, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    length = int(_fields(answer)["content-length"])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != length):
        raise ValueError(f"the payload of {row['record_id']} is damaged")
    refers = fields.get("warc-refers-to")
    return row | {"payload_bytes": length, "payload_digest": stated, "refers_to": refers and refers.strip("<>")}, payload


def with_first(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Rows (id, url, body, size, digest, first): ``first`` is the smallest id of an equal payload, where that is another id.

    Payloads below ``min_bytes`` have none. Groups are counted on digests before
    they are shuffled; payloads travel once, in a join that can split a group
    of very many.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.select("*", F.octet_length("body").cast("long").alias("size"), F.unhex(F.sha2("body", 256)).alias("digest"))
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("_low"), F.count("*").alias("_n"))
    groups = cut(groups.filter("_n > 1 and _low is not null").select("digest", "_low"))
    later = F.when(~F.col("id").eqNullSafe(F.col("_low")), F.col("_low"))
    return rows.join(groups, "digest", "left").select("id", "url", "body", "size", F.lower(F.hex("digest")).alias("digest"), later.alias("first"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 100, level: int = 3, dictionary_bytes: int = 64 << 10, sample_bytes: int = 2 << 20) -> None:
    """Archives the rows into a new folder, one archive per task, through Spark's text sink and its commit.

    A row's record is ``urn:page:<id>``. Of rows with equal payloads of at least
    ``min_bytes`` bytes, that with the smallest id is a response and the others
    revisit it; rows that repeat that id and payload are responses too. Null
    payloads are empty, null urls are left out, a null id gives ``urn:page:``
    and comes after all others. Long payloads are archived whole. Other columns
    are not read. An empty table gives a folder without archives.

    An archive is a Zstandard file: dictionary, records, and an empty skippable
    frame behind each, which is the sink's line end. Its dictionary comes from
    its first ``sample_bytes`` bytes of records; an archive too small for one
    has none.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for k in range(batch.num_rows):
                    x = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                    own, other = (f"urn:page:{'' if v is None else v}" for v in (x["id"], x["first"]))
                    kind = "response" if x["first"] is None else "revisit"
                    yield warc_record(kind, own, x["url"], x["digest"], x["size"], x["body"], other if kind == "revisit" else None)

        held: list[bytes] = []
        size = 0
        for frame in archive(records(), level, dictionary_bytes, sample_bytes):
            held.append(frame)
            size += len(frame)
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    rows = with_first(pages, id_col, url_col, body_col, min_bytes).mapInArrow(frames, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", BETWEEN.decode()).text(folder)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of a folder's archives, whoever wrote them: RECORD, and with ``payloads`` the bytes of their payloads.

    Digest and length are the full payload's; a revisit's are those it states.
    Damaged archives and records fail the job.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in rows[0]], list(rows[0]))

        for files in batches:
            for data in files.column(0):
                rows: list[dict] = []
                size = 0
                for row, payload in map(parsed, unarchive(data.as_py())):
                    rows.append(row | ({"payload": payload} if payloads else {}))
                    size += 256 + len(payload) * payloads
                    if size >= BATCH:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("content").mapInArrow(records, RECORD + (", payload binary" if payloads else ""))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, f"warc-{uuid.uuid4().hex}")
    write_warc(table(spark, sf_dir, "pages"), folder)
    remove_at_end(spark, folder)
    found = read_warc(spark, folder, payloads=False).filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.substring(F.col(c), len("urn:page:") + 1, 20).try_cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS low FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN low IS NULL OR page_id IS NOT DISTINCT FROM low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM f
"""
