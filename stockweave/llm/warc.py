"""WARC archives with an embedded Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the archive's own
records; after it each record is a Zstandard frame of its own. Archives are rows of a table (archive, n_records,
data): Spark's writer puts them on any store that the cluster shares and replaces what lost executors had written;
export() saves them as files.

Of records with equal payloads of at least min_bytes bytes, that with the largest page_id is a response and the others
are revisits that refer to it. Payloads are compared by SHA-256.

Nulls: a null html is an empty payload, a null url becomes urn:page:<page_id>; a null page_id is kept, and is the
response of its payload only if no other row has it. Repeated rows of the largest page_id are all responses, and so are
other ties. Very long payloads are one record, and an archive that reaches ARCHIVE_BYTES with one is closed; only its
first 64 KB are looked at for the dictionary. That is built from a sample: records spread evenly over the archive, of
SAMPLE_BYTES to twice as many. An empty table gives no archives. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import returning_memory, slices, staged

SKIPPABLE = 0x184D2A5D
MIN_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 16 << 10
#: Bytes of records that a dictionary is built from, at most, spread over the archive.
SAMPLE_BYTES = 1 << 20
LEVEL = 6
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record; refers_to None makes it a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}\r\n\r\n"]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """A trained dictionary, or, of too few records, their raw content."""
    import zstandard as zstd

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples, held = [], 0
    for r in records[::step]:
        samples.append(r[: 64 << 10])
        held += len(samples[-1])
        if held > 2 * SAMPLE_BYTES:
            break
    try:
        return zstd.train_dictionary(min(DICT_BYTES, max(1024, held // 8)), samples, k=256, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes]) -> bytes:
    import zstandard as zstd

    words = build_dictionary(records)
    raw = words.as_bytes()
    frame = zstd.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(frame.compress, records)])


def _frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame that starts at a place, found from its block headers."""
    import zstandard as zstd

    head = bytes(data[at : at + 18])
    checksum = zstd.get_frame_parameters(head).has_checksum
    at += zstd.frame_header_size(head)
    while True:
        header = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            return at + 4 * checksum


def read_archive(data: bytes) -> Iterator[bytes]:
    import zstandard as zstd

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    raw = data[8 : 8 + size]
    kind = zstd.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    frames = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=kind))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        end = _frame_end(view, at)
        yield frames.decompress(view[at:end])
        at = end


def parse(rec: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record; checks the digest."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda x: None if x in (None, "<urn:page:None>") else int(x[len("<urn:page:") : -1])
    return page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], page(fields.get("WARC-Refers-To")), payload


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def close() -> pa.RecordBatch:
        data = write_archive(held)
        name = hashlib.sha1(data).hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([data], pa.binary())], names=["archive", "n_records", "data"])

    held, size = [], 0
    for b in slices(batches):
        for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for b in batches:
        for data in b.column(0):
            rows = [parse(r)[:6] for r in read_archive(data.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def write_warc(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The archives of pages, as a table in the shared folder. Copies are dealt over salted partitions."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("_digest", F.when(F.octet_length(html) >= min_bytes, F.unhex(F.sha2(html, 256))))
    firsts = rows.where("_digest IS NOT NULL").groupBy("_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(firsts, ["_digest", "_salt"], "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    archives = rows.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(returning_memory(_archives), "archive string, n_records long, data binary")
    return staged(archives, "warc")


def read_warc(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record."""
    return archives.select("data").mapInArrow(returning_memory(_records), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, folder: str) -> int:
    """Save each archive as <name>.warc.zst in a local folder, one at a time; returns how many."""
    n = 0
    for n, row in enumerate(archives.select("archive", "data").toLocalIterator(), 1):
        with io.open(f"{folder}/{row.archive}.warc.zst", "wb") as f:
            f.write(row.data)
    return n


def op8_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("url")


ORACLE = r"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS h, strlen(COALESCE(html, '')) AS n FROM pages),
g AS (SELECT *, MAX(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
