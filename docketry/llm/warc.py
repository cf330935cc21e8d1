"""WARC archives whose records share a Zstandard dictionary.

Each task writes its rows to archives of its own.  It trains a dictionary on the
first records (``SAMPLE_BYTES`` at most), puts it in a leading skippable frame
(magic 0x184D2A5D) and compresses every record as a frame of its own with it, so
that any record can be read alone.  With too little to train on, the first
records themselves are the dictionary.  A new archive begins after
``max_bytes``.

Of rows with equal payloads the one with the least id is a ``response``; the others
are ``revisit`` records that name it.  Payloads below ``min_revisit`` bytes are all
responses.  Digests are SHA-1 in base32.

Files are written through pyarrow's file systems, into a folder that the driver and
the executors share, under names that no other attempt uses; only files named in
the returned index count, so attempts that were lost leave nothing but unread
files.  Reading goes over whole archives, not by the index, and checks each
payload's digest.

Nulls: null html is an empty payload, a null url has no target.  A row with a null id
reads back as null; it revisits the least id of its payload, and is a response if no row with that
payload has an id.  Rows with equal id and payload are responses or revisits alike; such twins get
record ids of their own, and what revisits them names the page but no record.  Payloads
are kept whole, each compressed in memory by itself.  Other columns are ignored, whatever their
names.  An empty table writes no archive and reads back empty.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import cut, shared_dir, stored, table

MAGIC = 0x184D2A5D
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 64 << 10
LEVEL = 3
#: Repeated payloads, and revisits, up to this number are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _urn(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {digest}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, twin: bool = False, of_twins: bool = False) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head.append(f"WARC-Record-ID: {f'<urn:uuid:{uuid.uuid4()}>' if page_id is None or twin else _urn(page_id, digest)}")
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
        if not of_twins:
            head.append(f"WARC-Refers-To: {_urn(refers_to, digest)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]):
    """A dictionary of the records' common parts."""
    import zstandard

    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        # slices, so that one long record doesn't stand for all
        sample += [r[i : i + 8192] for i in range(0, min(len(r), 1 << 16), 8192)]
        size += min(len(r), 1 << 16)
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    def __init__(self, folder: str, dictionary) -> None:
        import zstandard
        from pyarrow import fs

        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        data = dictionary.as_bytes()
        self.out.write(struct.pack("<II", MAGIC, len(data)) + data)
        self.at = 8 + len(data)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)

    def add(self, record: bytes) -> tuple[str, int, int]:
        frame = self.packer.compress(record)
        self.out.write(frame)
        self.at += len(frame)
        return self.uri, self.at - len(frame), len(frame)


def _sent(few: DataFrame) -> DataFrame:
    """The rows, sent to every task if they are no more than ``BROADCAST_ROWS``."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = 0, max_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives ``pages`` (page_id, url, html); the index of what was written, from a stored table."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # one row for each id and payload, then what its payload's rows refer to
    known = rows.filter(F.length("payload") >= min_revisit).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("c"))
    known = stored(known, "payloads")
    firsts = known.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.min_by(F.col("c") > 1, "page_id").alias("of_twins"), F.sum("c").alias("n"))
    firsts = _sent(cut(firsts.filter("n > 1").drop("n").withColumnRenamed("sha", "of")))
    again = known.join(firsts, F.col("sha") == F.col("of")).select(
        F.col("page_id").alias("id"), "of", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")).alias("refers_to"), (F.col("c") > 1).alias("twin"), F.coalesce("of_twins", F.lit(False)).alias("of_twins")
    )
    again = _sent(cut(again.filter("refers_to is not null or twin")))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of")), "left")

    columns = ("page_id", "url", "payload", "sha", "refers_to", "twin", "of_twins")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []
        size, archive, dictionary = 0, None, None

        def put(items: list[tuple]) -> pd.DataFrame:
            nonlocal archive
            found = []
            for page_id, kind, record in items:
                if archive is None or archive.at >= max_bytes:
                    if archive is not None:
                        archive.out.close()
                    archive = _Archive(folder, dictionary)
                found.append((page_id, kind, *archive.add(record)))
            frame = pd.DataFrame(found, columns=["page_id", "record_type", "file", "offset", "length"])
            return frame.astype({"page_id": "Int64"})

        for pdf in batches:
            for page_id, url, payload, sha, refers_to, twin, of_twins in zip(*(pdf[c] for c in columns), strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                record = _record(page_id, url, bytes(payload), digest, refers_to, date, twin == True, of_twins == True)  # noqa: E712  null where the payload is alone
                waiting.append((page_id, "response" if refers_to is None else "revisit", record))
                size += len(record)
                if size >= SAMPLE_BYTES:
                    dictionary = dictionary or _dictionary([w[2] for w in waiting])
                    yield put(waiting)
                    waiting, size = [], 0
        if waiting:
            dictionary = dictionary or _dictionary([w[2] for w in waiting])
            yield put(waiting)
        if archive is not None:
            archive.out.close()

    index = rows.select(*columns).mapInPandas(write, INDEX)
    return stored(index, "warc-index")


def _frames(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, in order."""
    import zstandard
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as src:
        magic, n = struct.unpack("<II", src.read(8))
        if magic != MAGIC:
            raise ValueError(f"{uri} doesn't begin with a dictionary")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(src.read(n)))
        left, one, parts = b"", reader.decompressobj(), []
        while data := left or src.read(chunk):
            parts.append(one.decompress(data))
            left = b""
            if one.eof:
                yield b"".join(parts)
                left, one, parts = one.unused_data, reader.decompressobj(), []
        if any(parts):
            raise ValueError(f"{uri} ends within a record")


def _parsed(record: bytes, with_payload: bool) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    payload = block[: int(field["Content-Length"])].partition(b"\r\n\r\n")[2]
    digest, size = field["WARC-Payload-Digest"].removeprefix("sha1:"), int(field["X-Payload-Length"])
    if field["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"a payload differs from its digest: {field['WARC-Record-ID']}")
    number = lambda k: int(field[k]) if k in field else None
    return number("X-Page-ID"), field.get("WARC-Target-URI"), field["WARC-Type"], number("X-Refers-To-Page-ID"), digest, size, payload if with_payload and field["WARC-Type"] == "response" else None


def read_archives(spark: SparkSession, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives named in ``index`` (column file); an archive is read by one task."""
    files = index.select("file").distinct()
    n = max(1, files.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        for pdf in batches:
            for uri in pdf["file"]:
                rows, size = [], 0
                for record in _frames(uri):
                    rows.append(_parsed(record, with_payload))
                    size += len(record)
                    if size >= 16 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    return files.repartition(n, "file").mapInPandas(read, RECORD)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_archives(spark, index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Response or revisit by digest; DuckDB has SHA-1 but no base32, so five bits at a time are looked up.
OP1_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (('0x' || lpad(substr(h || '0000', (i * 5 // 4) + 1, 3), 3, '0'))::INTEGER >> (7 - (i * 5) % 4)) % 32]), '')
  AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, left(payload_digest, 32) AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM b
"""
