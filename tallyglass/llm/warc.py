"""Dictionary-compressed WARC archives: one writer, one reader.

Every archive is a ``.warc.zst`` file: a leading skippable frame with a Zstandard
dictionary built from the archive's own records, then each record as a Zstandard
frame of its own, so that any record can be read without the others. Files are
written by Spark's text writer: a record's frame is a row, and the line separator
is an empty skippable frame, which readers of Zstandard skip. So archives can lie in
any store that Spark writes to. An archive ends at a number of bytes or of frames, whichever
comes first. The writer begins files at a number of rows; an archive that ends by bytes is
filled up to it with empty rows, that is with separators.

Payloads that were seen before become ``revisit`` records without a payload; they
name the record with the smallest id.

Defined cases: a null payload is empty; repeated page ids make repeated records; rows
without an id are archived with an empty id; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import shared_folder

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIP = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of an archive's records: a task keeps them until the dictionary is built. A longer record is an archive of its own.
ARCHIVE_BYTES = 32 << 20
#: Bytes that a dictionary is built from at most, the length of a piece of them, and the dictionary's own size.
SAMPLE_BYTES, PIECE_BYTES, DICTIONARY_BYTES = 1 << 20, 4096, 16 << 10
#: Frames of an archive, the dictionary's included, at most: a longer partition goes on in another file.
ARCHIVE_FRAMES = 4_096


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields)
    return head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("no WARC record")
    fields = dict(x.decode().split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (UTF-8 bytes) and its SHA-1 as hexadecimal digits."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))


def build_dictionary(records: list[bytes]):
    """A dictionary from evenly spaced pieces of all records, taken in turn from wherever in a record they stand.

    Where they are too few or too different to train on, the last of them are the dictionary as they are.
    """
    import zstandard

    pieces = [(r, at) for r in records for at in range(0, len(r), PIECE_BYTES)]
    step = -(-len(pieces) * PIECE_BYTES // SAMPLE_BYTES)
    picked = (k * step + k % step for k in range(-(-len(pieces) // step)))
    sample = [r[at : at + PIECE_BYTES] for r, at in (pieces[min(k, len(pieces) - 1)] for k in picked)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def compressed(records, archive_bytes: int = ARCHIVE_BYTES, most: int = ARCHIVE_FRAMES):
    """The frames of archives of ``archive_bytes`` of records and ``most`` frames, one after the other; all but the last are filled up to ``most``."""
    held, size = [], 0
    for r in records:
        if held and (size + len(r) > archive_bytes or len(held) == most - 1):
            yield from one_archive(held)
            yield from itertools.repeat(b"", most - 1 - len(held))
            held, size = [], 0
        held.append(r)
        size += len(r)
    if held:
        yield from one_archive(held)


def one_archive(records: list[bytes]):
    """The frames of one archive: the dictionary's, built from all of its records, then each record's."""
    import zstandard

    built = build_dictionary(records)
    content = built.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content
    packer = zstandard.ZstdCompressor(level=3, dict_data=built, write_content_size=True)
    for r in records:
        yield packer.compress(r)


def frames(archive: bytes):
    """The records of an archive's bytes, one after the other."""
    import zstandard

    at, unpacker = 0, zstandard.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(archive):
        magic = struct.unpack_from("<I", archive, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", archive, at + 4)[0]
            if magic == DICTIONARY_MAGIC and size:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        job = unpacker.decompressobj()
        out = job.decompress(view[at : at + (1 << 16)])
        end = at + (1 << 16)
        parts = [out]
        while not job.eof:
            if end >= len(archive):
                raise ValueError("the archive ends within a record")
            parts.append(job.decompress(view[end : end + (1 << 20)]))
            end += 1 << 20
        at = min(end, len(archive)) - len(job.unused_data)
        yield b"".join(parts)


def write(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, archive_frames: int = ARCHIVE_FRAMES) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``path``.

    Of records with equal payloads of ``min_bytes`` at least, that with the smallest
    page_id is the response and the others revisit it. Which do is found on ids and
    digests alone; payloads move once at most, dealt by id and digest, so neither one
    host nor one payload fills an archive. Each partition is one archive, or several of
    ``archive_bytes`` of records and ``archive_frames`` frames at most, where Spark's writer begins a new file as well; so
    an archive can be read as one row, whatever the size of pages.
    """
    rows = with_digest(pages)
    ids = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "sha1")
    first = ids.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    later = ids.join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    later = later.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("first_id").alias("refers_to")).distinct()
    marked = rows.join(later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left").select("page_id", "url", "payload", "sha1", "refers_to")

    def records(batches):
        for b in batches:
            for page, url, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                target = "".join(url.split()) or "about:blank"
                fields = [
                    (b"WARC-Type", b"response" if refers is None else b"revisit"),
                    (b"WARC-Record-ID", b"<urn:page:%s>" % (b"" if page is None else str(page).encode())),
                    (b"WARC-Date", b"1970-01-01T00:00:00Z"),
                    (b"WARC-Target-URI", target.encode()),
                    (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(bytes.fromhex(digest))),
                    (b"WARC-Payload-Length", str(len(payload)).encode()),
                ]
                if refers is not None:
                    fields += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", b"<urn:page:%d>" % refers)]
                yield record(fields, payload if refers is None else b"")

    def run(batches):
        out, size = [], 0
        for frame in compressed(records(batches), archive_bytes, archive_frames):
            out.append(frame)
            size += len(frame)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    frame_rows = marked.mapInArrow(run, "frame binary")
    frame_rows.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SKIP).option("maxRecordsPerFile", archive_frames).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``, in full: page_id, record_type, url, payload_digest (bare), payload_bytes (of the full payload), refers_to, block."""

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = []
                for raw in frames(content.as_py()):
                    f, block = parse(raw)
                    page = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response" and sha1_base32(block) != digest:
                        raise ValueError(f"{f['WARC-Record-ID']}: the payload does not match its digest")
                    if f["WARC-Type"] == "response" and len(block) != int(f["WARC-Payload-Length"]):
                        raise ValueError(f"{f['WARC-Record-ID']}: the payload does not have its length")
                    rows.append((page(f["WARC-Record-ID"]), f["WARC-Type"], f["WARC-Target-URI"], digest, int(f["WARC-Payload-Length"]), page(f.get("WARC-Refers-To")), block))
                    if len(rows) >= 512:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    names = ["page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to", "block"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, block binary")


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = shared_folder(pages.sparkSession)
    write(pages, path, min_bytes)
    return read(pages.sparkSession, path)
