"""Helpers that the operators share: tables, the shared folder, word hashing."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.sources.sinks import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here."""
    return saved_at(df)[0]


def saved_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``saved``, and where, for ``forget``."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of ``saved_at`` that nothing reads any more, and let go of the shuffles behind finished ones.

    Executors delete a shuffle's files when the driver's collector finds that nothing refers to it; a driver
    with memory to spare may not collect for long, so it is asked to.
    """
    spark._jvm.System.gc()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fold(name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 4 (2 marks the held-out rows)."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % 4


def fold_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


# Multipliers of the rolling hash (fixed odd numbers) and of its finishing step.
_BASE = 0x9E3779B97F4A7C15
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_KEPT = 1_100_000
_POWER: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; a worker keeps those below ``_KEPT`` only."""
    if len(_POWER[0]) >= n:
        return _POWER[0], _POWER[1]
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(max(n, _KEPT), base, np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    if n <= _KEPT:
        _POWER[:] = out
    return out[0], out[1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, byte starts and byte ends of the runs without ASCII white space; A-Z count as a-z.

    ``data``: UTF-8 bytes as uint8. Equal words have equal hashes; different words
    of a corpus of n words collide with probability about n**2 / 2**65. With ``stem``,
    the hashes are those of each word's first ``stem`` bytes.
    """
    (h,), starts, ends = stem_hashes(data, (stem,))
    return h, starts, ends


def stem_hashes(data: np.ndarray, stems: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``word_hashes`` for several lengths of stems at once (0 is the whole word)."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in stems], none, none
    data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    before, back = total[starts], inverse[starts]
    out = []
    for stem in stems:
        upto = np.minimum(ends, starts + stem) if stem else ends
        out.append(mix64((total[upto] - before) * back + (upto - starts).astype(np.uint64)))
    return out, starts, ends


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and where each begins; broken sequences give any code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[lead].astype(np.uint32)
    if len(lead) == len(data):
        return code, lead
    ends = np.append(data, np.zeros(3, np.uint8))
    for low, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        at = np.flatnonzero((code >= low) & (code < (low + 0x20 if more == 1 else low + 0x10)) & (code < 0x100))
        value = code[at] & mask
        for k in range(1, more + 1):
            value = (value << 6) | (ends[lead[at] + k] & 0x3F)
        code[at] = np.where(value < 0x110000, value, 0) | np.uint32(0x80000000)  # marked as done
    return code & np.uint32(0x7FFFFFFF), lead


def hash_spans(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of ``code`` (uint64) from ``starts`` to ``ends``: equal for equal runs."""
    power, inverse = _powers(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix64((code + np.uint64(1)) * np.uint64(_BASE)) * power[: len(code)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hash(word: str) -> int:
    return int(word_hashes(np.frombuffer(word.encode(), np.uint8))[0][0])


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = 1_000_000):
    """Runs of rows of a batch with about ``most`` bytes of text each.

    Yields (first row, one past the last, byte offsets of the rows, the bytes);
    nulls are empty. A longer text than ``most`` comes alone, and whole.
    """
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        o = offsets[first : last + 1]
        yield first, last, o - o[0], data[o[0] : o[-1]]
        first = last


def slices(batches, rows: int = 512):
    """The batches in smaller ones, so that a task's Python objects are of few rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def flat_lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of ``counts`` consecutive values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


class Bits:
    """A set of 64-bit numbers as a bit table of fixed size: it may say yes falsely, never no falsely."""

    def __init__(self, log2: int = 24):
        self.log2, self.table = log2, np.zeros(1 << (log2 - 3), np.uint8)

    @classmethod
    def of(cls, table: np.ndarray) -> Bits:
        """The set of a table that was filled elsewhere."""
        bits = cls.__new__(cls)
        bits.log2, bits.table = len(table).bit_length() + 2, table
        return bits

    def _place(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(_BASE)) >> np.uint64(64 - self.log2)

    def add(self, x: np.ndarray) -> None:
        p = self._place(x.astype(np.uint64))
        np.bitwise_or.at(self.table, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7))).astype(np.uint8))

    def has(self, x: np.ndarray) -> np.ndarray:
        p = self._place(x.astype(np.uint64))
        return (self.table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0


def kept(batch: pa.RecordBatch, keep: np.ndarray, rows: int = 256):
    """The rows of a batch that ``keep`` marks, some at a time: whole rows pass a task without a second copy of a batch."""
    if keep.all():
        yield batch
        return
    for at in range(0, batch.num_rows, rows):
        some = keep[at : at + rows]
        if some.any():
            yield batch.slice(at, rows).filter(pa.array(some))


def gathered_bits(df: DataFrame, column: str, log2: int = 24, parts: int = 64, numbers=None) -> Bits:
    """The values of a long column as ``Bits``; what reaches the driver is 2**log2 bits at most.

    ``numbers`` gives the 64-bit numbers of a batch of ``column`` where that is no long.

    Tasks fill their own tables; the tables are OR-ed by region in a shuffle, so the
    driver gets each region once, whatever the number of rows.
    """
    region = (1 << (log2 - 3)) // parts

    def fill(batches):
        bits = Bits(log2)
        for b in batches:
            if numbers:
                for some in numbers(b):
                    bits.add(some)
            else:
                bits.add(b.column(0).drop_null().to_numpy().view(np.uint64))
        chunks = bits.table.reshape(parts, region)
        some = [i for i in range(parts) if chunks[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunks[i].tobytes() for i in some], pa.binary())], names=["region", "bits"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("bits"):
                x = np.frombuffer(x.as_py(), np.uint8)
                total = x.copy() if total is None else total | x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["region", "bits"])

    each = df.select(F.col(column) if numbers else F.col(column).cast("long").alias("v")).mapInArrow(fill, "region int, bits binary")
    out = Bits(log2)
    for row in each.groupBy("region").applyInArrow(merge, "region int, bits binary").collect():
        out.table.reshape(parts, region)[row["region"]] = np.frombuffer(row["bits"], np.uint8)
    return out


#: Bits of a table of keys for each of them, and the largest table as a power of two.
BITS_EACH, MOST_BITS = 64, 30


def bits_for(n: int) -> int:
    """log2 of the bits of a table for n keys."""
    return min(MOST_BITS, max(20, math.ceil(math.log2(BITS_EACH * max(1, n)))))


def apart(df: DataFrame, listed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose long ``name`` is certainly not among those of ``listed``, and the rest.

    The tasks know the listed values by a bit table, so only the rest, which is the rows with
    a listed value and a few more, need meet ``listed`` in a join; the others are not shuffled.
    """
    sent = df.sparkSession.sparkContext.broadcast(gathered_bits(listed, name, bits_for(listed.count())).table)

    def side(known: bool):
        def run(batches):
            bits = Bits.of(sent.value)
            for b in batches:
                yield from kept(b, bits.has(b.column(name).to_numpy().view(np.uint64)) == known)

        return run

    return df.mapInArrow(side(False), df.schema), df.mapInArrow(side(True), df.schema)
