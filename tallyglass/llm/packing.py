"""Best-fit packing of tokenised documents by exact-complement hashing.

1. ``pieces``: each text becomes token ids plus an end id; documents over the
   capacity are cut into full pieces, the first piece taking the remainder.
2. ``plan``: works on the number of pieces of each length (at most ``capacity``
   distinct lengths, however many documents there are). Indexes over single, pair
   and triple length sums find combinations that fill a gap exactly; they are
   consumed in bulk under the availability counts. What is left is packed best-fit,
   longest first, also in bulk.
3. ``pack``: pieces are numbered within their length and looked up in the plan.

Defined cases: a null text is an empty one and has only the end id. Repeated rows
and repeated ids are packed as separate documents. An empty table gives an empty
result. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import saved, slices

CAPACITY = 2048
END_ID = 0
#: Entries of a worker's table of encoded words; beyond it the table starts anew.
CACHE_WORDS = 400_000


class WordEncoder:
    """Byte-level BPE ids of texts, equal to the ``tokenizers`` file's, with a table of words.

    A single space between two characters that are no white space always starts a new
    word in this vocabulary's splitting, so the words between such spaces are encoded
    once each. Texts with any other white space next to a space are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.words: dict[str, bytes | None] = {}

    def _learn(self, new: list[str]) -> None:
        """Encode the words of ``new`` in one go and cut the ids at the words' byte lengths."""
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        self.words.update(dict.fromkeys(new))
        if not plain:
            return
        ids = np.array(self.encode(" " + " ".join(plain)), np.uint32)
        ends = np.cumsum(self.width[ids])
        want = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in plain), np.int64, len(plain)))
        cut = np.searchsorted(ends, want) + 1
        raw, a = ids.astype("<u4").tobytes(), 0
        for w, b in zip(plain, (cut * 4).tolist()):
            self.words[w] = raw[a:b]
            a = b

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def encode_with(self, texts: list[str], added: dict[str, int]) -> list[bytes]:
        """``encode_all``, but each string of ``added`` is a token with the given id, as in the ``tokenizers`` file."""
        if not added:
            return self.encode_all(texts)
        special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))
        parts, upto, between = [], [0], []
        for text in texts:
            at = 0
            for m in special.finditer(text):
                parts.append(text[at : m.start()])
                between.append(np.array([added[m[0]]], "<u4").tobytes())
                at = m.end()
            parts.append(text[at:])
            between.append(b"")
            upto.append(len(parts))
        ids = self.encode_all(parts)
        return [b"".join(x for k in range(a, z) for x in (ids[k], between[k])) for a, z in zip(upto, upto[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; strings that look like added tokens are text."""
        split = [t.split(" ") for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        new = set().union(*(s[1:] for s in split)) - self.words.keys()
        if new:
            self._learn(list(new))
        find, out = self.words.__getitem__, []
        for text, words in zip(texts, split):
            first = words[0]
            if not first or first[-1].isspace():
                out.append(self.whole(text))
                continue
            try:
                out.append(self.whole(first) + b"".join(map(find, words[1:])))
            except TypeError:  # a None: white space beside a space
                out.append(self.whole(text))
        return out


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(ranks_path: str, pattern: str) -> WordEncoder:
    """One encoder for each worker process."""
    if (ranks_path, pattern) not in _ENCODERS:
        _ENCODERS[ranks_path, pattern] = WordEncoder(ranks_path, pattern)
    return _ENCODERS[ranks_path, pattern]


def public_vocabulary() -> tuple[str, str]:
    """Path of the ranks of the installed byte-level vocabulary, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def public_added_tokens() -> dict[str, int]:
    """Added tokens of the installed vocabulary's ``tokenizers`` file, and their ids."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that look at their surroundings are not supported")
    return {t["content"]: t["id"] for t in added}


def pieces(docs: DataFrame, vocabulary: tuple[str, str] | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of each piece.

    ``vocabulary``: path of a rank file and the splitting pattern. It is read on the
    workers; None takes the installed public one, with its added tokens.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        enc = encoder(*(vocabulary or public_vocabulary()))
        added = {} if vocabulary else public_added_tokens()
        for batch in slices(batches, 64):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out: list[list] = [[], [], [], [], []]
            raws = []
            for doc, raw in zip(ids, enc.encode_with([t or "" for t in texts], added)):
                raw += end
                n = len(raw) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity if not start else capacity
                    part = raw[start * 4 : (start + length) * 4]
                    for c, v in zip(out, (doc, piece, start, length, zlib.crc32(part))):
                        c.append(v)
                    if with_ids:
                        raws.append(np.frombuffer(part, "<i4"))
                    start, piece = start + length, piece + 1
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(raws, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class _Stock:
    """How many pieces of each length are left, and an index of the sums of one, two and three lengths.

    The index is built once over the different lengths; what has run out since is skipped
    at look-up.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self.lengths = np.flatnonzero(self.left)
        low, high = (self.lengths[k] for k in np.triu_indices(len(self.lengths)))
        fits = low + high <= capacity
        low, high = low[fits], high[fits]
        order = np.lexsort((-high, low + high))  # by sum, the larger part largest first
        self.low, self.high = low[order], high[order]
        self.sums = np.searchsorted(self.low + self.high, np.arange(capacity + 2))
        self.is_pair = np.diff(self.sums) > 0
        self.is_triple = np.zeros(capacity + 1, bool)
        for a in self.lengths:
            self.is_triple[a:] |= self.is_pair[: capacity + 1 - a]

    def single(self, gap: int):
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int):
        """The two lengths with that sum whose larger part is largest."""
        here = slice(self.sums[gap], self.sums[gap + 1])
        a, b = self.high[here], self.low[here]
        good = np.flatnonzero((self.left[a] > (a == b)) & (self.left[b] > 0))
        return (int(a[good[0]]), int(b[good[0]])) if len(good) else None

    def triple(self, gap: int):
        """Three lengths with that sum: a single one and the pair sum that completes it."""
        if not self.is_triple[gap]:
            return None
        a = self.lengths[(self.lengths <= gap - 2) & (3 * self.lengths >= gap)][::-1]
        for a in a[self.is_pair[gap - a] & (self.left[a] > 0)].tolist():
            self.left[a] -= 1
            rest = self.pair(gap - a)
            self.left[a] += 1
            if rest and rest[0] <= a:
                return (a, *rest)
        return None

    def take(self, lengths: tuple[int, ...], most: int) -> int:
        """How often that combination can be taken, up to ``most``; it is taken."""
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        n = min([most, *(int(self.left[x]) // k for x, k in need.items())])
        for x, k in need.items():
            self.left[x] -= n * k
        return n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths of their pieces, number of such sequences).

    ``counts``: pieces by length, 1 to ``capacity``. Time and size depend on the number
    of distinct lengths, not on the number of pieces.
    """
    stock, out = _Stock(counts, capacity), []
    if stock.left[capacity]:
        out.append(((capacity,), stock.take((capacity,), int(stock.left[capacity]))))
    for length in range(capacity - 1, capacity // 4 - 1, -1):  # the longest of four pieces is a quarter at least
        for find in (stock.single, stock.pair, stock.triple):
            while stock.left[length]:
                stock.left[length] -= 1
                rest = find(capacity - length)
                stock.left[length] += 1
                if not rest or not (n := stock.take((length, *rest), int(stock.left[length]))):
                    break
                out.append(((length, *rest), n))
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # open sequences by what is free
    order: list[int] = []  # those gaps, ascending
    for length in range(capacity, 0, -1):
        n = int(stock.left[length])
        while n:
            k = bisect_left(order, length)
            if k == len(order):  # nowhere: as many new sequences, each with as many of this length as fit
                fit = min(capacity // length, n)
                made, gap, held, new = n // fit, capacity - fit * length, (length,) * fit, n // fit
                n -= made * fit
            else:
                gap = order[k]
                held, there = gaps[gap].pop()
                made = min(there, n)
                if made < there:
                    gaps[gap].append((held, there - made))
                if not gaps[gap]:
                    order.pop(k)
                held, gap, new, n = (*held, length), gap - length, made, n - made
            if gap and not gaps[gap]:
                insort(order, gap)
            if gap:
                gaps[gap].append((held, new))
            else:
                out.append((held, new))
    return out + [x for left in gaps.values() for x in left]


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 20_000) -> DataFrame:
    """``piece_rows`` (doc_id, piece, length and more) with sequence_id and offset.

    The counts by length are all that reaches the driver. A length that many pieces
    share is numbered in buckets of ids, so it is never in one task.
    """
    counts = {int(r[0]): int(r[1]) for r in piece_rows.groupBy("length").count().collect()}
    sequences = plan(counts, capacity)
    slots: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    used: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, n in sequences:
        offset = 0
        for x in lengths:
            slots.append((x, used[x], base, offset))
            used[x] += n
            offset += x
        base += n
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    shift = np.int64(44)

    def place(batches):
        keys = (table[:, 0] << shift) + table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << shift) + rank, "right") - 1
            new = [pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], names=[*names, "sequence_id", "offset"])

    names = piece_rows.columns
    n = max(1, -(-max(counts.values(), default=0) // rows_per_bucket))
    rows = piece_rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(sizes, ["length", "_bucket"])
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece_rows.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The tokenised pieces are written once, so that texts are encoded a single time.
    """
    return pack(saved(pieces(docs, vocabulary, capacity)), capacity)
