"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared by characters: letters and digits in lower case, each run of others as one
space. A passage that matches an item of m characters with at most k = m * ``edit_rate`` edits
shares at least m - q + 1 - k * q q-grams with it, on diagonals that differ by k at most. With
q = 8 a q-gram is one 64-bit number, of 8 bits of each character; that different characters
may share those only lets more through to the alignment.

1. A lossless pre-test of all texts: some window of w characters of an item has so few of the
   edits that a text region must hold many of the items' q-grams close together. The window is
   chosen from the items' lengths, and a bit table whose size follows the number of their
   q-grams knows them all, so the corpus is read once, however many items there are. Texts
   that may hold an item are written.
2. In those, shared q-grams are counted by item and by overlapping diagonal bands; bands that
   reach the item's bound are kept. Of an item's equal q-grams, which may be many where it
   repeats itself, one stays for each stretch of k positions, and the bands are wider by as
   much: so a text meets an item's q-gram about 1 / ``edit_rate`` times at most.
3. Those bands are verified by an alignment that visits the band's cells alone.

The items are the query set. If their texts are ``BLOCK_BYTES`` at most, steps 2 and 3 know them all
by a broadcast. More items are dealt into blocks of about that size by hash, in one plan whatever
their number: a bit table of q-grams with their block says which blocks a text of step 1 may hold an
item of, and it goes to those alone; a block that many texts go to is copied to several tasks.

Defined cases: null texts match nothing; items of fewer than q characters (or null) cannot be
evidence and match nothing; of several matches of an item in a text that with the fewest
edits, then the first, is told; repeated rows and ids are searched each for itself, a null id
is told as null; rows with equal id and text are kept or dropped together. An empty table on
either side gives no match. A very long text is searched whole. Columns other than doc_id,
text and item_id are not looked at; ``without_leaks`` passes all of them on, whatever their names.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import MOST_BITS, Bits, apart, code_points, fresh, gathered_bits, kept, mix64, saved, slices, text_chunks

Q = 8
EDIT_RATE = 0.05
BLOCK_BYTES = 4 << 20
#: Bytes of texts for which a block of items is copied to one more task.
SLOT_BYTES = 256 << 20
#: Pairs of equal q-grams of a text and the items that are looked at together.
ENTRIES = 2_000_000
#: Bits of the table of all q-grams for each of them.
BITS_EACH = 8
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_SPACE = 0x20
_PLAIN: list[np.ndarray] = []
#: The index that this worker built last, by its name.
_BUILT: dict = {}


def plain() -> np.ndarray:
    """For each code point its lower case if it is a letter or digit, else a space."""
    if not _PLAIN:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalnum():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _PLAIN.append(table)
    return _PLAIN[0]


def normalised(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters to compare, the places among the text's characters that they come from, and where those begin."""
    code, lead = code_points(data)
    d = plain()[code]
    space = d == _SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    if len(keep):
        keep[0] |= bool(space[0])
    at = np.flatnonzero(keep)
    return d[at], at, lead


def item_text(text: str) -> np.ndarray:
    """An item's characters, without spaces around them."""
    d = normalised(np.frombuffer(text.encode(), np.uint8))[0]
    solid = np.flatnonzero(d != _SPACE)
    return d[solid[0] : solid[-1] + 1] if len(solid) else d[:0]


def grams(code: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each character, as a number."""
    if len(code) < Q:
        return np.zeros(0, np.uint64)
    byte = np.ascontiguousarray((code ^ (code >> 8)).astype(np.uint8))
    return np.ndarray((len(code) - Q + 1,), np.uint64, byte, 0, (1,)).copy()


def budget(m: int, edit_rate: float) -> tuple[int, int]:
    """Edits allowed for an item of m characters, and the q-grams it must then share."""
    k = int(m * edit_rate)
    while k and m - Q + 1 - k * Q < 1:
        k -= 1
    return k, m - Q + 1 - k * Q


def window(sizes: list[int], edit_rate: float) -> tuple[int, int]:
    """(hits, positions): a region with a match of an item of any of ``sizes`` has so many hits within so many positions."""
    best = (1, Q)
    for w in (Q, 12, 16, 24, 32, 40, 48, 56, 64, 80, 96, 128):
        needs, slack = [], 0
        for m in sizes:
            part = min(w, m)
            edits = budget(m, edit_rate)[0] // (m // part)
            needs.append(part - Q + 1 - edits * Q)
            slack = max(slack, edits)
        need = min(needs, default=1)
        if need >= 1 and need / (w + slack) > best[0] / (best[1] + Q):
            best = (need, w + slack)
    return best


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float = EDIT_RATE):
        self.ids, self.texts = [], []
        for i, text in items:
            code = item_text(text or "")
            if len(code) >= Q:
                self.ids.append(i)
                self.texts.append(code)
        size = [len(t) for t in self.texts]
        self.k, self.need = (np.array(x, np.int64) for x in zip(*(budget(m, edit_rate) for m in size))) if size else (np.zeros(0, np.int64),) * 2
        all_grams = [grams(t) for t in self.texts]
        g = np.concatenate(all_grams) if all_grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(size)), [len(x) for x in all_grams]) if size else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(x)) for x in all_grams]) if size else np.zeros(0, np.int64)
        cell = pos // np.maximum(self.k, 1)[item] if size else pos
        order = np.lexsort((pos, item, g))
        g, item, pos, cell = g[order], item[order], pos[order], cell[order]
        if len(g):  # one of each item's equal q-grams in each stretch of k positions
            new = np.append(True, (g[1:] != g[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1]))
            g, item, pos = g[new], item[new], pos[new]
        self.keys, self.first, self.count = np.unique(g, return_index=True, return_counts=True)
        self.item, self.pos = item, pos
        self.quick = np.zeros(1 << _BITS, bool)
        self.quick[(self.keys * _GOLD) >> np.uint64(64 - _BITS)] = True


def align(item: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Fewest edits (at most k) of ``item`` against a part of ``text``: (edits, start, end), or None.

    ``text`` is the item's region, in which a match may start at its first n - m + k places:
    only the cells of those diagonals are visited, row by row.
    """
    m, n = len(item), len(text)
    whole = text.tobytes()
    at = whole.find(item.tobytes())
    while at % 4 and at > 0:
        at = whole.find(item.tobytes(), at + 1)
    if at >= 0:
        return 0, at // 4, at // 4 + m
    if not k or n + k < m:
        return None
    width = n - m + 2 * k + 1  # diagonal d of row i is column i - k + d
    d = np.arange(width)
    big = m + n + width
    padded = np.concatenate([np.zeros(k, np.int64), text.astype(np.int64) + 1, np.zeros(k + 1, np.int64)])  # column j at j + k; 0 is no character
    inside = (d - k >= 0) & (d - k <= n)
    row, start = np.where(inside, 0, big), np.where(inside, d - k, 0)
    for i in range(1, m + 1):
        column = i - k + d
        here = padded[i - 1 : i - 1 + width]  # the text's character before each column
        diagonal = row + (here != int(item[i - 1]) + 1)
        above = np.append(row[1:], big) + 1
        above_start = np.append(start[1:], 0)
        take = diagonal <= above
        new, origin = np.where(take, diagonal, above), np.where(take, start, above_start)
        outside = (column < 0) | (column > n)
        new[outside] = big
        # insertions along the row: the least of what lies left, plus the distance
        shifted = new - d
        least = np.minimum.accumulate(shifted)
        come = np.maximum.accumulate(np.where(shifted == least, d, 0))
        row, start = least + d, origin[come]
        row[outside] = big
        if row.min() > k:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(start[end]), m - k + end) if row[end] <= k else None


def counted(index: Index, places: np.ndarray, which: np.ndarray, text: np.ndarray, band: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, band number) of the bands of width 2 ``band`` that hold enough shared q-grams.

    ``places``: where the text's known q-grams are, ``which``: what each is in the index.
    The pairs of equal q-grams are made and counted ``ENTRIES`` at a time.
    """
    n = index.count[which]
    upto = np.cumsum(n)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift, items = np.int64(1 << 32), np.int64(len(index.ids))
    first = 0
    while first < len(places):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + ENTRIES, "right")))
        m = n[first:last]
        entry = np.repeat(index.first[which[first:last]], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        diagonal = np.repeat(places[first:last], m) - index.pos[entry]
        number = (diagonal + half * band + 2 * band) // (2 * band) + (1 << 30)
        key, count = np.unique((np.repeat(text[first:last], m) * items + index.item[entry]) * shift + number, return_counts=True)
        keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, count]), len(keys)).astype(np.int64)
        first = last
    enough = counts >= index.need[(keys // shift) % items]
    keys = keys[enough]
    return keys // shift // items, (keys // shift) % items, keys % shift - (1 << 30)


def search(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Matches in texts that lie one after the other: (text, item, edits, start, end), in characters of the text."""
    clean, at, lead = normalised(data)
    g = grams(clean)
    if not len(g) or not index.ids:
        return []
    places = np.flatnonzero(index.quick[(g * _GOLD) >> np.uint64(64 - _BITS)])
    which = np.searchsorted(index.keys, g[places])
    which[which == len(index.keys)] = 0
    exact = index.keys[which] == g[places]
    places, which = places[exact], which[exact]
    begin = np.searchsorted(lead, offsets)  # where each text begins among the characters
    border = np.searchsorted(at, begin)  # and among the clean ones
    text = np.searchsorted(border, places, "right") - 1
    band = 2 * int(index.k.max()) + 1  # k for the match, as much for the q-grams that were left out
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried = set()
    for half in (0, 1):  # overlapping bands
        for t, i, number in zip(*(x.tolist() for x in counted(index, places, which, text, band, half))):
            left = number * 2 * band - 2 * band - half * band - 2 * int(index.k[i]) - 1
            right = left + 2 * band + len(index.texts[i]) + 4 * int(index.k[i]) + 2
            lo, hi = max(left, int(border[t])), min(right, int(border[t + 1]))
            if (i, lo, hi) in tried or hi <= lo:
                continue
            tried.add((i, lo, hi))
            got = align(index.texts[i], clean[lo:hi], int(index.k[i]))
            if got and got[2] > got[1]:
                edits, a, z = got
                span = (edits, int(at[lo + a] - begin[t]), int(at[lo + z - 1] + 1 - begin[t]))
                if (t, i) not in found or span < found[t, i]:
                    found[t, i] = span
    return [(t, index.ids[i], *v) for (t, i), v in sorted(found.items())]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")


def _pretest(items: DataFrame, edit_rate: float) -> tuple[int, int, int] | None:
    """(log2 of the bits of a table of all q-grams, hits, positions) of the pre-test; None if no item is long enough."""

    def lengths(batches):
        for b in batches:
            n = {len(item_text(t)) for t in b.column("text").to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(n), pa.int64())], names=["n"])

    sizes = [r[0] for r in items.mapInArrow(lengths, "n long").distinct().collect() if r[0] >= Q]  # at most as many as the longest item has characters
    if not sizes:
        return None
    total = items.agg(F.sum(F.length("text"))).first()[0] or 1
    return min(MOST_BITS, max(20, math.ceil(math.log2(BITS_EACH * total)))), *window(sizes, edit_rate)


def dense_texts(hit: np.ndarray, need: int, reach: int, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which texts have ``need`` hits within ``reach`` positions; a region that runs over a border counts for both texts."""
    total = np.zeros(len(hit) + 1, np.int32)
    np.cumsum(hit, out=total[1:])
    dense = np.flatnonzero(total[np.minimum(np.arange(len(hit)) + reach, len(hit))] - total[:-1] >= need)
    edges = np.concatenate([dense, np.minimum(dense + reach, len(at) - 1)])
    return np.unique(np.searchsorted(begin, at[edges], "right") - 1)


def suspects(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` (any columns, with text) that may hold an item: the pre-test."""

    def all_grams(batch):
        for t in batch.column(0).to_pylist():
            yield grams(item_text(t))

    items = _items(benchmark)
    test = _pretest(items, edit_rate)
    if test is None:
        return docs.limit(0)
    log2, need, reach = test
    sent = docs.sparkSession.sparkContext.broadcast(gathered_bits(items, "text", log2, numbers=all_grams).table)

    def run(batches):
        bits = Bits.of(sent.value)
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for first, _, offsets, data in text_chunks(b):
                clean, at, lead = normalised(data)
                keep[first + dense_texts(bits.has(grams(clean)), need, reach, at, np.searchsorted(lead, offsets[:-1]))] = True
            yield from kept(b, keep)

    return docs.mapInArrow(run, docs.schema)


MATCHES = "doc_id long, key long, item_id long, edits int, start int, end int"


def _matches(docs: DataFrame, benchmark: DataFrame, edit_rate: float, block_bytes: int) -> DataFrame:
    """``matches`` with ``key``, a hash of the text."""
    items = _items(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = saved(suspects(rows, benchmark, edit_rate).withColumn("key", F.xxhash64("text")))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:
        return rows.mapInArrow(_searcher(docs.sparkSession, [tuple(r) for r in items.collect()], edit_rate), MATCHES)
    return _matches_by_blocks(rows, items, edit_rate, math.ceil(size / block_bytes))


def _matches_by_blocks(rows: DataFrame, items: DataFrame, edit_rate: float, blocks: int) -> DataFrame:
    """``MATCHES`` of ``rows`` (doc_id, text, key) with the ``items``, dealt into ``blocks``.

    Each block and slot is a task's run of rows, its items first, then the texts: the task
    builds the index when the first text comes and keeps no text.
    """
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    texts = saved(_sent_to(rows, items, edit_rate, blocks))
    slots = texts.groupBy("block").agg(F.ceil(F.sum(F.octet_length("text")) / F.lit(SLOT_BYTES)).cast("int").alias("slots"))
    slots = saved(slots.withColumn("slots", F.greatest("slots", F.lit(1))))
    copies = items.join(slots, "block").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    copies = copies.select("block", "slot", F.lit(0).alias("kind"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("key"), "text")
    searched_in = texts.join(slots, "block").withColumn("slot", F.pmod(F.xxhash64("doc_id", "key"), F.col("slots")).cast("int"))
    searched_in = searched_in.select("block", "slot", F.lit(1).alias("kind"), F.col("doc_id").alias("id"), "key", "text")
    dealt = copies.unionByName(searched_in).repartition("block", "slot").sortWithinPartitions("block", "slot", "kind")

    def run(batches):
        now, held, index = None, [], None
        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in ("block", "slot", "kind")])
            edges = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(0))).tolist() if b.num_rows else []
            for first, last in zip(edges, [*edges[1:], b.num_rows]):
                block, slot, kind = marks[:, first].tolist()
                some = b.slice(first, last - first)
                if (block, slot) != now:
                    now, held, index = (block, slot), [], None
                if kind == 0:
                    held += zip(some.column("id").to_pylist(), some.column("text").to_pylist())
                else:
                    index = index or Index(held, edit_rate)
                    yield from found_in(index, some, "id")

    return dealt.mapInArrow(run, MATCHES)


def _sent_to(rows: DataFrame, items: DataFrame, edit_rate: float, blocks: int) -> DataFrame:
    """doc_id, key, text, block: each of ``rows`` with the blocks of ``items`` (text, block) that it may hold an item of."""
    schema = "doc_id long, key long, text string, block int"
    test = _pretest(items, edit_rate)
    if test is None:
        return rows.select("doc_id", "key", "text", F.lit(0).alias("block")).limit(0)
    log2, need, reach = test

    def of_block(g: np.ndarray, block: int) -> np.ndarray:
        return mix64(g ^ (np.uint64(block + 1) * _GOLD))

    def all_grams(batch):
        both = batch.column(0)
        for t, block in zip(both.field("text").to_pylist(), both.field("block").to_pylist()):
            yield of_block(grams(item_text(t)), block)

    table = gathered_bits(items.select(F.struct("text", "block").alias("both")), "both", log2, numbers=all_grams).table
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bits = Bits.of(sent.value)
        for b in slices(batches):
            for first, _, offsets, data in text_chunks(b):
                clean, at, lead = normalised(data)
                g, begin = grams(clean), np.searchsorted(lead, offsets[:-1])
                for block in range(blocks):
                    which = dense_texts(bits.has(of_block(g, block)), need, reach, at, begin)
                    if len(which):
                        some = b.take(pa.array(first + which))
                        yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "key", "text")), pa.array(np.full(len(which), block, np.int32))], names=["doc_id", "key", "text", "block"])

    return rows.select("doc_id", "key", "text").mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, start, end (code points of the text) of each item found in a text."""
    return _matches(docs, benchmark, edit_rate, block_bytes).drop("key")


def built(name: str, sent, edit_rate: float) -> Index:
    """The index of a broadcast block of items; a worker builds it once and keeps the last one."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(sent.value, edit_rate)
    return _BUILT[name]


def found_in(index: Index, b: pa.RecordBatch, name: str = "doc_id"):
    """``MATCHES`` of the texts of a batch, whose ids are its column ``name``."""
    rows = []
    ids, keys = b.column(name).to_pylist(), b.column("key").to_pylist()
    for first, _, offsets, data in text_chunks(b):
        rows += [(ids[first + t], keys[first + t], *found) for t, *found in search(index, data, offsets)]
    if rows:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "key", "item_id", "edits", "start", "end"])


def _searcher(spark, items, edit_rate: float):
    sent = spark.sparkContext.broadcast(items)
    name = uuid.uuid4().hex

    def run(batches):
        index = built(name, sent, edit_rate)
        for b in batches:
            yield from found_in(index, b)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``matches`` with production parameters."""
    return matches(docs, benchmark)


def without_leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item is found; all columns stay.

    Rows that match go by id and hash of the text; only rows that may be among them are
    shuffled with their texts.
    """
    number, key, code, there, mine = fresh(docs, "_number", "_key", "_code", "_there", "_mine")
    found = _matches(docs, benchmark, edit_rate, block_bytes).select(F.col("doc_id").alias(there), F.col("key").alias(mine)).distinct()
    found = saved(found.withColumn(code, F.xxhash64(there, mine)))
    keyed = docs.withColumn(number, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(F.col("text").cast("string"))).withColumn(code, F.xxhash64(number, key))
    clear, doubt = apart(keyed, found, code)
    left = doubt.join(found.drop(code), F.col(number).eqNullSafe(F.col(there)) & (F.col(key) == F.col(mine)), "left_anti")
    return clear.select(docs.columns).unionByName(left.select(docs.columns))
