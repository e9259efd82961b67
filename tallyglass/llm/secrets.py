"""Secret scans: fixed patterns, and tokens too random to be words.

A token is a longest run of letters, digits, + / - and _; its encoding is the smallest alphabet that holds it.
Long tokens stand a battery under the hypothesis of randomness (chi-squared uniformity of the alphabet, runs on two sides
of it, serial correlation), which must not be rejected. Their p-value is the chance that ordinary text of the same
length and encoding looks as random: the same three statistics under the symbol and pair frequencies of all shorter
tokens of that encoding in the corpus, weighed by how far randomness would shift each. Benjamini and Hochberg's rule over all tokens of
the corpus, with weights by length (a short token can hardly be told from words), keeps false discoveries below a rate.

Texts are read once. What leaves the tasks are spans, a few numbers for each long token, and tables of fixed size: pairs
of 66 symbols by encoding, and counts by encoding, length class and level of p.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import saved, text_chunks

#: The kinds in their order; the method's own is the last.
KINDS = ("assign", "access", "hex", "random")
# Fixed patterns of the base kinds, on UTF-8 bytes (they hold ASCII only), and their least lengths.
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Least length of a tested token, level of the battery and rate of false discoveries.
LEAST, LEVEL, RATE = 20, 0.001, 0.01

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = _DIGITS + _LOWER + _UPPER + "+/-_"
#: Encodings by size of alphabet, in the order of their symbols' values.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "upper hex": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "upper base36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_NAMES = list(ENCODINGS)
_N = len(_SYMBOLS)
_INDEX = np.full(256, -1, np.int16)
_INDEX[np.frombuffer(_SYMBOLS.encode(), np.uint8)] = np.arange(_N)
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(ENCODINGS["hex"].encode(), np.uint8)] = True
#: The value of each symbol in each encoding; -1 if it is none of its.
_VALUE = np.array([[alphabet.find(s) for s in _SYMBOLS] for alphabet in ENCODINGS.values()])

#: Symbols on the upper side, for runs: where an alphabet has letters and others, or small letters and others, these,
#: and otherwise the upper half. Ordinary tokens seldom change between such sides.
_SIDES = {
    **{k: set(a[len(a) // 2 :]) for k, a in ENCODINGS.items() if k in ("decimal", "lower", "upper")},
    **{k: {c for c in a if c.isalpha()} for k, a in ENCODINGS.items() if k in ("hex", "upper hex", "base32", "base36", "upper base36")},
    **{k: set(_LOWER) for k in ("letters", "base62", "base64", "base64url")},
}
_HIGH = np.array([[s in _SIDES[k] for s in _SYMBOLS] for k in ENCODINGS])

# Groups of symbols that encodings have whole or not at all, as bits, and the encoding of each set of groups.
_GROUPS = ("0189", "234567", "abcdef", _LOWER[6:], "ABCDEF", _UPPER[6:], "+/", "-_")
_GROUP = np.array([sum(1 << i for i, g in enumerate(_GROUPS) if s in g) for s in _SYMBOLS], np.uint8)
_OF_GROUPS = np.array([next((e for e, a in enumerate(ENCODINGS.values()) if all(g[0] in a for i, g in enumerate(_GROUPS) if mask >> i & 1)), -1) for mask in range(256)])

_TESTED = "start long, end long, encoding int, equal long, changes long, ones long, serial double"
_SCANNED = f"base array<struct<kind: int, start: long, end: long>>, tested array<struct<{', '.join(f.replace(' ', ': ') for f in _TESTED.split(', '))}>>, pairs array<long>"


def measured(symbols: np.ndarray) -> tuple[int, int, int, int, float] | None:
    """(encoding, equal, changes, ones, serial) of a token's symbols; None if no encoding holds them.

    equal: ordered pairs of equal symbols, which is chi-squared but for constants; changes: neighbours on
    different sides of the alphabet; ones: symbols on its upper side; serial: lag-one correlation of
    the values (1 if they are all equal).
    """
    e = int(_OF_GROUPS[np.bitwise_or.reduce(_GROUP[symbols])])
    if e < 0:
        return None
    x = _VALUE[e][symbols]
    n = np.bincount(x)
    high = _HIGH[e][symbols]
    d = x - x.mean()
    square = float((d * d).sum())
    return e, int((n * (n - 1)).sum()), int((high[1:] != high[:-1]).sum()), int(high.sum()), float((d[1:] * d[:-1]).sum() / square) if square else 1.0


def _runs(solid: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``solid``; none goes beyond a row, ``rows`` being their starts."""
    before, after = np.zeros(len(solid), bool), np.zeros(len(solid), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    first = rows[rows < len(solid)]
    before[first] = False
    after[first[first > 0] - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def _ordinary(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of (encoding, symbol, next symbol) in tokens of ``lengths`` that lie one behind the other."""
    if not len(symbols):
        return np.zeros(len(ENCODINGS) * _N * _N, np.int64)
    starts = np.cumsum(lengths) - lengths
    encoding = np.repeat(_OF_GROUPS[np.bitwise_or.reduceat(_GROUP[symbols], starts)], lengths)
    last = np.zeros(len(symbols), bool)
    last[starts + lengths - 1] = True
    at = np.flatnonzero(~last & (encoding >= 0))
    return np.bincount((encoding[at] * _N + symbols[at]) * _N + symbols[at + 1], minlength=len(ENCODINGS) * _N * _N)


def _scan(batches):
    """Base spans and long tokens of each row; a task's last row has the pairs of symbols in its ordinary tokens."""
    pairs = np.zeros(len(ENCODINGS) * _N * _N, np.int64)
    id_type = None
    for b in batches:
        id_type = b.schema.field("id").type
        base, tested = [], []
        for first, last, o, data in text_chunks(b):
            index = _INDEX[data]
            solid = index >= 0
            upto = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=upto[1:])
            starts, ends = _runs(solid, o[:-1])
            long = ends - starts >= LEAST
            tokens = starts[long], ends[long]
            short = np.repeat(~long, ends - starts)
            pairs += _ordinary(index[solid][short], (ends - starts)[~long])
            starts, ends = _runs(_HEX[data], o[:-1])
            long = ends - starts >= LEAST_HEX
            hexes = starts[long], ends[long]
            raw = data.tobytes()
            in_row = [{} for _ in range(2)]
            for k, (starts, ends) in enumerate((tokens, hexes)):
                for r, i, j in zip((np.searchsorted(o, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
                    in_row[k].setdefault(r, []).append((i, j))
            for r in range(last - first):
                low, high = int(o[r]), int(o[r + 1])
                spans = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(raw, low, high) if m.end(1) - m.start(1) >= LEAST_VALUE]
                if raw.find(b"AKIA", low, high) >= 0:
                    spans += [(1, m.start(), m.end()) for m in _ACCESS.finditer(raw, low, high) if m.end() - m.start() >= LEAST_ACCESS]
                spans += [(2, i, j) for i, j in in_row[1].get(r, ())]
                spans.sort(key=lambda s: (s[1], s[0]))
                told = []
                for i, j in in_row[0].get(r, ()):
                    if not any(s[1] < j and i < s[2] for s in spans):
                        found = measured(index[i:j])
                        if found:
                            told.append((i, j, *found))
                place = lambda p: int(upto[p] - upto[low])  # noqa: B023, E731
                base.append([(k, place(i), place(j)) for k, i, j in spans])
                tested.append([(place(t[0]), place(t[1]), *t[2:]) for t in told])
        yield _batch(b.column("id"), base, tested, [None] * b.num_rows)
    if id_type is not None:
        yield _batch(pa.nulls(1, id_type), [None], [None], [pairs.tolist()])


_BASE_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_TESTED_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("equal", pa.int64()), ("changes", pa.int64()), ("ones", pa.int64()), ("serial", pa.float64())]))


def _batch(ids, base, tested, pairs):
    named = lambda rows, names: [None if r is None else [dict(zip(names, x)) for x in r] for r in rows]
    columns = [pa.array(named(base, ("kind", "start", "end")), _BASE_TYPE), pa.array(named(tested, ("start", "end", "encoding", "equal", "changes", "ones", "serial")), _TESTED_TYPE), pa.array(pairs, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["id", "base", "tested", "pairs"])


# The tests


def _tail(z: float) -> float:
    """The chance that a standard normal number is ``z`` at least."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def random_p(size: int, length: int, equal: int, changes: int, ones: int, serial: float) -> float:
    """The least p-value of the battery if symbols are independent and uniform, times the number of tests.

    chi-squared by Wilson and Hilferty's cube root, runs given the numbers on both sides, serial
    correlation by its normal limit; all two-sided.
    """
    chi = max(size * (equal + length) / length - length, 0.0)
    df = size - 1
    z1 = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    two = 2 * ones * (length - ones)
    spread = two * (two - length) / (length * length * (length - 1))
    z2 = (changes - two / length) / math.sqrt(spread) if spread > 0 else math.inf
    z3 = (serial + 1 / length) * math.sqrt(length)
    return min(1.0, 3 * min(2 * _tail(abs(z)) for z in (z1, z2, z3)))


#: Pairs that all tokens' frequencies weigh among those of an encoding's own; tokens that are drawn for a null
#: distribution, and their greatest length (longer ones take that one's).
SHARED, DRAWN, LONGEST = 1_000, 2_000, 256


class Ordinary:
    """What ordinary tokens of one encoding look like: a chain of symbols by the counts of their pairs.

    The pairs of the encoding's own tokens count, and as ``SHARED`` more those of all tokens in its symbols (letters of
    both cases where it has one), of which one of each is added.
    """

    def __init__(self, encoding: int, pairs: np.ndarray):
        value, alphabet = _VALUE[encoding], list(ENCODINGS.values())[encoding]
        here = np.flatnonzero(value >= 0)
        size = len(here)
        order = here[np.argsort(value[here])]
        row = np.array([alphabet.find(s) if s in alphabet else alphabet.find(s.swapcase()) for s in _SYMBOLS])
        row[row < 0] = size
        shared = np.zeros((size + 1, size + 1))
        np.add.at(shared, (row[:, None], row[None, :]), pairs.sum(0))
        shared = shared[:size, :size] + 1
        n = pairs[encoding][np.ix_(order, order)] + SHARED * shared / shared.sum()
        p, q = n / n.sum(), n.sum(1) / n.sum()
        self.high = _HIGH[encoding][order]
        self.following = np.cumsum(n / n.sum(1, keepdims=True), 1)
        self.q, self.size, self.s2, self.s3 = q, size, float((q**2).sum()), float((q**3).sum())
        x = np.arange(size) - q @ np.arange(size)
        self.change = float(np.clip(p[self.high[:, None] != self.high[None, :]].sum(), 1e-9, 1 - 1e-9))
        self.expected = float(2 * self.high.mean() * (1 - self.high.mean()))  # changes of random symbols
        self.serial = float((p * np.outer(x, x)).sum() / (q @ (x * x)))
        self.null = lru_cache(None)(self._null)

    def combined(self, length, equal, changes, serial):
        """The three statistics towards randomness, weighed by how far it would shift each."""
        every = length * (length - 1)
        spread = math.sqrt(max(2 * every * (self.s2 - self.s2**2) + 4 * every * (length - 2) * (self.s3 - self.s2**2), 1e-12))
        root = math.sqrt((length - 1) * self.change * (1 - self.change))
        d = (max(every * (self.s2 - 1 / self.size) / spread, 0.0), abs(self.expected - self.change) * (length - 1) / root, abs(self.serial) * math.sqrt(length))
        z = ((every * self.s2 - equal) / spread, (changes - (length - 1) * self.change) / root * (1 if self.change < self.expected else -1), (self.serial - serial) * math.sqrt(length) * (1 if self.serial > 0 else -1))
        return sum(a * b for a, b in zip(d, z)) / max(math.hypot(*d), 1e-12)

    def _null(self, kind: int) -> tuple[float, float]:
        """Mean and spread of ``combined`` for tokens of a length class, from tokens drawn from the chain.

        The spread is the standard deviation or, if more, what the highest thousandth asks for.
        """
        length = min(least_length(kind), LONGEST)
        rng = np.random.default_rng([self.size, length])
        x = np.empty((DRAWN, length), np.int64)
        x[:, 0] = np.minimum((np.cumsum(self.q)[None, :] < rng.random((DRAWN, 1))).sum(1), self.size - 1)
        for t in range(1, length):
            x[:, t] = np.minimum((self.following[x[:, t - 1]] < rng.random((DRAWN, 1))).sum(1), self.size - 1)
        n = np.stack([(x == s).sum(1) for s in range(self.size)], 1)
        high = self.high[x]
        d = x - x.mean(1, keepdims=True)
        square = (d * d).sum(1)
        serial = np.where(square > 0, (d[:, 1:] * d[:, :-1]).sum(1) / np.maximum(square, 1e-12), 1.0)
        got = self.combined(length, (n * (n - 1)).sum(1), (high[:, 1:] != high[:, :-1]).sum(1), serial)
        mean = float(got.mean())
        return mean, max(float(got.std()), (float(np.quantile(got, 0.999)) - mean) / 3.09, 1e-6)

    def p(self, length: int, equal: int, changes: int, serial: float) -> float:
        """The chance that an ordinary token of this length looks as random as this."""
        mean, spread = self.null(length_class(length))
        return _tail((float(self.combined(length, equal, changes, serial)) - mean) / spread)

    def shift(self, kind: int) -> float:
        """How many spreads random tokens of a class lie beyond ordinary ones."""
        mean, spread = self.null(kind)
        length = least_length(kind)
        random = self.combined(length, length * (length - 1) / self.size, (length - 1) * self.expected, 0.0)
        return max((float(random) - mean) / spread, 0.0)


#: Steps of -log10 p for each unit, and the highest that counts are kept for.
_STEPS, _TOP = 64, 20


def length_class(length: int) -> int:
    """Four classes to each doubling."""
    return int(4 * math.log2(length))


def least_length(kind: int) -> int:
    return max(2, math.ceil(2 ** (kind / 4)))


def level_of(p: float) -> int:
    """The level of a p-value, rounded so that the level's own p-value is not below it."""
    return _TOP * _STEPS if p <= 0 else max(0, min(_TOP * _STEPS, math.floor(-math.log10(p) * _STEPS)))


class Battery:
    """Levels of tokens by the pair counts of a corpus."""

    def __init__(self, pairs: np.ndarray, level: float):
        self.pairs, self.level = pairs, level
        self.ordinary = lru_cache(None)(lambda e: Ordinary(e, self.pairs))

    def __call__(self, t: dict) -> tuple[int, int, int]:
        """(encoding, length class, level) of a tested token; what is not random has level 0, a p-value of 1."""
        length, e = t["end"] - t["start"], t["encoding"]
        model = self.ordinary(e)
        if random_p(model.size, length, t["equal"], t["changes"], t["ones"], t["serial"]) < self.level:
            return e, length_class(length), 0
        return e, length_class(length), level_of(model.p(length, t["equal"], t["changes"], t["serial"]))

    def weight(self, encoding: int, kind: int) -> float:
        return self.ordinary(encoding).shift(kind)


def accepted(counts: dict[tuple[int, int, int], int], weight, rate: float) -> dict[tuple[int, int], int]:
    """The least level that counts as a discovery, by encoding and length class.

    Weighted Benjamini-Hochberg: a p-value is divided by its class's weight, of mean 1 over all tests;
    of the m weighted values, the largest t with t x m <= rate x (number at t or below) is the limit.
    """
    m = sum(counts.values())
    raw = {(e, k): weight(e, k) for e, k, _ in counts}
    mean = sum(raw[e, k] * n for (e, k, _), n in counts.items()) / m if m else 0
    if not mean:
        return {}
    scaled = sorted((10 ** (-lv / _STEPS) / (raw[e, k] / mean), n) for (e, k, lv), n in counts.items() if raw[e, k] > 0)
    limit, seen = 0.0, 0
    for t, n in scaled:
        seen += n
        if t * m <= rate * seen:
            limit = t
    out = {}
    for (e, k), w in raw.items():
        if limit and w:
            # the least level whose own weighted p-value is within the limit
            levels = [lv for (e2, k2, lv) in counts if (e2, k2) == (e, k) and lv and 10 ** (-lv / _STEPS) / (w / mean) <= limit]
            if levels:
                out[e, k] = min(levels)
    return out


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", level: float = LEVEL, rate: float = RATE) -> DataFrame:
    """``key`` and found, an array of (kind, start, end, method) in the order of start, then kind.

    Positions are code points, ends exclusive. ``method`` marks the spans that the battery adds; none of them meets a
    base span. Null texts are empty and have no spans; texts are read whole; each of repeated rows is found
    in for itself (and counts as a test of its own); an empty table gives an empty one. Columns other than ``key``
    and ``text`` are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    scanned = saved(docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(_scan, f"id {kind}, {_SCANNED}"))
    pairs = np.zeros(len(ENCODINGS) * _N * _N, np.int64)
    for row in scanned.filter("pairs IS NOT NULL").select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).filter("n > 0").collect():
        pairs[row["at"]] = row["n"]
    pairs = pairs.reshape(len(ENCODINGS), _N, _N)
    sent = spark.sparkContext.broadcast(pairs)
    rows = scanned.filter("pairs IS NULL")

    def levels(batches):
        battery, seen = Battery(sent.value, level), {}
        for b in batches:
            for tested in b.column(0).to_pylist():
                for t in tested:
                    at = battery(t)
                    seen[at] = seen.get(at, 0) + 1
        keys = list(zip(*seen)) if seen else [[]] * 3
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(list(seen.values()), pa.int64())], names=["encoding", "class", "level", "n"])

    counted = rows.filter(F.size("tested") > 0).select("tested").mapInArrow(levels, "encoding int, class int, level int, n long")
    counts = {(r["encoding"], r["class"], r["level"]): r["n"] for r in counted.groupBy("encoding", "class", "level").agg(F.sum("n").alias("n")).collect()}
    limits = accepted(counts, Battery(pairs, level).weight, rate)

    def chosen(batches):
        battery = Battery(sent.value, level)
        for b in batches:
            out = []
            for base, tested in zip(b.column("base").to_pylist(), b.column("tested").to_pylist()):
                spans = [(s["start"], s["kind"], s["end"]) for s in base]
                for t in tested:
                    e, k, lv = battery(t)
                    if lv >= limits.get((e, k), _TOP * _STEPS + 1):
                        spans.append((t["start"], len(KINDS) - 1, t["end"]))
                out.append([{"kind": KINDS[k], "start": i, "end": j, "method": k == len(KINDS) - 1} for i, k, j in sorted(spans)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("method", pa.bool_())])))], names=[key, "found"])

    return rows.mapInArrow(chosen, f"`{key}` {kind}, found array<struct<kind: string, start: long, end: long, method: boolean>>")
