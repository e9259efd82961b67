"""Toxicity scores from class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are compared by their log-likelihoods.
For class c, with discount D and counts of word pairs n_c,

    P_c(w | v) = (1 - l(v)) max(n_c(v w) - D, 0) / A_c(v) + l(v) P_c(w)
    P_c(w)     = (1 - l)    max(N_c(. w) - D, 0) / A_c    + l    P_c(s) P(w | s)
    P_c(s)     = (1 - l_s)  max(N_c(. s) - D, 0) / B_c    + l_s  P(k) P(s | k)

N_c(. w) is in how many different words' company w follows (the continuation count), s the
word's stem, its first 6 bytes, and N_c(. s) the sum over its words; A and B are the sums of
what stands above them, so every distribution sums to one. The weights l are the shares of
both classes' counts that the discounts free; l(v) is 1 where a class has nothing left. They
are the same for both classes, so what neither class knows speaks for neither. What
they hand on goes by counts that both classes share: P(w | s) and P(s | k) in proportion to
the continuation counts of both classes together (with one more for all that are not known),
and P(k), the Kneser-Ney continuation over all documents of the class k of the word's first 4
bytes: in how many different classes' company k follows. So expressions that are rare in one
class are smoothed alike, and an unknown word is told by its stem. The start of a text is a
word. D is 3, for the toxic rows are few: what two or three of them happen to say is left to
the shared counts whole.

The class counts come from at most ``max_rows`` labelled rows (chosen by a hash of the
id), every pair of which counts, so the tables have a bounded size. The shared counts cover
every text of ``docs``: tasks hand on their different pairs, which meet in a shuffle and are
counted exactly. First 4 bytes are hashed to 2 ** ``CLASS_BITS`` classes, so that table has a
fixed size whatever the corpus.

The difference of the log-likelihoods is normalised by length in two ways: per word, and, for
words whose own difference is beyond ``STRONG``, per root of the number of words, so that an
insult in a long text is not averaged away. A logistic curve in both, fitted on every fifth
labelled row, which the class counts leave out, turns them into a probability.

Defined cases: a null or empty text has no evidence and gets the curve's value for none;
labels that are null or outside the training folds are not looked at; with no labels of
one class every score is that class's share (0 without any labels). A label that repeats for
an id counts as toxic if one is. Repeated rows are scored each for itself; a null id is not
held out. An empty table gives an empty result. A very long text is scored whole, alone.
Columns other than doc_id, text and toxic are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import fold, fold_of, mix64, saved, stem_hashes, text_chunks

#: Labelled rows that the class counts and the curve are fitted on, at most (about).
MAX_ROWS = 20_000
DISCOUNT = 3
THRESHOLD = 0.3
#: Log-likelihood difference from which on a word counts by itself.
STRONG = 2.5
#: Bytes of the stems: of the shared classes, and of a word's stem; 0 is the whole word.
STEMS = (4, 6, 0)
CLASS_BITS = 20
#: Pairs of classes that a task gathers before it hands on the different ones.
TOGETHER = 4_000_000
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Stands for the start of a text.
START = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that separate words: ASCII characters other than letters.
SEPARATORS = np.ones(256, bool)
SEPARATORS[65:91] = SEPARATORS[97:123] = False
SEPARATORS[128:] = False
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[SEPARATORS] = 0x20


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words of texts that lie one after the other, by stem; the number of words of each text."""
    n = len(offsets) - 1
    offsets, data = offsets + np.arange(n + 1), np.insert(_PLAIN[data], offsets[1:], 0x20)
    found, starts, _ = stem_hashes(data, STEMS)
    return found, np.diff(np.searchsorted(starts, offsets))


def classes(stem: np.ndarray) -> np.ndarray:
    """The shared classes of words, by the hashes of their first bytes."""
    return stem >> np.uint64(64 - CLASS_BITS)


def before(h: np.ndarray, n: np.ndarray, start: np.uint64 = START) -> np.ndarray:
    """What stands before each word: the word before it, or the start of its text."""
    out = np.empty(len(h), np.uint64)
    out[1:] = h[:-1]
    out[(np.cumsum(n) - n)[n > 0]] = start
    return out


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * _PAIR + w)


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in a sorted table; its length for those that it lacks."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, len(table))


def left(n: np.ndarray) -> np.ndarray:
    """What the discount leaves of counts."""
    return np.maximum(n - DISCOUNT, 0).astype(np.float64)


def mixed(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """A level's own probabilities in both classes, with a row of zeros for what it lacks, and the weight that it hands on."""
    own = left(counts)
    handed = 1 - own.sum() / counts.sum() if counts.sum() and (own.sum(0) > 0).all() else 1.0
    return np.concatenate([(1 - handed) * own / np.maximum(own.sum(0), 1e-9), np.zeros((1, 2))]), handed


class Model:
    """Sorted tables of both classes (0 ordinary, 1 toxic), and the curve.

    ``words``: hash, stem, class and the continuation counts (two columns) of each word;
    ``contexts``: hash, both classes' counts and what the discount leaves of them in each class;
    ``pairs``: first word, second word, counts, of the pairs of which it leaves something.
    """

    def __init__(self, words: tuple, contexts: tuple, pairs: tuple):
        w, stem, k, m = words
        order = np.argsort(w)
        self.words, stem, k, m = w[order], stem[order], k[order].astype(np.int64), m[order].astype(np.float64).reshape(-1, 2)
        self.known = m.sum(0)
        self.own_words, self.from_words = mixed(m)
        self.both_words = np.append(m.sum(1), 1.0)
        self.stems, first, of = np.unique(stem, return_index=True, return_inverse=True)
        by_stem = np.stack([np.bincount(of, m[:, c], len(self.stems)) for c in (0, 1)], 1)
        self.own_stems, self.from_stems = mixed(by_stem)
        self.both_stems = np.append(by_stem.sum(1), 0.0)
        self.in_class = np.bincount(k[first], by_stem.sum(1), 1 << CLASS_BITS)
        self.shared = np.full(1 << CLASS_BITS, 2.0**-CLASS_BITS)
        v, n, rest = contexts
        order = np.argsort(v)
        self.contexts, n, rest = v[order], n[order].astype(np.float64), rest[order].astype(np.float64).reshape(-1, 2)
        handed = np.append(np.where((rest > 0).all(1), 1 - rest.sum(1) / np.maximum(n, 1), 1.0), 1.0)
        self.handed = handed.astype(np.float32)
        v, w, n = pairs
        key = pair(v, w)
        order = np.argsort(key)
        self.pairs = key[order]
        at = find(self.contexts, v[order])
        own = (1 - handed[at])[:, None] * left(n.reshape(-1, 2)[order]) / np.concatenate([np.maximum(rest, 1e-9), np.ones((1, 2))])[at]
        self.own_pairs = np.concatenate([own, np.zeros((1, 2))]).astype(np.float32)
        self.curve = np.array([-2.0, 1.0, 1.0])

    def with_continuation(self, company: np.ndarray) -> None:
        """Set P(k): ``company`` has for each class the number of different classes that it follows."""
        self.shared = (company + 0.5) / (company.sum() + 0.5 * len(company))

    def probabilities(self, hashes: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """P_c(w | v) of each word of texts with ``n`` words, in both classes."""
        first, stem, h = hashes
        if not len(h):
            return np.zeros((0, 2))
        words, at, which = np.unique(h, return_index=True, return_inverse=True)  # each different word is looked up once
        k = classes(first[at]).astype(np.int64)
        a, b = find(self.stems, stem[at]), find(self.words, words)
        both = self.both_stems[a]
        p = self.shared[k] * np.where(a < len(self.stems), both, 1.0) / (self.in_class[k] + 1.0)
        p = self.own_stems[a] + self.from_stems * p[:, None]
        p = self.own_words[b] + self.from_words * p * (self.both_words[b] / (both + 1.0))[:, None]
        v = before(h, n)
        handed = np.append(self.handed[find(self.contexts, words)], self.handed[find(self.contexts, np.array([START]))])
        of_before = np.append(len(words), which[:-1])
        of_before[v == START] = len(words)
        return self.own_pairs[find(self.pairs, pair(v, h))] + handed[of_before][:, None] * p[which]

    def evidence(self, hashes: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """For each text the difference of its log-likelihoods per word, and that of its strong words per root of its length."""
        p = self.probabilities(hashes, n)
        told = np.log(p[:, 1] / p[:, 0])
        owner = np.repeat(np.arange(len(n)), n)
        length = np.maximum(n, 1)
        strong = np.bincount(owner, np.where(told > STRONG, told, 0.0), len(n))
        return np.stack([np.bincount(owner, told, len(n)) / length, strong / np.sqrt(length)], 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + evidence @ self.curve[1:], -30, 30)))

    def fit_curve(self, evidence: np.ndarray, label: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        x = np.concatenate([np.ones((len(label), 1)), evidence], 1)
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - label) + 1e-2 * w
            hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
            step = np.linalg.solve(hess, grad)
            w -= step
            if abs(step).max() < 1e-8:
                break
        self.curve = w


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, toxic, held (every fifth) of the labelled rows that the model is fitted on.

    At most about ``max_rows`` ids are sent to the tasks, so the texts are not shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold() != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.filter(place < int(share * (1 << 30))).toArrow()
    order = np.argsort(chosen["doc_id"].to_numpy())
    ids, toxic = chosen["doc_id"].to_numpy()[order], chosen["toxic"].to_numpy()[order]

    def run(batches):
        for b in batches:
            b = b.filter(b.column("doc_id").is_valid())
            mine = b.column("doc_id").to_numpy()
            at = np.searchsorted(ids, mine)
            at[at == len(ids)] = 0
            hit = ids[at] == mine if len(ids) else np.zeros(len(mine), bool)
            b, at = b.filter(pa.array(hit)), at[hit]
            held = mix64(ids[at].astype(np.uint64)) % np.uint64(5) == 0
            yield pa.RecordBatch.from_arrays([b.column("text"), pa.array(toxic[at].astype(np.int32)), pa.array(held)], names=["text", "toxic", "held"])

    return docs.select(F.col("doc_id").cast("long"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")).mapInArrow(run, "text string, toxic int, held boolean")


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def class_counts(rows: DataFrame) -> tuple[tuple, tuple, tuple]:
    """What ``Model`` takes, from all words of ``rows`` (text, toxic).

    Each run of texts hands on its different pairs with their counts; the rest is grouping.
    """

    def pairs(batches):
        for b in batches:
            toxic = b.column("toxic").to_numpy().astype(np.int64)
            for first, last, offsets, data in text_chunks(b):
                (_, _, h), n = tokens(data, offsets)
                label, v = np.repeat(toxic[first:last], n), before(h, n)
                order = np.lexsort((h, v))
                v, h, label = v[order], h[order], label[order]
                new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                one = np.add.reduceat(label, new) if len(new) else new
                total = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([_long(v[new]), _long(h[new]), pa.array(total - one), pa.array(one)], names=["v", "w", "n0", "n1"])

    def words(batches):
        for b in batches:
            for _, _, offsets, data in text_chunks(b):
                (first, stem, h), _ = tokens(data, offsets)
                h, at = np.unique(h, return_index=True)
                yield pa.RecordBatch.from_arrays([_long(h), _long(stem[at]), pa.array(classes(first[at]).astype(np.int32))], names=["w", "stem", "k"])

    table = saved(rows.mapInArrow(pairs, "v long, w long, n0 long, n1 long").groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    known = rows.select("text").mapInArrow(words, "w long, stem long, k int").distinct()
    rest = [F.greatest(F.col(c) - DISCOUNT, F.lit(0)) for c in ("n0", "n1")]
    by_word = table.groupBy("w").agg(*(F.count_if(F.col(f"n{c}") > 0).alias(f"m{c}") for c in (0, 1))).join(known, "w").toArrow()
    by_context = table.groupBy("v").agg(F.sum(F.col("n0") + F.col("n1")).alias("n"), *(F.sum(x).alias(f"m{c}") for c, x in enumerate(rest)))
    by_context = by_context.filter("m0 > 0 AND m1 > 0").toArrow()  # the others hand everything on
    each = table.filter(rest[0] + rest[1] > 0).toArrow()
    hashed = lambda t, c: t[c].to_numpy().view(np.uint64)
    two = lambda t, c: np.stack([t[f"{c}0"].to_numpy(), t[f"{c}1"].to_numpy()], 1)
    return (
        (hashed(by_word, "w"), hashed(by_word, "stem"), by_word["k"].to_numpy(), two(by_word, "m")),
        (hashed(by_context, "v"), by_context["n"].to_numpy(), two(by_context, "m")),
        (hashed(each, "v"), hashed(each, "w"), two(each, "n")),
    )


def company(docs: DataFrame) -> np.ndarray:
    """For each class of words the number of different classes that it follows, over all texts.

    A pair of classes is one number. Tasks hand on the different pairs of some millions of
    words at a time; equal ones meet in a shuffle by pair, so no class is hot.
    """
    bits = np.uint64(CLASS_BITS)

    def run(batches):
        held: list[np.ndarray] = []
        for b in batches:
            for _, _, offsets, data in text_chunks(b):
                (first, *_), n = tokens(data, offsets)
                k = classes(first)
                held.append(np.unique((before(k, n, np.uint64(0)) << bits) | k))
                if sum(map(len, held)) > TOGETHER:
                    yield different(held)
                    held = []
        if held:
            yield different(held)

    def different(held):
        return pa.RecordBatch.from_arrays([_long(np.unique(np.concatenate(held)))], names=["pair"])

    rows = docs.select(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    pairs = rows.mapInArrow(run, "pair long").distinct()
    got = pairs.groupBy(F.col("pair").bitwiseAND(F.lit((1 << CLASS_BITS) - 1)).alias("k")).count().toArrow()
    out = np.zeros(1 << CLASS_BITS)
    out[got["k"].to_numpy()] = got["count"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    rows = saved(labelled(docs, labels, max_rows))
    model = Model(*class_counts(rows.filter("NOT held").select("text", "toxic")))
    model.with_continuation(company(docs))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for first, last, offsets, data in text_chunks(b):
                e = sent.value.evidence(*tokens(data, offsets))
                yield pa.RecordBatch.from_arrays([b.column("toxic").slice(first, last - first), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["toxic", "a", "b"])

    told = rows.filter("held").select("text", "toxic").mapInArrow(run, "toxic int, a double, b double").toArrow()
    sent.destroy()
    label = told["toxic"].to_numpy().astype(np.float64)
    if len(set(label.tolist())) == 2 and (model.known > 0).all():
        model.fit_curve(np.stack([told["a"].to_numpy(), told["b"].to_numpy()], 1), label)
    else:
        share = float(label.mean()) if len(label) else 0.0
        model.curve = np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for first, last, offsets, data in text_chunks(b):
                s = sent.value.score(sent.value.evidence(*tokens(data, offsets)))
                held = [i is not None and fold_of(i) == 2 for i in ids[first:last]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Fit on the labelled rows and score all rows."""
    return score(docs, fit(docs, labels, max_rows))
