"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; an unknown one by the
longest character n-grams (4 characters down to 1, word edges included) of which any is
known. A text's score is the sum over all its words. Words are runs of letters, in lower
case; every word and every n-gram of the rows that the model is fitted on counts, however
rare or long.

The word and n-gram frequencies are fitted on at most ``rows_per_language`` labelled
rows of each language, chosen by a hash of the id, so the model has a size that does
not grow with the corpus. Every word of every text is scored. Words and n-grams go by
64-bit hashes in sorted arrays, so a task looks up the distinct words of a run of texts at
once; a worker holds the model's arrays and nothing that outlives them.

Defined cases: a text that is null or has no letter is ``und`` with score 0. Ties go to
the language first in the alphabet. Without any labelled row every text is ``und``.
Repeated rows and ids are predicted each for itself; a null id is not held out. Labels
outside the training folds are not looked at. An empty table gives an empty result. A very
long text is scored whole, alone. Columns other than doc_id, text and lang are not looked
at; where a filter keeps them, they pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import code_points, fold, fold_of, hash_spans, kept, mix64, text_chunks

#: Labelled rows of each language that the model is fitted on, at most (about).
ROWS_PER_LANGUAGE = 1500
GRAMS = (4, 3, 2, 1)
#: Added to every count.
SMOOTH = 0.1
UNDETERMINED = "und"
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_EDGE = 1
_FOLDED: list[np.ndarray] = []


def folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else the edge mark."""
    if not _FOLDED:
        table = np.full(0x110000, _EDGE, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLDED.append(table)
    return _FOLDED[0]


class Words:
    """The words of texts that lie one after the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        data, offsets = np.insert(data, offsets[1:], 0x0A) if n else data, offsets + np.arange(n + 1)
        code, lead = code_points(data)
        code = np.append(np.uint32(_EDGE), folded()[code])  # an edge before the first word; a break follows each text
        letter = code != _EDGE
        edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=0, append=0))
        self.code, self.start, self.end = code.astype(np.uint64), edge[0::2], edge[1::2]
        self.owner = np.searchsorted(np.searchsorted(lead, offsets) + 1, self.start, "right") - 1
        self.hash = hash_spans(self.code, self.start, self.end)

    def grams(self, some: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of ``some`` words, edges included, and the place in ``some`` of each one's word."""
        start, end = self.start[some], self.end[some]
        if n > 1:
            start, end = start - 1, end + 1
        count = np.maximum(end - start - n + 1, 0)
        word = np.repeat(np.arange(len(some)), count)
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = mix64(h * _NEXT + self.code[at + k])
        return h, word


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in a sorted table; its length for those that it lacks."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, len(table))


class Model:
    """Log frequencies by language: one for words (kind 0), one for n-grams of each length (kind n)."""

    def __init__(self, languages: list[str], kind: np.ndarray, key: np.ndarray, counts: np.ndarray):
        """``counts``: occurrences in each language (columns) of each key of each kind."""
        self.languages = languages
        self.keys: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        for k in (0, *GRAMS):
            use = np.flatnonzero(kind == k)
            use = use[np.argsort(key[use])]
            m = counts[use].astype(np.float64)
            self.keys[k] = key[use]
            self.logs[k] = np.log((m + SMOOTH) / (m.sum(0) + SMOOTH * (len(m) + 1))).astype(np.float32)

    def distinct(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each different word, and which of them each word is."""
        h, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        rows = np.zeros((len(h), len(self.languages)))
        at = find(self.keys[0], h)
        known = at < len(self.keys[0])
        rows[known] = self.logs[0][at[known]]
        rest = np.flatnonzero(~known)
        for n in GRAMS:
            if not len(rest):
                break
            g, word = words.grams(first[rest], n)
            at = find(self.keys[n], g)
            hit = at < len(self.keys[n])
            at, word = at[hit], word[hit]
            met = np.bincount(word, minlength=len(rest))
            told = met > 0
            for c in range(len(self.languages)):
                rows[rest[told], c] = np.bincount(word, self.logs[n][at, c], len(rest))[told] / met[told]
            rest = rest[~told]
        return rows, which

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of its language (-1 for none) and the score.

        The score is the language's share of the likelihood, tempered by the root of the
        number of words so that it also tells long texts apart.
        """
        texts = len(offsets) - 1
        words = Words(data, offsets)
        n = np.bincount(words.owner, minlength=texts)
        if not self.languages:
            return np.full(texts, -1), np.zeros(texts)
        rows, which = self.distinct(words)
        total = np.stack([np.bincount(words.owner, rows[which, c], texts) for c in range(len(self.languages))], 1)
        best = total.argmax(1)
        top = total[np.arange(texts), best]
        score = 1 / np.exp((total - top[:, None]) / np.sqrt(np.maximum(n, 1))[:, None]).sum(1)
        return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) outside fold 2 that have a language."""
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang IS NOT NULL AND text IS NOT NULL").filter(fold() != 2)
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    none = np.zeros(0, np.int64)
    if not languages:
        return Model([], none, none.astype(np.uint64), np.zeros((0, 0)))
    keep = F.lit(False)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (place < int(min(1.0, rows_per_language / n) * (1 << 30))))
    number = {x: k for k, x in enumerate(languages)}

    def count(batches):
        for b in batches:
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.uint64)
            for first, last, offsets, data in text_chunks(b):
                words = Words(data, offsets)
                own = lang[first:last][words.owner]
                for kind in (0, *GRAMS):
                    key, word = (words.hash, np.arange(len(own))) if not kind else words.grams(np.arange(len(own)), kind)
                    order = np.lexsort((own[word], key))
                    key, of = key[order], own[word][order]
                    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))) if len(key) else none
                    n = np.diff(np.append(new, len(key)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), kind, np.int32)), pa.array(key[new].view(np.int64)), pa.array(of[new].astype(np.int32)), pa.array(n)], names=["kind", "key", "lang", "n"])

    rows = labelled.filter(keep).select("text", "lang").mapInArrow(count, "kind int, key long, lang int, n long")
    columns = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(languages))]
    got = rows.groupBy("kind", "key").agg(*columns).toArrow()
    counts = np.stack([got[f"n{k}"].to_numpy() for k in range(len(languages))], 1)
    return Model(languages, got["kind"].to_numpy(), got["key"].to_numpy().view(np.uint64), counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*sent.value.languages, UNDETERMINED], object)
        for b in batches:
            held = [i is not None and fold_of(i) == 2 for i in b.column("doc_id").to_pylist()]
            for first, last, offsets, data in text_chunks(b):
                best, score = sent.value.predict(data, offsets)
                columns = [b.column("doc_id").slice(first, last - first), pa.array(held[first:last], pa.bool_()), pa.array(names[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict all rows."""
    return predict(docs, fit(docs, rows_per_language))


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least ``min_score``; all columns stay.

    Filters text by text, so nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for first, last, offsets, data in text_chunks(b):
                best, score = sent.value.predict(data, offsets)
                keep[first:last] = (best >= 0) & (score >= min_score)
            yield from kept(b, keep)

    return docs.mapInArrow(run, docs.schema)
