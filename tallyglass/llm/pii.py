"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

Base spans (e-mail, IP, card, phone) are found by fixed patterns in whole texts; each
span's value is a protected entity. A term is a risk where it tells too much about an
entity: with n(...) the number of lines of the corpus that have it and N that of all lines,

    PMI(entity; term) = log2( n(entity, term) * N / (n(entity) * n(term)) )
    IC(entity)        = log2( N / n(entity) )

the term discloses the share PMI / IC of the entity's information. A whole line is the unit
of all counts. Terms whose share reaches ``generalise_at`` are generalised, those that reach
``remove_at`` are removed, wherever they stand in a document that has the entity. A pair
counts only if meeting so often by chance is no likelier than ``chance`` (a bound of the
Poisson tail with n(entity) n(term) / N lines expected), so an entity of one line has terms too.

A pair meets in n(entity) lines at most, so only a term with n(term) <= N (n(entity) / N) **
generalise_at can reach the threshold; a bit table whose size follows their number tells the
tasks which words to count, and exact joins drop the rest.

Lines of the same entities and terms are one line with a number, so copies cost no more than
one of them. Entities of the very same lines have the same counts with every term, so they are
one class; pairs are of class and term, met by joins on the line after the bound above. A line
of many addresses that stand nowhere else is thus one class, not addresses x terms.

A generalised term becomes the class of its shape (``shape``): a name, capitals or a word.

Defined cases: a null text is empty and has no spans. Repeated rows each get their own
spans; ids are passed through. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import Bits, bits_for, fresh, gathered_bits, saved, slices, word_hash, word_hashes

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("term", "term_removed")
# Fixed patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{2,}")
DIGIT = re.compile(r"[0-9]")

CHANCE, GENERALISE_AT, REMOVE_AT = 0.001, 0.75, 0.95
#: A class of entities with more disclosing terms than these meets a document's own terms, not the whole list.
LISTED = 256


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL, left to right; each search starts at the run of characters before an @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def dotted(text: str) -> list[tuple[int, int]]:
    """Matches of IP, left to right, found group by group within runs of digits and dots, so that long runs take linear time."""
    out = []
    for run in DOTTED.finditer(text):
        groups, at = run[0].split("."), run.start()
        places = []
        for g in groups:
            places.append((at, at + len(g)))
            at += len(g) + 1
        k = 0
        while k + 4 <= len(groups):
            if all(groups[k : k + 4]):
                out.append((places[k][0], places[k + 3][1]))
                k += 4
            else:
                k += 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, z) for a, z in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", a, z) for a, z in dotted(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in text[a:z].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = re.sub("[ -]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def entity(kind: str, value: str) -> int:
    """A number for an entity, of its kind and its value without separators."""
    plain = value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def passages(text: str, spans) -> list[tuple[int, int, list]]:
    """(start, end, spans in it) of the lines that hold spans."""
    out: dict[tuple[int, int], list] = {}
    a, z = 0, -1
    for s in spans:
        if not a <= s[1] < s[2] <= z:  # else in the line of the span before
            a, z = text.rfind("\n", 0, s[1]) + 1, text.find("\n", s[2])
            z = z if z >= 0 else len(text)
        out.setdefault((a, z), []).append(s)
    return [(a, z, v) for (a, z), v in out.items()]


BASE = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, n_lines long, marked string, passages array<struct<entities:array<long>,terms:array<long>>>"


def _row():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


_CODES: dict[str, int] = {}


def code(word: str) -> int:
    h = _CODES.get(word)
    if h is None:
        if len(_CODES) > 100_000:
            _CODES.clear()
        h = _CODES[word] = signed(word_hash(word))
    return h


def terms(text: str, a: int, z: int, spans) -> list[tuple[int, int, int]]:
    """(term, start, end) of each word of ``text`` from a to z that touches none of the ``spans``."""
    out, k = [], 0
    taken = sorted((s[1], s[2]) for s in spans)
    reach = 0  # the end of the spans that begin before the word does
    for m in WORD.finditer(text, a, z):
        p, q = m.span()
        while k < len(taken) and taken[k][0] < q:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= p:
            out.append((code(m[0].lower()), p, q))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: base spans and counts, lines, and what stands in the lines of entities.

    ``row`` tells documents apart by id and text; ``marked`` is the text of a document with
    spans. ``passages`` has the different entities and terms of each line with an entity.
    """
    line = pa.list_(pa.struct([("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64()))]))
    kinds = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.string(), line]
    names = [x.split()[0] for x in BASE.split(", ")]

    def run(batches):
        for b in slices(batches):
            rows = []
            for doc, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                spans = base_spans(text)
                near = []
                for a, z, inside in passages(text, spans) if spans else ():
                    told = {t for t, _, _ in terms(text, a, z, inside)}
                    near.append({"entities": sorted({entity(k, text[x:y]) for k, x, y in inside}), "terms": sorted(told)})
                n = Counter(k for k, _, _ in spans)
                rows.append((doc, row, *(n[k] for k in KINDS), joined(spans), text.count("\n") + 1, text if spans else None, near))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 10, kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, BASE)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """n(term): the lines of all ``docs`` that have each term of ``terms`` (term)."""
    bits = docs.sparkSession.sparkContext.broadcast(gathered_bits(terms, "term", bits_for(terms.count())).table)

    def run(batches):
        table = Bits.of(bits.value)
        count: Counter = Counter()
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                for line in (text or "").lower().split("\n"):
                    count.update(set(WORD.findall(line)))
            if len(count) > 150_000:
                yield from out(count, table)
                count = Counter()
        yield from out(count, table)

    def out(count, table):
        words = list(count)
        h = word_hashes(np.frombuffer("\n".join(words).encode(), np.uint8))[0]
        keep = table.has(h)
        n = np.array(list(count.values()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], names=["term", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term")).join(terms.select("term").distinct(), "term", "left_semi")


def lines_of(scanned: DataFrame) -> DataFrame:
    """line, m, entities, terms: the different lines with entities, and how many lines each stands for."""
    each = scanned.filter("base_spans <> ''").select(F.explode("passages").alias("p"))
    return each.groupBy(F.xxhash64("p.entities", "p.terms").alias("line")).agg(F.count("*").alias("m"), F.first("p.entities").alias("entities"), F.first("p.terms").alias("terms"))


def classes_of(lines: DataFrame) -> DataFrame:
    """entity, n_entity, kin: entities with the same ``kin`` stand in the very same ``lines``."""
    each = lines.select("line", "m", F.explode("entities").alias("entity"))
    found = each.groupBy("entity").agg(F.sum("m").alias("n_entity"), *(F.bit_xor(F.xxhash64("line", F.lit(k))).alias(f"x{k}") for k in (1, 2)))
    return found.select("entity", "n_entity", F.xxhash64("n_entity", "x1", "x2").alias("kin"))


def told_by_class(docs: DataFrame, lines: DataFrame, kin: DataFrame, total: float, chance: float, generalise_at: float) -> DataFrame:
    """kin, term, share for each pair of a term that tells too much about the entities of a class."""
    most = kin.agg(F.max("n_entity")).first()[0] or 1
    near = saved(lines.select(F.explode("terms").alias("term")).distinct())
    counts = saved(term_counts(docs, near).filter(F.col("n_term") <= total * (most / total) ** generalise_at * (1 + 1e-9)))
    here = lines.select("line", "m", F.explode("entities").alias("entity")).join(kin, "entity").select("line", "m", "kin", "n_entity").distinct()
    there = lines.select("line", F.explode("terms").alias("term")).join(counts, "term")
    reach = F.col("n_term") <= F.lit(total) * F.pow(F.col("n_entity") / F.lit(total), F.lit(generalise_at)) * (1 + 1e-9)
    met = here.join(there, "line").filter(reach)
    pairs = met.groupBy("kin", "term").agg(F.sum("m").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    told = pairs.withColumn("n_term", F.greatest("n_term", "n_both"))
    expected = F.col("n_entity") * F.col("n_term") / F.lit(total)
    share = F.log2(F.col("n_both") / expected) / F.log2(F.lit(total) / F.col("n_entity"))
    # log of a bound of the chance of n_both lines or more: the Poisson term (Stirling below n!) and a geometric series
    k = F.col("n_both")
    tail = k * (1 + F.log(expected / k)) - expected - 0.5 * F.log(2 * math.pi * k) - F.log(1 - expected / (k + 1))
    sure = (F.col("n_both") > expected) & (tail <= math.log(chance))
    return told.filter((F.col("n_entity") < total) & sure).select("kin", "term", share.alias("share")).filter(F.col("share") >= generalise_at)


def _counted(scanned: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """``lines_of``, their ``classes_of`` and the number of all lines."""
    lines = saved(lines_of(scanned))
    return lines, saved(classes_of(lines)), float(scanned.agg(F.sum("n_lines")).first()[0] or 1)


def disclosing(docs: DataFrame, scanned: DataFrame, chance: float = CHANCE, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """entity, term, share for each pair of a term that tells too much about an entity."""
    lines, kin, total = _counted(scanned)
    return told_by_class(docs, lines, kin, total, chance, generalise_at).join(kin, "kin").select("entity", "term", "share")


def _parsed(listed: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in listed.split(",") if s)]


def _told(marked: DataFrame, owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, term, share of the disclosing ``pairs`` of the classes that a document has: ``owners`` (row, kin).

    A class of few pairs brings its whole list, whether the document has the terms or not. A
    class of more than ``LISTED`` meets the document's own terms first.
    """
    sizes = pairs.groupBy("kin").agg(F.count("*").alias("n"))
    sized = saved(owners.join(sizes, "kin"))
    out = sized.filter(F.col("n") <= LISTED).select("row", "kin").join(pairs, "kin").select("row", "term", "share")
    wide = sized.filter(F.col("n") > LISTED).select("row", "kin")
    if wide.limit(1).count():
        listed = pairs.join(sizes.filter(F.col("n") > LISTED).select("kin"), "kin", "left_semi")
        own = _own_terms(marked.join(wide.select("row").distinct(), "row", "left_semi"), listed)
        out = out.unionByName(wide.join(own, "row").join(listed, ["kin", "term"]).select("row", "term", "share"))
    return out.groupBy("row", "term").agg(F.max("share").alias("share"))


def _own_terms(marked: DataFrame, listed: DataFrame) -> DataFrame:
    """row, term: the different terms of each document that are among those of ``listed``, and a few more."""
    known = saved(listed.select("term").distinct())
    bits = marked.sparkSession.sparkContext.broadcast(gathered_bits(known, "term", bits_for(known.count())).table)

    def run(batches):
        table = Bits.of(bits.value)
        for b in slices(batches):
            for row, listed, text in zip(b.column("row").to_pylist(), b.column("base_spans").to_pylist(), b.column("marked").to_pylist()):
                t = np.array(sorted({t for t, _, _ in terms(text, 0, len(text), _parsed(listed))}), np.int64)
                t = t[table.has(t.view(np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), row, np.int64)), pa.array(t)], names=["row", "term"])

    return marked.select("row", "base_spans", "marked").mapInArrow(run, "row long, term long").distinct()


def spans(docs: DataFrame, chance: float = CHANCE, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, scanned: DataFrame | None = None) -> DataFrame:
    """doc_id, row, n_email ... n_phone, base_spans, spans of every document.

    ``spans`` has the base spans, then every place of a disclosing term in the document, of
    kind ``term`` (to generalise) and ``term_removed``.
    """
    scanned = saved(scan(docs)) if scanned is None else scanned
    lines, kin, total = _counted(scanned)
    pairs = saved(told_by_class(docs, lines, kin, total, chance, generalise_at))
    marked = scanned.filter("base_spans <> ''").drop("passages", "n_lines")
    inside = scanned.filter("base_spans <> ''").select("row", F.explode("passages").alias("p")).select("row", F.explode("p.entities").alias("entity"))
    owners = inside.join(kin, "entity").select("row", "kin").distinct()
    told = _told(marked, owners, pairs).withColumn("removed", F.col("share") >= remove_at)
    each = told.groupBy("row").agg(F.collect_list(F.struct("term", "removed")).alias("told"))
    names = ["doc_id", "row", *(f"n_{k}" for k in KINDS), "base_spans"]

    def run(batches):
        for b in slices(batches):
            found = []
            for listed, text, pairs in zip(b.column("base_spans").to_pylist(), b.column("marked").to_pylist(), b.column("told").to_pylist()):
                kind = {x["term"]: TERM_KINDS[x["removed"]] for x in pairs or ()}
                places = [(kind[t], p, q) for t, p, q in (terms(text, 0, len(text), _parsed(listed)) if kind else ()) if t in kind]
                found.append(joined(_parsed(listed) + sorted(places, key=lambda s: (TERM_KINDS.index(s[0]), s[1]))))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, pa.string())], names=[*names, "spans"])

    schema = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    with_terms = marked.join(each, "row", "left").select(*names, "marked", "told").mapInArrow(run, schema)
    return scanned.filter("base_spans = ''").select(*names, F.lit("").alias("spans")).unionByName(with_terms)


def find(docs: DataFrame) -> DataFrame:
    """``spans`` of all ``docs``, with production thresholds."""
    return spans(docs.select("doc_id", "text"))


#: What stands for a span of a base kind, and for a removed term.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term_removed": ""}


def shape(term: str) -> str:
    """The class that a generalised term becomes: capitals only, a capital first, or any other word (scripts without case too)."""
    return "[CAPITALS]" if term.isupper() else "[NAME]" if term[:1].isupper() else "[WORD]"


def rewrite(text: str, listed: str) -> str:
    """``text`` with the spans of a ``spans`` string replaced; overlapping spans are merged under the first.

    Base spans become their kind, generalised terms the class of their ``shape``; removed terms go.
    """
    parsed = sorted((int(a), -int(z), k) for k, a, z in (s.split(":") for s in listed.split(",") if s))
    out, at = [], 0
    for a, z, k in parsed:
        if a >= at:
            out += [text[at:a], shape(text[a:-z]) if k == "term" else MASKS[k]]
            at = -z
        else:
            at = max(at, -z)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts rewritten; columns and rows stay as they are.

    The texts without any span pass through untouched.
    """
    row, mine, found = fresh(docs, "_row", "_mine", "_spans")
    scanned = saved(scan(docs))
    listed = spans(docs, scanned=scanned).filter("spans <> ''").select(F.col("row").alias(mine), F.col("spans").alias(found)).dropDuplicates([mine])
    numbered = docs.withColumn(row, _row())
    joined_rows = numbered.join(listed, F.col(row) == F.col(mine), "left")
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in slices(batches):
            texts = [t if s is None or t is None else rewrite(t, s) for t, s in zip(b.column("text").to_pylist(), b.column(found).to_pylist())]
            i = b.schema.get_field_index("text")
            yield b.set_column(i, "text", pa.array(texts, pa.string())).select(names)

    return joined_rows.select(*names, found).mapInArrow(run, schema)
