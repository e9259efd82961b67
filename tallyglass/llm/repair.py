"""Conversation structure repair: the cheapest edits after which roles read system? (user assistant)+, or nothing.

Each row becomes one letter, of its role's initial and its fault. Re-Pair rules, learned from the
letters of all conversations, shorten them; each rule has one min-plus transfer matrix between the states
of the role pattern, built from those of its two halves. An entry is a cost and a rope of edits, of equal
costs the one with the least text. A conversation is the product of its rules' matrices.

No step holds a conversation's texts. Order and faults are settled on digests of 16 bytes,
ranges of which are sorted apart, so one conversation may have any share of the rows; what is gathered
of it is one letter a row, as long as its audit. Texts pass by once, sorted, behind their conversation's
audit. (SHA-256 has no way to be merged, so a digest of a whole conversation reads it in one stream.)
"""

from __future__ import annotations

import hashlib
import os.path
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import saved

#: Costs of the edits, and what a truncated row adds unless it is deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rounds of rules, and how often a pair must occur to become one.
ROUNDS, LEAST = 8, 2
#: Audits that a task remembers.
REMEMBERED = 10_000

#: A letter's low two bits are the initial, s u a or another; the next two the fault.
INITIALS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
LETTERS = "abcdefghijklmnop"
#: Letters as the grammar sees them: a row that must go has no role.
_SEEN = str.maketrans(LETTERS, "suax" + "dddd" + "dddd" + "SUAX")
#: States of the pattern: nothing yet, after system, after user, after assistant.
START, S, U, A = range(4)
STEPS = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
ENDS = (START, A)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults put in by crc32("conv_id:turn") modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops and marks, 3 repeats it, 4 makes its role user.
    Null roles and texts are one space, and so are null numbers in the draw.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    copies = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), F.array_repeat(F.lit(1), copies).alias("_n"))
    return out.withColumn("_n", F.explode("_n")).drop("_n")


def _known(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and digest: order and equality of rows rest on it."""
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.withColumn("digest", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))))


def _lines(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, m, one, more: the letters of the first and of the other m - 1 equal rows of a turn.

    The earliest turn of each role and text is found by aggregates, so a text that fills a third of a
    conversation reaches no task row by row.
    """
    solid, stop = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*+\z"
    thin = _known(rows).select("conv_id", "turn", "role", "digest", (~F.col("text").rlike(solid)).alias("blank"), (~F.col("text").rlike(stop)).alias("cut"))
    lines = thin.groupBy("conv_id", "turn", "role", "digest").agg(F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.count("*").alias("m"))
    earliest = lines.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))).alias("e"))
    firsts = earliest.select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), F.col("e.at").alias("_t"), F.lit(True).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("digest") == F.col("_d"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    again = F.when(F.col("blank"), 4).otherwise(8)
    one = F.when(F.col("blank"), 4).when(F.col("first").isNull(), 8).when(F.col("cut"), 12).otherwise(0)
    return lines.join(firsts, same, "left").select("conv_id", "turn", "role", "digest", "m", (role + one).alias("one"), (role + again).alias("more"))


def _pieces(batches):
    """Runs of one conversation in sorted lines: their letters and turns, with the first line's place in the order."""
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column("conv_id"), run_end_type=pa.int32())
        ends = np.asarray(runs.run_ends)
        starts = np.concatenate([[0], ends[:-1]])
        m = b.column("m").to_numpy()
        at = np.concatenate([[0], np.cumsum(m)])
        letters = np.repeat(b.column("more").to_numpy(), m)
        letters[at[:-1]] = b.column("one").to_numpy()
        letters = (letters + ord(LETTERS[0])).astype(np.uint8)
        turns = b.column("turn")
        known = turns.is_valid().to_numpy(zero_copy_only=False)
        numbers = turns.fill_null(0).to_numpy()
        codes, low, high, n = [], [], [], []
        for i, j in zip(starts, ends):
            codes.append(letters[at[i] : at[j]].tobytes().decode())
            some = numbers[i:j][known[i:j]]
            low.append(int(some[0]) if len(some) else None)
            high.append(int(some[-1]) if len(some) else None)
            n.append(int(1 + (some[1:] != some[:-1]).sum()) if len(some) else 0)
        first = b.take(pa.array(starts, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [first.column("conv_id"), first.column("turn").is_valid().cast(pa.int32()), first.column("turn"), first.column("role"), first.column("digest"), pa.array(codes), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(n, pa.int64())],
            names=["conv_id", "known", "turn", "role", "digest", "letters", "low", "high", "turns"],
        )


def sequences(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, pieces: each conversation's letters and turns in order, some at a time.

    Lines are sorted in ranges of conversation, turn, role and digest; a conversation that
    spans ranges is put together from their pieces. ``conversations`` names more of them, which may
    have no rows.
    """
    order = ["conv_id", "turn", "role", "digest"]
    key = rows.schema["conv_id"].dataType.simpleString()
    cut = _lines(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = cut.mapInArrow(_pieces, f"conv_id {key}, known int, turn long, role string, digest binary, letters string, low long, high long, turns long")
    if conversations is not None:
        none = lambda t: F.lit(None).cast(t)
        pieces = pieces.unionByName(conversations.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("known"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), F.lit("").alias("letters"), none("long").alias("low"), none("long").alias("high"), F.lit(0).cast("long").alias("turns")))
    parts = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("known", "turn", "role", "digest", "letters", "low", "high", "turns"))).alias("pieces"))
    return parts.select("conv_id", F.transform("pieces", lambda p: F.struct(p["letters"].alias("letters"), p["low"].alias("low"), p["high"].alias("high"), p["turns"].alias("turns"))).alias("pieces"))


# The grammar


def shortened(letters: str, rules: list[str]) -> str:
    """``letters`` with each rule's pair replaced by its symbol, in the order of the rules."""
    for i, pair in enumerate(rules):
        letters = letters.replace(pair, symbol(i))
    return letters


def symbol(rule: int) -> str:
    return chr(0x100 + rule)


def learned(sequences: DataFrame, rounds: int = ROUNDS, least: int = LEAST) -> list[str]:
    """The pairs of the Re-Pair rules, in order, from all conversations.

    A round counts the pairs of neighbours and makes rules of the most frequent ones that share no symbol,
    as these cannot take occurrences from each other. Ties go to the lesser pair. There are at most
    (9 + rules)^2 different pairs, whatever the number of rows.
    """
    rules: list[str] = []
    for _ in range(rounds):
        known = list(rules)

        def count(batches, known=known):
            pairs: Counter = Counter()
            for b in batches:
                for text, times in Counter(b.column(0).to_pylist()).items():
                    text = shortened(text, known)
                    for pair, n in Counter(map(str.__add__, text, text[1:])).items():
                        pairs[pair] += n * times
            yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["pair", "n"])

        texts = sequences.select(F.translate(F.array_join(F.col("pieces.letters"), ""), LETTERS, "suaxddddddddSUAX").alias("seen"))
        counts = texts.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()
        used: set[str] = set()
        for row in sorted(counts, key=lambda r: (-r["n"], r["pair"])):
            if not used & set(row["pair"]):
                rules.append(row["pair"])
                used |= set(row["pair"])
        if not used:
            break
    return rules


def text_of(rope) -> str:
    """The edits of a rope: a string, or a pair of ropes."""
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += [r[1], r[0]]
    return "".join(out)


def better(x, y):
    """The cheaper of two (cost, rope), or that of the lesser text; None is no way.

    Equal costs over the same rows never have one text a beginning of the other (the rest would be
    inserts, which cost), so what is less stays less whatever follows.
    """
    if x is None or y is None:
        return y if x is None else x
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return x if text_of(x[1]) <= text_of(y[1]) else y


def product(a, b):
    """The min-plus product of two transfer matrices."""
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            for k in range(4):
                if a[i][k] and b[k][j]:
                    out[i][j] = better(out[i][j], (a[i][k][0] + b[k][j][0], (a[i][k][1], b[k][j][1])))
    return out


def _inserts():
    """What rows put in can do between two states."""
    out = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    one = [[None] * 4 for _ in range(4)]
    for role in "ua":
        for i, j in STEPS[role].items():
            one[i][j] = (INSERT, "I")
    for _ in range(2):
        more = product(out, one)
        out = [[better(out[i][j], more[i][j]) for j in range(4)] for i in range(4)]
    return out


def _letter(seen: str):
    """The matrix of one row, with inserts before it."""
    extra = TRUNCATED if seen.isupper() else 0
    edit = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if seen != "d":
        for role, steps in STEPS.items():
            for i, j in steps.items():
                if role == seen.lower():
                    edit[i][j] = better(edit[i][j], (KEEP + extra, "K"))
                elif role != "s":
                    edit[i][j] = better(edit[i][j], (REROLE + extra, "R"))
    return product(_inserts(), edit)


def matrices(rules: list[str]) -> dict[str, list]:
    """Each letter's and each rule's matrix, from below: a rule's is the product of its halves'."""
    out = {seen: _letter(seen) for seen in "suaxdSUAX"}
    for i, pair in enumerate(rules):
        out[symbol(i)] = product(out[pair[0]], out[pair[1]])
    return out


class Solver:
    """Costs and audits of conversations by a grammar's matrices."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        flat = lambda e: e and (e[0], text_of(e[1]))
        self.moves = {s: [[flat(e) for e in row] for row in m] for s, m in matrices(rules).items()}
        self.last = [[flat(e) for e in row] for row in _inserts()]
        self.solve = lru_cache(REMEMBERED)(self._solve)

    def _solve(self, seen: str) -> tuple[int, str]:
        done, now = [], [(0, ""), None, None, None]
        for s in shortened(seen, self.rules):
            now = self._step(now, self.moves[s])
            if max(len(e[1]) for e in now if e) > 1024:  # what all ways share is settled
                shared = len(os.path.commonprefix([e[1] for e in now if e]))
                done.append(next(e for e in now if e)[1][:shared])
                now = [e and (e[0], e[1][shared:]) for e in now]
        now = self._step(now, self.last)
        cost, audit = min(now[i] for i in ENDS if now[i])
        return cost, "".join(done) + audit

    @staticmethod
    def _step(now, move):
        ways = ([(e[0] + m[j][0], e[1] + m[j][1]) for e, m in zip(now, move) if e and m[j]] for j in range(4))
        return [min(w) if w else None for w in ways]


_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation.

    ``rows``: conv_id, turn, role, text; other columns are left alone. Rows go by turn, null turns
    first; rows of one turn by role and the MD5 of role and text. A null role or text is empty, a null
    conv_id is a conversation. Of equal rows one counts and the others are duplicates. An empty table gives no
    conversations but those of ``conversations``, whose audits are empty. Written once.
    """
    spark = rows.sparkSession
    each = saved(sequences(rows, conversations))
    rules = learned(each)
    sent = spark.sparkContext.broadcast(rules)

    def solve(batches):
        solver = Solver(sent.value)
        for b in batches:
            out = []
            for pieces in b.column("pieces").to_pylist():
                letters = "".join(p["letters"] for p in pieces)
                codes = np.frombuffer(letters.encode(), np.uint8).astype(np.int64) - ord(LETTERS[0])
                faults = np.bincount(codes >> 2, minlength=4)
                role = codes & 3
                legal = np.isin(role[:-1] * 4 + role[1:], [1, 6, 9])  # su, ua, au
                spans = [p for p in pieces if p["low"] is not None]
                turns = sum(p["turns"] for p in spans) - sum(p["high"] == q["low"] for p, q in zip(spans, spans[1:]))
                gaps = spans[-1]["high"] - spans[0]["low"] + 1 - turns if spans else 0
                out.append((gaps, *map(int, faults[1:]), int((~legal).sum()), *solver.solve(letters.translate(_SEEN))))
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string())], names=["conv_id", *(f.split()[0] for f in _PLAN.split(", "))])

    key = rows.schema["conv_id"].dataType.simpleString()
    return saved(each.mapInArrow(solve, f"conv_id {key}, {_PLAN}"))


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit: the rows that ``plans`` leaves, in order; those put in have an empty text.

    Conversations lie whole in partitions, in the order of place.
    """
    lines = _known(rows).select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    none = lambda t: F.lit(None).cast(t)
    heads = planned.select("conv_id", F.lit(0).alias("_kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), "audit")
    key = rows.schema["conv_id"].dataType.simpleString()
    together = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "turn", "role", "digest")
    return together.select("conv_id", "_kind", "role", "text", "audit").mapInArrow(_apply, f"conv_id {key}, place long, role string, text string, edit string")


def _apply(batches):
    """Sorted rows behind their conversations' audits, edited."""
    conv, audit, at, place, before = None, "", 0, 0, ""
    for b in batches:
        out = []

        def put(role, text, edit):
            nonlocal place, before
            if edit != "K":
                role = "assistant" if before == "u" else "user"
            out.append((conv, place, role, text, edit))
            place, before = place + 1, role[:1]

        def insert():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("", "", "I")
                at += 1

        for c, kind, role, text, told in zip(*(b.column(k).to_pylist() for k in ("conv_id", "_kind", "role", "text", "audit"))):
            if not kind:
                conv, audit, at, place, before = c, told, 0, 0, ""
                insert()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                put(role, text, edit)
            insert()
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field("conv_id").type), pa.array(columns[1], pa.int64()), *(pa.array(x, pa.string()) for x in columns[2:])], names=["conv_id", "place", "role", "text", "edit"])


def digests(repaired_rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of "role:text" by place, joined by line ends. Works on ``repaired``'s partitions as they are."""

    def run(batches):
        conv, state = None, None
        for b in batches:
            out = []
            for c, place, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "place", "role", "text"))):
                if not place:
                    if state:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                state.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
            last = b.schema.field("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], last), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([conv], last), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    key = repaired_rows.schema["conv_id"].dataType.simpleString()
    return repaired_rows.mapInArrow(run, f"conv_id {key}, repaired_sha256 string")
