"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all earlier
turns are context, and only that reply is trainable. A conversation that ends with
another role, or has no assistant turn, adds one example without a target, so no turn
is lost.

The template of a turn is ``<|role|>\\n text <|end|>\\n``. Control strings in roles and
texts are escaped by a backslash after their first character, and backslashes are
doubled; ``unescape`` undoes both.

``segments`` formats each turn once, with running offsets. ``expand`` makes the examples
from them, each with its whole text, while a conversation streams through in order: a task
holds the running prefix of one conversation. The examples' size grows with the square of
a conversation's turns, as prefix-target expansion has it. ``digests`` writes them and
works on what it reads back.

Defined cases: a null text or role is empty. Rows are ordered by turn (nulls first),
then role and text, so ties have one order; repeated rows are turns of their own. Rows
without a conv_id form one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import shared_folder, slices

# Control strings that texts must not contain as they are.
CONTROL = re.compile(r"\\|<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"\\(\\)?")
TARGET = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def opening(role: str) -> str:
    """A turn's head; what would end it within the role is broken by a backslash as well."""
    name = escape(role).replace("|>", "|\\>")
    return f"<|{name}|>\n"


CLOSING = "<|end|>\n"
TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    return [(unescape(a), unescape(b)) for a, b in TURN.findall(formatted)]


SEGMENTS = "conv_id long, turn_no long, role string, formatted string, start long, loss_start long, loss_end long, example long, last boolean"


def segments(conversations: DataFrame) -> DataFrame:
    """The formatted turns: one row for each, in the coordinates of its conversation.

    turn_no counts from 0; ``start`` is the code point at which ``formatted`` begins.
    ``loss_start`` and ``loss_end`` (absolute, end exclusive) mark the trainable reply of
    the example that ends with this turn; ``example`` is that example's number, null if
    no example ends here. ``last`` marks the conversation's last turn.
    """

    def run(batches):
        conv, started, no, at, example, held = None, False, 0, 0, 0, None
        out: list[tuple] = []
        for b in batches:
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if not started or c != conv:
                    if held:
                        out.append(closed(held, True, example))
                        held = None
                    conv, started, no, at, example = c, True, 0, 0, 0
                if held:
                    out.append(closed(held, False, example))
                    example += held[2] == TARGET
                head, body = opening(role), escape(text)
                formatted = head + body + CLOSING
                span = (at + len(head), at + len(head) + len(body)) if role == TARGET else (None, None)
                held = (c, no, role, formatted, at, *span)
                no, at = no + 1, at + len(formatted)
                if len(out) >= 2048:
                    yield batch_of(out)
                    out = []
        if held:
            out.append(closed(held, True, example))
        if out:
            yield batch_of(out)

    def closed(held, last, example):
        return (*held, example if held[2] == TARGET or last else None, last)

    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def examples(segment_rows: DataFrame) -> DataFrame:
    """One row for each example: conv_id, example, end (its code points), loss_start, loss_end (null without a target)."""
    end = F.col("start") + F.length("formatted")
    return segment_rows.filter("example IS NOT NULL").select("conv_id", "example", end.alias("end"), "loss_start", "loss_end")


def render(segment_rows: DataFrame) -> DataFrame:
    """``examples`` with the formatted text of each: the segments up to its end.

    Its size grows with the square of a conversation's turns, as prefix-target
    expansion has it; everything else here works on segments.
    """
    whole = segment_rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "formatted"))), lambda x: x["formatted"]), "").alias("_all"))
    e = examples(segment_rows)
    joined = e.alias("e").join(whole.alias("w"), F.expr("e.conv_id <=> w.conv_id")).select("e.*", "_all")
    return joined.withColumn("text", F.expr("substring(_all, 1, CAST(end AS INT))")).drop("_all")


EXAMPLES = "conv_id long, example long, last boolean, text string, loss_start long, loss_end long"
#: Code points of examples that a task holds before it hands them on, and bytes of a row group of written ones.
HELD_CHARS, GROUP_BYTES = 4_000_000, 8 << 20


def expand(segment_rows: DataFrame) -> DataFrame:
    """One row for each example with its whole text and the span of its reply (null without a target)."""
    names = [x.split()[0] for x in EXAMPLES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        now, started, prefix, out, held = None, False, "", [], 0
        for b in batches:
            for conv, formatted, a, z, example, last in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "example", "last"))):
                if not started or conv != now:
                    now, started, prefix = conv, True, ""
                prefix += formatted
                if example is not None:
                    out.append((conv, example, last, prefix, a, z))
                    held += len(prefix)
                if held >= HELD_CHARS or len(out) >= 2048:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    ordered = segment_rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end", "example", "last").mapInArrow(run, EXAMPLES)


def written(example_rows: DataFrame) -> DataFrame:
    """``example_rows`` written to the shared folder, in row groups small enough to read long texts, and read back."""
    path = shared_folder(example_rows.sparkSession)
    example_rows.write.option("parquet.block.size", str(GROUP_BYTES)).parquet(path)
    return example_rows.sparkSession.read.schema(example_rows.schema).parquet(path)


READ = "conv_id long, example long, n_turns long, chars long, reply string, turns_sha256 string, upto array<binary>"


def read_examples(example_rows: DataFrame) -> DataFrame:
    """What each example's text tells: its turns, code points, unescaped reply and the digest of its turns.

    ``upto``, of a conversation's last example only: the digest after each turn.
    """
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.binary())]

    def run(batches):
        for b in slices(batches, 64):
            out = []
            for conv, example, last, text, a, z in zip(*(c.to_pylist() for c in b.columns)):
                turns, upto, n = hashlib.sha256(), [], 0
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                    if last:
                        upto.append(turns.digest())
                out.append((conv, example, n, len(text), None if a is None else unescape(text[a:z]), turns.hexdigest(), upto if last else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return example_rows.select("conv_id", "example", "last", "text", "loss_start", "loss_end").mapInArrow(run, READ)


def digests(segment_rows: DataFrame) -> DataFrame:
    """What a reader gets back from the written examples, by conversation.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (the unescaped text under the loss masks, in order),
    formatted_chars (code points of all examples). All is read from the examples' texts:
    the turns from the last one, each reply by its mask. An example whose turns are not
    those that the last one begins with is an error.
    """
    return fold(read_examples(written(expand(segment_rows))))


def fold(read_rows: DataFrame) -> DataFrame:
    """``digests`` of the rows of ``read_examples``."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        now, started, done = None, False, []
        for b in batches:
            for conv, _, turns, size, reply, sha, upto in zip(*(c.to_pylist() for c in b.columns)):
                if not started or conv != now:
                    now, started, chars, total, loss, seen = conv, True, 0, 0, hashlib.sha256(), []
                if reply is not None:
                    loss.update(reply.encode())
                    chars += len(reply)
                total += size
                seen.append((turns, sha))
                if upto is not None:
                    if any(n < 1 or n > len(upto) or upto[n - 1].hex() != s for n, s in seen):
                        raise ValueError(f"conversation {conv}: an example is no prefix of the last one")
                    done.append((conv, turns, sha, chars, loss.hexdigest(), total))
                if len(done) >= 2048:
                    yield batch_of(done)
                    done = []
        if done:
            yield batch_of(done)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in out.split(", ")])

    return read_rows.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(run, out)
