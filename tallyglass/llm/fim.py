"""Fill-in-middle examples: each text is cut at two drawn places by one match of a pattern of its own.

The pattern counts code points, ``(unit{a}+)(unit{b-a}+)(unit*+)``; every quantifier is possessive, so
the match never goes back and takes time linear in the text. All work is column expressions on
the scan: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point, line ends among them by the flag that patterns begin with.
DOTALL, UNIT = "(?s)", "."
#: Numbers of code points that are counted at a time.
BLOCKS = (4096, 64, 1)
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Shares in percent: rows that stay plain, and suffix-first ones among the others.
PLAIN, SUFFIX_FIRST = 10, 20


def counted(df: DataFrame, text: str, n: str) -> DataFrame:
    """``df`` with ``n``, the number of code points of ``text``, by ``regexp_count``.

    Large blocks are counted first, then smaller ones in what they leave, so that a text makes
    a short list of matches and not one of its characters. Needs no column named "_rest".
    """
    out = df.withColumn("_rest", F.col(text)).withColumn(n, F.lit(0).cast("long"))
    for size in BLOCKS:
        block = f"{DOTALL}{UNIT}{{{size}}}+"
        out = out.withColumn(n, F.col(n) + F.regexp_count("_rest", F.lit(block)).cast("long") * size)
        out = out.withColumn("_rest", F.regexp_replace("_rest", block, ""))
    return out.drop("_rest")


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """The first ``n`` groups of eight digits of sha256("seed:key"), as numbers; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output, in that order after its own columns.

    form: "plain" (the text as it is; empty texts, texts that hold a mark, and ``plain`` percent
    of the others), "spm" (``suffix_first`` percent of the rest) or "psm". Null texts are empty. The draw
    depends on the key alone, so equal keys (null ones too) draw equal numbers and repeated rows give
    repeated results. A text of any length is cut whole. Columns of ``docs`` with the names of results
    are replaced; an empty table gives an empty one.
    """
    if any(not m or "$" in m or "\\" in m for m in marks) or len(set(marks)) != 3:
        raise ValueError("marks must be three different strings without $ and \\")
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), docs[key].alias("key"))
    h = draws(F.col("key"), seed)
    source = counted(source.select("row", "text", *(x.alias(f"h{i + 1}") for i, x in enumerate(h))), "text", "n")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    cut = source.select("row", "text", "n", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), form.alias("form"))
    pattern = F.concat(F.lit(rf"{DOTALL}\A({UNIT}{{"), F.col("a").cast("string"), F.lit(f"}}+)({UNIT}{{"), (F.col("b") - F.col("a")).cast("string"), F.lit(rf"}}+)({UNIT}*+)\z"))
    p, s, m = marks
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    told = {
        "n": F.col("n"),
        "form": F.col("form"),
        "prefix_chars": F.when(F.col("form") != "plain", F.col("a")),
        "middle_chars": F.when(F.col("form") != "plain", F.col("b") - F.col("a")),
        "output": output,
    }
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in told]
    return cut.select(*kept, *(c.alias(name) for name, c in told.items()))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. No part holds a mark, so each mark is found where it was put."""
    p, s, m = (rf"\Q{x}\E" for x in marks)
    some, rest = f"({UNIT}*?)", f"({UNIT}*+)"
    psm = F.regexp_replace(output, rf"{DOTALL}\A{p}{some}{s}{some}{m}{rest}\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"{DOTALL}\A{s}{some}{p}{some}{m}{rest}\z", "$2$3$1")
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
