"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text's terms are its lower-cased words between white space, weighted by how often
they occur. For each of ``SAMPLES`` samples k a term with weight w draws, from hashes of
the term and k, r and c ~ Gamma(2, 1) and b ~ Uniform(0, 1), and takes

    t = floor(ln w / r + b),    ln a = ln c - r * (t - b + 1);

the sample is the (term, t) with the smallest a. Two texts have the same sample with
the probability sum(min(w)) / sum(max(w)): their generalised Jaccard similarity.

Draws come from ``LEVELS`` quantiles of Gamma(2, 1): r is the middle of a level, ln c lies
within its level by further bits of the hash, and in the lowest level follows the
distribution's tail, c**2 / 2, to any depth. So a draw costs one hash and hardly ever a
logarithm. The order of a and the sample's identity are packed in one number (upper bits
the order, lower bits a hash of term and t), whose minimum finds both; each text needs one
pass of plain sums and minima, within whole-stage code. Each term is told ``BLOCK`` samples at
a time: code for all of them at once would be larger than what a core keeps at hand.

A fingerprint has ``BYTES`` bytes for each sample and is told as hexadecimal digits; the
likeness of two is the share of equal samples, less the share that meets by chance.

Defined cases: a null text is empty; texts without words have the fingerprint of no
term (all zeros) and are alike among themselves. Rows with equal ids are kept apart by a
64-bit hash of their text; equal rows are one for the neighbour order and are returned
each. Ids are ordered as numbers, a null id last, and equal ids by that hash. An empty
table gives an empty result. Very long texts are exploded into their words row by row.
Columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import saved

SAMPLES, BYTES = 64, 2
#: Samples that one row draws; a term has a row for each block of them.
BLOCK = 8
LEVELS = 128
#: Stands for a null id within the operator.
NO_ID = -(1 << 63)
#: Hexadecimal digits of a digest that one number takes.
_PIECE = 15


def gamma_quantile(p: float) -> float:
    """x with 1 - exp(-x) (1 + x) = p, by bisection."""
    low, high = 0.0, 64.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x) * (1 + x) < p else (low, x)
    return low


def numbers(values: list[float]) -> Column:
    """A constant array, written as one string so that plans stay small."""
    return F.split(F.lit(",".join(f"{x:.9g}" for x in values)), ",").cast("array<double>")


class Draws:
    """The tables of draws, as columns."""

    def __init__(self):
        r = [gamma_quantile((i + 0.5) / LEVELS) for i in range(LEVELS)]
        self.r, self.per_r = numbers(r), numbers([1 / x for x in r])
        edge = [math.log(gamma_quantile(i / LEVELS)) for i in range(1, LEVELS)]
        edge.append(math.log(gamma_quantile(1 - 0.1 / LEVELS)))  # the upper end never wins
        self.top = edge[0]
        self.low = numbers([edge[0], *edge[:-1]])
        self.step = numbers([0.0, *(b - a for a, b in zip(edge, edge[1:]))])

    def sample(self, term: Column, log_weight: Column, k: Column) -> Column:
        """The packed draw of a term (a 64-bit hash) with a weight for sample k (int); the smallest wins."""
        h = F.xxhash64(term, k)
        part = lambda shift, mask: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(mask))
        unit = F.lit(2.0**-16)
        spoke = part(48, LEVELS - 1).cast("int")
        level, within = part(56, LEVELS - 1).cast("int"), part(16, 0xFFFF) * unit
        tail = F.lit(self.top) + F.lit(0.5) * F.log(within + F.lit(2.0**-17))
        ln_c = F.when(level == 0, tail).otherwise(F.get(self.low, level) + F.get(self.step, level) * within)
        b = part(32, 0xFFFF) * unit
        t = F.floor(log_weight * F.get(self.per_r, spoke) + b)
        ln_a = ln_c - F.get(self.r, spoke) * (t - b + F.lit(1.0))
        order = ((ln_a + F.lit(1024.0)) * F.lit(float(1 << 20))).cast("long")  # positive, below 2**31
        identity = h.bitwiseXOR(t * F.lit(40503)).bitwiseAND(F.lit(0xFFFFFFFF))  # t is small: no overflow
        return F.shiftleft(order, 32).bitwiseOR(identity)


def fingerprints(texts: DataFrame, *keys: str, samples: int = SAMPLES) -> DataFrame:
    """``keys``, fingerprint (binary) and last, of each row of ``texts`` (keys, text, number); ``samples`` is a multiple of ``BLOCK``.

    Rows with ``number`` are no texts but hexadecimal numbers, which come back as ``last``: so
    digests can travel along with their texts, which are read once. Texts without words are
    left out. All steps group by the keys: rows that are dealt by some of them are not shuffled.
    """
    draws = Draws()
    words = texts.select(*keys, "number", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).filter("w <> ''")
    term = F.when(F.col("number"), F.conv("w", 16, 10).cast("long")).otherwise(F.xxhash64("w"))
    weighted = words.select(*keys, term.alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n")).select(*keys, "term", F.log(F.col("n").cast("double")).alias("lw"))
    blocks = F.explode(F.array(*(F.lit(k) for k in range(0, samples, BLOCK)))).alias("block")
    lowest = (F.min(draws.sample(F.col("term"), F.col("lw"), F.col("block") + F.lit(i))).alias(f"s{i}") for i in range(BLOCK))
    least = weighted.select(*keys, "term", "lw", blocks).groupBy(*keys, "block").agg(*lowest, F.max("term").alias("last"))
    digits = [F.lpad(F.hex(F.col(f"s{i}").bitwiseAND(F.lit((1 << 8 * BYTES) - 1))), 2 * BYTES, "0") for i in range(BLOCK)]
    parts = least.select(*keys, F.struct("block", F.concat(*digits).alias("digits")).alias("part"), "last")
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("last").alias("last"))  # samples / BLOCK parts
    return whole.select(*keys, F.unhex(F.array_join("parts.digits", "")).alias("fingerprint"), "last")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two binary fingerprints, corrected for equality by chance; 0 to 1."""
    same = sum((F.when(F.substring(a, 1 + k * BYTES, BYTES) == F.substring(b, 1 + k * BYTES, BYTES), 1).otherwise(0) for k in range(samples)), F.lit(0))
    chance = 256.0**-BYTES
    return F.greatest(F.lit(0.0), (same / F.lit(float(samples)) - F.lit(chance)) / F.lit(1 - chance))


def with_next(keys: DataFrame, parts: int) -> DataFrame:
    """``keys`` (id, h, n_chars) with next_id, next_h: of the next row by descending id; after the last, the first.

    Rows are dealt by ranges of id; only each range's first key crosses to its neighbour. The
    window over those heads has ``parts`` rows, one for some hundred thousand documents.
    """
    down = [F.col("id").desc(), F.col("h")]
    ranged = saved(keys.repartitionByRange(parts, *down).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*down)
    rows = ranged.withColumn("_next", F.lead(F.struct("id", "h")).over(within))
    heads = ranged.groupBy("part").agg(F.max_by(F.struct("id", "h"), F.struct("id", (-F.col("h").cast("decimal(20,0)")).alias("d"))).alias("head"))
    order = Window.orderBy("part")
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tails = heads.select("part", F.coalesce(F.lead("head").over(order), first).alias("head"))
    following = F.coalesce("_next", "head")
    return rows.join(tails, "part").select("id", "h", "n_chars", following["id"].alias("next_id"), following["h"].alias("next_h"))


def compare_edits(docs: DataFrame, chars_per_part: int = 4_000_000) -> DataFrame:
    """Fingerprints of all texts and of their edited versions, and their likenesses.

    The edited text replaces the last floor(n / 3) of n code points by the first as many
    (or all) of the next document. Texts move once, and the thirds that neighbours need;
    both versions are fingerprinted and digested where they lie, in one pass.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), "doc_id", "text")
    ids = saved(rows.select("id", "h", "doc_id", F.length("text").cast("long").alias("n_chars")))
    size = ids.agg(F.sum("n_chars").alias("chars"), F.count("*").alias("rows")).first()
    parts = max(1, -(-(size["chars"] or 0) // chars_per_part))
    order = saved(with_next(ids.select("id", "h", "n_chars").dropDuplicates(["id", "h"]), max(1, size["rows"] // 200_000)))
    texts = rows.select("id", "h", "text").repartition(parts, "id", "h")
    if order.count() < size["rows"]:  # equal rows are one here
        texts = texts.dropDuplicates(["id", "h"])
    asked = order.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    given = texts.join(asked.repartition(parts, "id", "h").hint("shuffle_hash"), ["id", "h"])
    given = given.select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), F.expr("substring(text, 1, need)").alias("part"))
    cut = F.expr("concat(substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS INT)), part)")
    edited = texts.join(given.repartition(parts, "id", "h").hint("shuffle_hash"), ["id", "h"]).select("id", "h", "text", cut.alias("edited"))
    places = range(1, 65, _PIECE)
    pieces = [F.substring(F.sha2("edited", 256), at, _PIECE) for at in places]
    both = edited.select("id", "h", F.posexplode(F.array("text", "edited", *pieces)).alias("v", "text")).withColumn("number", F.col("v") > 1)
    found = fingerprints(both, "id", "h", "v")
    of = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    none = F.unhex(F.lit("00" * (SAMPLES * BYTES)))
    sha = F.concat(*(F.lpad(F.hex(of(v, "last")), min(_PIECE, 65 - at), "0") for v, at in enumerate(places, 2)))
    told = found.groupBy("id", "h").agg(F.coalesce(of(0, "fingerprint"), none).alias("f0"), F.coalesce(of(1, "fingerprint"), none).alias("f1"), F.unhex(sha).alias("sha"))
    told = saved(told)
    near = told.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("f0").alias("fn"))
    next_ = order.select("id", "h", "next_id", "next_h").join(near, ["next_id", "next_h"]).select("id", "h", "fn")
    out = ids.join(told, ["id", "h"]).join(next_, ["id", "h"])
    shown = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id",
        "n_chars",
        shown("sha").alias("edited_sha256"),
        shown("f0").alias("fingerprint"),
        shown("f1").alias("edited_fingerprint"),
        likeness(F.col("f0"), F.col("f1")).alias("near_edited"),
        likeness(F.col("f0"), F.col("fn")).alias("near_next"),
    )
