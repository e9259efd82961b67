"""N-gram Jaccard join by T-occurrence search, and the groups that its links make.

Two documents link when their sets of word shingles have a Jaccard similarity of
``num / den`` at least. Documents that link share T = ceil(sim * size) shingles or more,
which the join uses three times:

1. ``signatures``: each set, ordered by shingle hash, sends only its first
   n - T + l shingles. Linked sets share l of those at least, so a document without l
   shingles that others also sent has no partner and is done. Equal sets are one
   candidate from here on.
2. ``worlds``: of a candidate's shared shingles the l - 1 most frequent are left out;
   linked sets still share one. The connected components of documents and these
   shingles are closed worlds: no link crosses them. Frequent passages and lines are
   what is left out, so they do not tie worlds together.
3. ``search_world``: within a world each set asks the inverted lists of the sets before
   it for those that occur T times, by DivideSkip: the T - 1 longest lists are set aside, the
   short ones are merged, and what they hold is looked up in the long ones by binary search
   (a long list that is shorter than the look-ups would cost is merged as well). All links
   are found and counted, also between sets that are in a group already.

Lists are merged as sorted runs, by a merge tree; its members and counts are those of a heap.
A world beyond ``world_shingles`` is dealt into blocks by size and searched by pairs of blocks whose sizes can link,
so a task's memory is bounded and no link is lost. Links are found, not sampled: the
result equals brute force up to 64-bit hash collisions. Equal texts are not expanded into
pairs: they are one set with a number of documents, and links are counted by these numbers.

Defined cases: null texts and texts without words have the empty set and link with
nothing; texts with fewer words than a shingle have one shingle, the whole sequence.
Rows with equal ids are documents of their own. A row with a null id takes part and is
returned; it names its group only if all ids of the group are null (then by null). An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import Bits, apart, bits_for, flat_lists, forget, fresh, gathered_bits, mix64, saved, saved_at, text_chunks, word_hashes

#: Shingles of a world that one task searches at once; about 64 bytes each in memory.
WORLD_SHINGLES = 1_000_000
#: Merging a member costs as much as this part of a look-up.
LOOK_UP = 8
#: Stands for a null id within the join.
NO_ID = -(1 << 63)
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other, and how many each has."""
    h, starts, _ = word_hashes(data)
    n = len(offsets) - 1
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    out = np.maximum(words - width + 1, np.minimum(words, 1))
    text = np.repeat(np.arange(n), out)
    at = np.repeat(first[:-1] - (np.cumsum(out) - out), out) + np.arange(int(out.sum()))
    value = np.zeros(len(at), np.uint64)
    left = np.repeat(np.minimum(words, width), out)
    for k in range(width):
        use = left > k
        value[use] = mix64(value[use] * _NEXT + h[at[use] + k] + _GOLD)
    order = np.lexsort((value, text)) if len(value) else np.zeros(0, np.int64)
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=n)


class Bound:
    """The numbers of the T-occurrence problem for similarity num / den."""

    def __init__(self, num: int, den: int, slack: float = 1.0):
        self.num, self.den, self.slack = num, den, slack

    def need(self, n):
        """Shingles that a set of n shares with any partner, at least."""
        return -(-n * self.num // self.den)

    def level(self, n):
        """l: shared shingles asked of the sent ones."""
        return 1 + ((n - self.need(n)) * self.slack).astype(np.int64) if isinstance(n, np.ndarray) else 1 + int((n - self.need(n)) * self.slack)

    def sent(self, n):
        return np.minimum(n, n - self.need(n) + self.level(n))

    def least_level(self, n):
        """l of the smallest partner that a set of n can have."""
        return self.level(self.need(n))

    def linked(self, both: np.ndarray, n, m) -> np.ndarray:
        return self.den * both >= self.num * (n + m - both)


def with_breaks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a newline after each, so that no word runs over a border."""
    n = len(offsets) - 1
    return offsets + np.arange(n + 1), np.insert(data, offsets[1:], 0x0A) if n else data


def digests_of(value: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two numbers for each set: sums of its mixed members, equal for equal sets."""
    begin, total, out = np.cumsum(n) - n, np.zeros(len(value) + 1, np.uint64), []
    for key in (_GOLD, _NEXT):
        np.cumsum(mix64(value ^ key), out=total[1:])
        out.append(mix64(total[begin + n] - total[begin] + n.astype(np.uint64)).view(np.int64).copy())
    return out


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _key():
    return F.xxhash64(F.col("text").cast("string"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_id().alias("id"), _key().alias("key"), F.col("text").cast("string").alias("text"))


SIGNATURES = "id long, key long, n long, digest long, digest2 long, sent array<long>"


def signatures(docs: DataFrame, width: int, bound: Bound) -> DataFrame:
    """doc_id, hash of the text, size and 128-bit digest of each set, and its first shingles by hash."""

    def run(batches):
        for b in batches:
            for first, last, offsets, data in text_chunks(b):
                offsets, data = with_breaks(offsets, data)
                value, n = shingle_sets(data, offsets, width)
                begin = np.cumsum(n) - n
                digests = digests_of(value, n)
                k = np.where(n > 0, bound.sent(n), 0)
                at = np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(first, last - first) for c in ("id", "key")), pa.array(n), *map(pa.array, digests), flat_lists(value[at].view(np.int64), k)], names=["id", "key", "n", "digest", "digest2", "sent"]
                )

    return _texts(docs).mapInArrow(run, SIGNATURES)


def candidates(sets: DataFrame, bound: Bound) -> DataFrame:
    """rep, n and shared shingles (of those sent, the l - 1 most frequent left out) of sets that can have partners.

    ``sets``: rep, n, sent; one row for each different set.
    """

    def least(n):
        need = F.ceil(n * bound.num / bound.den).cast("long")
        return (1 + F.floor((need - F.ceil(need * bound.num / bound.den)) * bound.slack)).cast("long")

    # Counts go by 32 bits of the shingle, which halves what they take. Shingles that share them are counted together: then
    # one of a single set may stay, which ties it to nothing, and the order by counts is the same in all sets.
    short = F.hash("shingle")
    postings = sets.select("rep", F.explode("sent").alias("shingle"))
    often = postings.groupBy(short.alias("short")).agg(F.count("*").cast("int").alias("df")).filter("df > 1")
    # dealt by set before they are listed: single rows are smaller than partial lists
    kept = postings.join(often, short == F.col("short")).select("rep", "df", "shingle").repartition("rep")
    lists = kept.groupBy("rep").agg(F.collect_list(F.struct("df", "shingle")).alias("shared"))
    shared = lists.join(sets.select("rep", "n"), "rep")
    enough = shared.filter(F.size("shared") >= least(F.col("n")))
    return enough.select("rep", "n", F.expr("transform(array_sort(shared), x -> x.shingle)").alias("shared"), least(F.col("n")).alias("level")).select(
        "rep", "n", F.expr("slice(shared, 1, CAST(size(shared) - level + 1 AS INT))").alias("shared")
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node (values of ``a``) and label, the component's smallest node, of the two-sided graph ``edges`` (a, b).

    Each value of ``b`` first ties its nodes to the smallest of them, so that many shared
    values of the same nodes become one link. On these links, large-star and small-star
    rounds alternate until nothing changes; every round is written to the shared folder.
    """
    edges = saved(edges.select(F.col(a).alias("node"), F.col(b).alias("via")))
    low = edges.groupBy("via").agg(F.min("node").alias("low"))
    links = saved(edges.join(low, "via").filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct())
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = saved(small.filter("u <> v").distinct())
        after = print_of(links)
        if after == before:
            break
        before = after
    alone = edges.select("node").distinct().join(links.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left")
    return alone.select("node", F.coalesce("label", "node").alias("label"))


class Groups:
    """Union-find over 0 .. n-1 by arrays; a group's root is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        r = self.parent[of]
        while True:
            up = self.parent[r]
            if (up == r).all():
                break
            r = self.parent[up]
        self.parent[of] = r
        return r

    def join(self, members: np.ndarray) -> None:
        roots = np.unique(self.roots(members))
        self.parent[roots] = roots[0]


def merged(member: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is in the ascending lists at ``begin`` with ``length`` members, and in how many of them."""
    upto = np.cumsum(length)
    at = np.repeat(begin - (upto - length), length) + np.arange(int(upto[-1]) if len(upto) else 0)
    all_ = np.sort(member[at], kind="stable")  # sorted runs: a merge
    new = np.flatnonzero(np.append(True, all_[1:] != all_[:-1])) if len(all_) else np.zeros(0, np.int64)
    return all_[new], np.diff(np.append(new, len(all_)))


def search_world(values: np.ndarray, sizes: np.ndarray, bound: Bound, fresh: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The groups of linked sets (for each set the smallest index in its group), and each set's number of links.

    ``values``: the sets' members, set after set, each ascending. ``fresh``: only links
    between a True and a False are looked for (two blocks of a large world). ``weight``:
    how many documents a set stands for, as a partner.
    """
    n = len(sizes)
    groups, links = Groups(n), np.zeros(n, np.int64)
    weight = np.ones(n, np.int64) if weight is None else weight
    if n < 2:
        return groups.parent, links
    owner = np.repeat(np.arange(n), sizes)
    rank = np.unique(values, return_inverse=True)[1]
    order = np.argsort(rank, kind="stable")  # within a list, ascending by set
    lists, member = rank[order], owner[order]
    begin = np.searchsorted(lists, np.arange(lists[-1] + 2))
    keys = lists.astype(np.int64) * n + member  # all inverted lists, ready for binary search
    length = np.diff(begin)
    earlier = np.zeros(len(length), np.int64)  # members of each list before the set at hand
    starts = np.cumsum(sizes) - sizes
    for x in range(n):
        every = rank[starts[x] : starts[x] + sizes[x]]
        size, need = int(sizes[x]), int(bound.need(sizes[x]))
        mine = every[length[every] > 1]
        if len(mine) >= need and (fresh is None or fresh[x]):
            mine = mine[np.argsort(earlier[mine], kind="stable")]
            short, long = mine[: len(mine) - need + 1], mine[len(mine) - need + 1 :]
            found, both = merged(member, begin[short], earlier[short])
            keep = (size * bound.num <= sizes[found] * bound.den) & (sizes[found] * bound.num <= size * bound.den)
            if fresh is not None:
                keep &= ~fresh[found]
            found, both = found[keep], both[keep]
            if len(found):
                cheap = earlier[long] <= LOOK_UP * len(found)
                also, times = merged(member, begin[long[cheap]], earlier[long[cheap]])
                if len(also):
                    at = np.minimum(np.searchsorted(also, found), len(also) - 1)
                    both = both + np.where(also[at] == found, times[at], 0)
                for k in long[~cheap].tolist():
                    probe = np.int64(k) * n + found
                    both = both + (keys[np.minimum(np.searchsorted(keys, probe), len(keys) - 1)] == probe)
                near = found[bound.linked(both, size, sizes[found])]
                if len(near):
                    links[x] += weight[near].sum()
                    links[near] += weight[x]
                    groups.join(np.append(near, x))
        earlier[every] += 1
    return groups.roots(np.arange(n)), links


#: Block numbers of size classes that are dealt by hash begin here, with room for so many blocks of each.
_HEAVY, _ROOM = 1 << 40, 1 << 20


def deal(worlds: DataFrame, bound: Bound, world_shingles: int = WORLD_SHINGLES) -> DataFrame:
    """``worlds`` (world, rep, check, n, m) with the tasks that each set takes part in.

    Worlds that are too large are dealt into blocks by size and searched by pairs of blocks. Sizes of linked sets differ by the
    similarity at most, so in classes of that width linked sets are in the same class or the next: a block is a run of small
    classes, or a part by hash of one large class, and a set meets only the blocks with a class beside its own. Only ids and
    sizes are looked at; the shingles come to the tasks afterwards.
    """
    half = world_shingles / 2
    width = max(math.log(bound.den / bound.num), 1e-6) * (1 + 1e-6)  # a little wider, so that rounding parts no links
    classed = worlds.withColumn("class", F.floor(F.log("n") / width))
    weights = classed.groupBy("world", "class").agg(F.sum("n").alias("weight"))
    by = Window.partitionBy("world")  # a row for each class
    whole, light = F.sum("weight").over(by) <= world_shingles, F.col("weight") <= half
    run = F.floor((F.sum("weight").over(by.orderBy("class")) - F.col("weight")) / (half / 2))
    first = F.when(whole, 0).when(light, run).otherwise(_HEAVY + F.col("class") * _ROOM)
    parts = F.when(whole | light, 1).otherwise(F.ceil(F.col("weight") / half))
    placed = weights.select("world", "class", first.cast("long").alias("first"), parts.cast("long").alias("parts"), (~whole).alias("many"))
    block = F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("other")
    blocks = placed.select("world", "class", block).groupBy("world", "other").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    own = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block")
    dealt = classed.join(placed, ["world", "class"]).select("world", "class", "rep", "check", "m", "many", own)
    dealt = dealt.join(blocks, "world").filter(F.col("class").between(F.col("low") - 1, F.col("high") + 1))
    key = F.struct("world", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    return dealt.select(F.xxhash64("world", F.least("block", "other"), F.greatest("block", "other")).alias("task"), key.alias("key"), "many", "block", "rep", "check", "m")


def search_worlds(dealt: DataFrame, bound: Bound) -> DataFrame:
    """rep, grp and links of all rows of ``deal`` with their shingles; grp is the smallest linked rep found.

    Each task's sets are searched together; the groups of pairs of blocks are then joined.
    ``links`` counts the documents of other sets that a document of this set links with.
    """

    def run(batches):
        held: list[tuple] = []
        now = None
        out: list[tuple] = []
        for b in batches:
            column = b.column("shingles")
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            rows = zip(*(b.column(c).to_pylist() for c in ("key", "block", "rep", "many", "m")))
            for i, (key, block, rep, many, m) in enumerate(rows):
                if held and key != now:
                    out += solved(held)
                    held = []
                now = key
                held.append((rep, block, many, key, flat[offsets[i] : offsets[i + 1]].copy(), m))
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        if held:
            out += solved(held)
        if out:
            yield batch_of(out)

    def solved(held):
        held.sort(key=lambda r: r[0])
        key = held[0][3]
        fresh = None
        if key["a"] != key["b"]:  # each block's own pairs are found where it meets itself
            fresh = np.array([r[1] == key["b"] for r in held])
            order = np.argsort(fresh, kind="stable")
            held, fresh = [held[i] for i in order], fresh[order]
        label, links = search_world(np.concatenate([r[4] for r in held]), np.array([len(r[4]) for r in held]), bound, fresh, np.array([r[5] for r in held]))
        low: dict[int, int] = {}
        for r, g in zip(held, label.tolist()):
            low[g] = min(low.get(g, r[0]), r[0])
        return [(r[0], low[g], r[2], k) for r, g, k in zip(held, label.tolist(), links.tolist())]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["rep", "grp", "many", "links"])

    ordered = dealt.repartition("task").sortWithinPartitions("task", "key")
    found = saved(ordered.mapInArrow(run, "rep long, grp long, many boolean, links long"))
    whole = found.filter("NOT many").select("rep", "grp", "links")
    parts = found.filter("many")
    if not parts.limit(1).count():
        return whole
    tied = parts.filter("rep <> grp").select("rep", "grp", F.xxhash64("rep", "grp").alias("link"))
    both = tied.select("rep", "link").unionByName(tied.select(F.col("grp").alias("rep"), "link"))
    named = components(both, "rep", "link").select(F.col("node").alias("rep"), F.col("label").alias("grp"))
    sums = parts.groupBy("rep").agg(F.sum("links").alias("links")).join(named, "rep", "left")
    return whole.unionByName(sums.select("rep", F.coalesce("grp", "rep").alias("grp"), "links"))


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """digest and all shingles of the documents whose ids ``wanted`` (id) has, and of a few more.

    The tasks know the wanted ids by a bit table whose size follows their number, so the texts
    are not shuffled; where it says yes falsely, the caller's join drops the row.
    """
    bits = docs.sparkSession.sparkContext.broadcast(gathered_bits(wanted, "id", bits_for(wanted.count())).table)

    def run(batches):
        known = Bits.of(bits.value)
        for b in batches:
            b = b.filter(pa.array(known.has(b.column("id").to_numpy().view(np.uint64))))
            for _, _, offsets, data in text_chunks(b):
                offsets, data = with_breaks(offsets, data)
                value, n = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([*map(pa.array, digests_of(value, n)), flat_lists(value.view(np.int64), n)], names=["rep", "check", "shingles"])

    return _texts(docs).mapInArrow(run, "rep long, check long, shingles array<long>")


def _grouped(docs: DataFrame, width: int, num: int, den: int, slack: float = 1.0, world_shingles: int = WORLD_SHINGLES) -> DataFrame:
    """id, key, n, component_id, n_links, grp of every row: ``grp`` tells components apart, also those that share ids.

    Within, a different set goes by its digest; ``grp`` is null for the empty set.
    """
    bound = Bound(num, den, slack)
    spark = docs.sparkSession
    full, full_place = saved_at(signatures(docs, width, bound))
    signed = saved(full.drop("sent"))
    low = F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("low")
    known = full.filter("n > 0").groupBy("digest", "digest2").agg(low, F.count("*").alias("m"), F.min_by(F.struct("id", "n", "sent"), "id").alias("s"))
    with_sent, sets_place = saved_at(known.select(F.col("digest").alias("rep"), F.col("digest2").alias("check"), "low", "m", "s.id", "s.n", "s.sent"))
    forget(spark, full_place)  # what was sent lies in the sets now
    found = saved(candidates(with_sent.select("rep", "n", "sent"), bound))
    sets = saved(with_sent.drop("sent"))
    forget(spark, sets_place)
    worlds = components(found.select("rep", F.explode("shared").alias("shingle")), "rep", "shingle")
    worlds = saved(worlds.select(F.col("node").alias("rep"), F.col("label").alias("world")).join(sets.select("rep", "check", "id", "n", "m"), "rep"))
    members = full_sets(docs, worlds.select("id"), width).join(deal(worlds, bound, world_shingles), ["rep", "check"]).drop("check")
    linked = saved(search_worlds(members, bound))
    lows = linked.join(sets.select("rep", "low"), "rep").groupBy("grp").agg(F.min("low").alias("component"), F.count("*").alias("k")).filter("k > 1")
    named = linked.join(lows, "grp").select("rep", "component", "grp", "links", F.lit(True).alias("linked"))
    ids = sets.select(F.col("rep").alias("digest"), F.col("check").alias("digest2"), "rep", "low", "m").join(named, "rep", "left")
    of_all = (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")  # and the other documents of the same set
    ids = ids.select("digest", "digest2", F.coalesce("grp", "rep").alias("grp"), F.when(F.col("linked"), F.col("component")).otherwise(F.col("low")).alias("component_id"), of_all)
    out = signed.select("id", "key", "n", "digest", "digest2").join(ids, ["digest", "digest2"], "left")
    return out.select("id", "key", "n", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n") > 0, F.col("grp")).alias("grp"))


def groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, slack: float = 1.0, world_shingles: int = WORLD_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach, the document's own included;
    ``n_links`` is how many other documents the document links with.
    """
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    out = _grouped(docs, width, num, den, slack, world_shingles)
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"), "n_links")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group does: that with the smallest id, null ids last.

    Rows count, not ids: rows with the same id and different texts are told apart by the
    texts' hashes, and of rows with the same id and text one stays. Rows of the empty set all stay.
    Only rows that may go are shuffled with their texts.
    """
    there, mine, number, key, again, code = fresh(docs, "_gone", "_mine", "_number", "_key", "_again", "_code")
    rows = saved(_grouped(docs, width, num, den).filter("grp IS NOT NULL").groupBy("grp", "id", "key").agg(F.count("*").alias("m")))
    order = F.struct(F.col("id") == NO_ID, F.col("id"), F.col("key"))
    first = rows.groupBy("grp").agg(F.min(order).alias("first"), F.sum("m").alias("all")).filter(F.col("all") > 1)
    stays = (F.col("id") == F.col("first.id")) & (F.col("key") == F.col("first.key"))
    listed = rows.join(first, "grp").withColumn("stays", stays).filter("NOT stays OR m > 1")
    listed = saved(listed.select(F.col("id").alias(there), F.col("key").alias(mine), F.col("stays").alias(again), F.xxhash64("id", "key").alias(code)))
    keyed = docs.withColumn(number, _id()).withColumn(key, _key()).withColumn(code, F.xxhash64(number, key))
    clear, doubt = apart(keyed, listed, code)
    same = (F.col(number) == F.col(there)) & (F.col(key) == F.col(mine))
    copy = F.row_number().over(Window.partitionBy(number, key).orderBy(F.lit(1)))  # which of equal rows stays is all one
    told = doubt.join(listed.drop(code), same, "left").withColumn(code, copy)
    kept = told.filter(F.col(there).isNull() | (F.col(again) & (F.col(code) == 1)))
    return clear.select(docs.columns).unionByName(kept.select(docs.columns))
