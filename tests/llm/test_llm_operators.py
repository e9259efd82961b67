"""Each operator against brute force on small inputs, and on odd ones."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.llm import chat, decontam, fingerprint, html, jaccard_join, langid, packing, pii, toxicity, warc
from tallyglass.llm.common import mix64, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, n string, key string, row string, _gone int, _row int, digest string, v int, part int"
WORDS = "the of and to in is on that it was for with as by at from are this be which have not or had but what all were when there can an your each".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x", "k", "r", 1, 1, "d", 0, 0) for i, t, lang in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, wordless, long and repeated texts; null and repeated ids; clashing columns."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "1234 !!", "en"), (5, long, "en"), (6, "one two", "en"), (6, "one two", "en"), (7, "one two", "fr"), (None, "a null id here", None)]
    rows += [(8, prose(rng, 40), "en"), (8, prose(rng, 40), "en"), (None, None, None)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# packing


def test_words_are_encoded_as_the_tokenizer_does():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    exact = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "\t", "Été", "l'eau", "it's", "123", "a1b2", "!!", "\u00a0", "日本語", "<|endoftext|>", "x" * 50, "\r\n", "'s", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    enc = packing.encoder(*packing.public_vocabulary())
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode_all(texts)]
    assert got == [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_get_their_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    exact = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "a b <|endoftext|> c <|endoftext|><|endoftext|>d e", "no <|endoftext| >", " x  <|endoftext|>  y\n"]
    got = {r["doc_id"]: r["ids"] for r in packing.pieces(frame(spark, [(k, t, "en") for k, t in enumerate(texts)]), with_ids=True).collect()}
    assert [got[k] for k in range(len(texts))] == [exact.encode(t, add_special_tokens=False).ids + [packing.END_ID] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once(counts):
    used = Counter()
    total = 0
    for lengths, n in packing.plan(counts, 64):
        assert 0 < sum(lengths) <= 64 and n > 0
        total += n
        for x in lengths:
            used[x] += n
    assert used == Counter(counts)
    # best-fit decreasing needs at most 11/9 of the best, plus a few
    assert total <= 11 / 9 * max(-(-sum(k * v for k, v in counts.items()) // 64), sum(v for k, v in counts.items() if k > 32)) + 4 or total <= sum(counts.values())


def test_plan_fills_exact_combinations():
    assert packing.plan({60: 5, 4: 5}, 64) == [((60, 4), 5)]
    assert sum(n for _, n in packing.plan({40: 3, 20: 3, 4: 3}, 64)) == 3
    assert sum(n for _, n in packing.plan({40: 2, 10: 2, 8: 2, 6: 2}, 64)) == 2


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packed_documents(spark, odd, none):
    rows = packing.pack_documents(odd).collect()
    check_packed(rows, packing.CAPACITY)
    enc = packing.encoder(*packing.public_vocabulary())
    want = Counter()
    for r in odd.collect():
        raw = enc.whole(r["text"] or "") + b"\0\0\0\0"
        n, start = len(raw) // 4, 0
        first = n % packing.CAPACITY or packing.CAPACITY
        for piece, length in enumerate([min(first, n)] + [packing.CAPACITY] * ((n - first) // packing.CAPACITY)):
            want[(r["doc_id"], piece, start, length, zlib.crc32(raw[start * 4 : (start + length) * 4]))] += 1
            start += length
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack_documents(none).count() == 0
    assert packing.pieces(odd, with_ids=True).filter("size(ids) <> length").count() == 0


def test_a_hot_length_is_numbered_in_buckets(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "CAST(0 AS LONG) AS start", "CAST(if(id < 900, 30, 34) AS LONG) AS length")
    packed = packing.pack(rows, 64, rows_per_bucket=50).collect()
    check_packed(packed, 64)
    assert len(packed) == 1000 and len({r["sequence_id"] for r in packed}) == 500


# n-gram join


def shingles(text, width):
    w = [x for x in re.split(r"[ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_groups(docs, width, num, den):
    sets = [shingles(t, width) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    low = {g: min(docs[i][0] for i in range(len(docs)) if group[i] == g) for g in set(group)}
    return {(docs[i][0], len(sets[i]), low[group[i]]) for i in range(len(docs))}


@pytest.fixture(scope="module")
def families():
    rng = random.Random(7)
    passage = prose(rng, 30)
    docs = []
    for _ in range(12):
        base = prose(rng, rng.choice([4, 30, 80, 200])).split()
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            text = " ".join(w)
            docs.append(text.upper() if rng.random() < 0.1 else text + (" " + passage if rng.random() < 0.3 else ""))
    docs += ["", "A b", "a  B", "c", "É x y", "é x y"]
    rng.shuffle(docs)
    return [(k * 3 + 1, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("width, num, world", [(3, 90, 1_000_000), (5, 80, 1_000_000), (3, 80, 300)])
def test_groups_equal_brute_force(spark, families, width, num, world):
    docs = spark.createDataFrame(families, "doc_id long, text string")
    rows = jaccard_join.groups(docs, width, num, 100, world_shingles=world).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == brute_groups(families, width, num, 100)
    sets = {i: shingles(t, width) for i, t in families}
    for r in rows:
        own = sets[r["doc_id"]]
        assert r["n_links"] == sum(bool(own) and i != r["doc_id"] and 100 * len(own & x) >= num * len(own | x) for i, x in sets.items())


def test_groups_of_odd_rows(spark, odd, none):
    rows = jaccard_join.groups(odd, 3, 90, 100).collect()
    assert len(rows) == 12
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert jaccard_join.groups(none).count() == 0
    assert jaccard_join.one_of_each(odd).columns == odd.columns
    assert {r["doc_id"] for r in jaccard_join.one_of_each(odd).collect()} == {1, 2, 3, 4, 5, 6, 8, None}


def test_one_row_of_each_group_stays_with_repeated_and_null_ids(spark):
    rng = random.Random(8)
    x, y, z, w = (prose(rng, 40) for _ in range(4))
    rows = [(3, x, "en"), (5, x, "en"), (5, y, "en"), (6, z, "en"), (6, z, "en"), (None, w, "en"), (None, w, "en"), (None, y, "en"), (5, x.upper(), "en"), (None, None, None), (None, None, None)]
    left = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(frame(spark, rows)).collect()), key=str)
    assert left == sorted([(3, x), (5, y), (6, z), (None, w), (None, None), (None, None)], key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=12))
def test_world_search_equals_pairs(sets):
    bound = jaccard_join.Bound(70, 100)
    values = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    label, links = jaccard_join.search_world(values, np.array([len(s) for s in sets]), bound)
    assert links.tolist() == [sum(a != b and 100 * len(a_ & b_) >= 70 * len(a_ | b_) for b, b_ in enumerate(sets)) for a, a_ in enumerate(sets)]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert label.tolist() == group


def test_a_family_over_many_blocks_loses_no_link(spark):
    rng = random.Random(17)
    base = prose(rng, 60).split()
    rows = []
    for k in range(120):
        w = list(base)
        w[rng.randrange(60)] = f"edit{k}"
        rows.append((k if k % 40 else None, " ".join(w), "en"))
    got = jaccard_join.groups(frame(spark, rows), 3, 80, 100, world_shingles=1200).collect()  # about 12 blocks
    assert [r["n_links"] for r in got] == [119] * 120 and {r["component_id"] for r in got} == {1}
    assert jaccard_join.groups(frame(spark, rows), 3, 80, 100).agg({"n_links": "sum"}).first()[0] == 120 * 119


def test_a_large_world_meets_by_size_and_every_pair_that_can_link_meets_once(spark):
    rng = random.Random(23)
    sizes = [int(rng.choice([1, 2, 9, 10, 81, 90, 100, 1000])) if rng.random() < 0.2 else int(10 ** rng.uniform(0, 4)) for _ in range(400)] + [300] * 100
    most = sum(sizes) // 20
    worlds = spark.createDataFrame([(1, k, k, n, 1) for k, n in enumerate(sizes)] + [(2, 1000 + k, 0, 5, 1) for k in range(3)], "world long, rep long, check long, n long, m long")
    rows = jaccard_join.deal(worlds, jaccard_join.Bound(90, 100), most).collect()
    small = [r for r in rows if r["rep"] >= 1000]
    assert len(small) == 3 and len({r["task"] for r in small}) == 1 and not any(r["many"] for r in small)
    rows = [r for r in rows if r["rep"] < 1000]
    assert len(rows) < 5 * len(sizes)  # 40 blocks by hash would take 40 of each
    tasks = {}
    for r in rows:
        tasks.setdefault(r["task"], []).append(r)
    assert max(sum(sizes[r["rep"]] for r in t) for t in tasks.values()) <= 3 * most  # sets here are as large as parts, which by hash are not even
    met = {}
    for t in tasks.values():
        for x in t:
            for y in t:
                if x["rep"] < y["rep"] and (x["key"]["a"] == x["key"]["b"] or x["block"] != y["block"]):
                    met[x["rep"], y["rep"]] = met.get((x["rep"], y["rep"]), 0) + 1
    assert set(met.values()) == {1}
    assert all((x, y) in met for x in range(len(sizes)) for y in range(x + 1, len(sizes)) if 100 * min(sizes[x], sizes[y]) >= 90 * max(sizes[x], sizes[y]))


def test_search_of_a_large_family_is_fast():
    import time

    rng = np.random.default_rng(3)
    common = np.sort(rng.choice(1 << 40, 80, replace=False)).astype(np.uint64)
    sets = [np.sort(np.append(np.delete(common, rng.choice(80, 2, replace=False)), rng.integers(1 << 41, 1 << 42, 2)).astype(np.uint64)) for _ in range(3000)]
    begin = time.time()
    label, links = jaccard_join.search_world(np.concatenate(sets), np.full(3000, 80), jaccard_join.Bound(90, 100))
    assert time.time() - begin < 60 and set(label.tolist()) == {0} and links.sum() > 3000 * 2000


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id AS a", "explode(array(id, id + 1)) AS b").unionByName(spark.range(100, 103).selectExpr("id AS a", "CAST(1000 AS LONG) AS b"))
    got = {r["node"]: r["label"] for r in jaccard_join.components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 103), 100)}


def test_word_hashes_ignore_case_and_place():
    data = "One two\tONE \x0btwo x é".encode()
    h, starts, ends = word_hashes(np.frombuffer(data, np.uint8))
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4
    assert [data[a:z].decode() for a, z in zip(starts, ends)] == ["One", "two", "ONE", "two", "x", "é"]
    assert len(set(mix64(np.arange(1000, dtype=np.uint64)).tolist())) == 1000


# archives


def test_archive_round_trip(spark):
    pages = [(k, f"http://x/{k}", f"<p>page {k % 20} " + "shared words " * 30) for k in range(60)] + [(100, None, None), (101, "u v", "é" * 70_000), (None, "n", "no id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumnRenamed("x", "x").selectExpr("*", "'c' AS sha1", "1 AS payload", "2 AS refers_to")
    back = {r["page_id"]: r for r in warc.archive(df).collect()}
    assert len(back) == len(pages)
    first = {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(h or "", i)
    for i, _, h in pages:
        r, raw = back[i], (h or "").encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == warc.sha1_base32(raw)
        if first[h or ""] == i:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["block"]) == raw
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first[h or ""]
    assert warc.archive(df.limit(0)).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.archive(df, min_bytes=1000).collect()}
    assert set(small.values()) == {"response"}


def test_archives_of_repeated_page_ids(spark):
    pages = [(1, "u", "same"), (1, "v", "same"), (1, "u", "other"), (2, "u", "same"), (3, "u", "other"), (None, "u", "other")]
    back = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    told = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in back)
    assert told == [(0, "revisit", 1), (1, "response", 0), (1, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "revisit", 1)]


def test_long_partitions_become_several_archives(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k % 3}", f"<p>page {k % 40} " + "text " * 30) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "a"), archive_frames=17)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) == 4
    for f in files:
        content = f.read_bytes()
        assert int.from_bytes(content[:4], "little") == warc.DICTIONARY_MAGIC and len(list(warc.frames(content))) <= 16
    back = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert len(back) == 60 and all((r["record_type"] == "revisit") == (k >= 40) and (r["refers_to"] or k % 40) == k % 40 for k, r in back.items())


def test_archives_have_a_leading_dictionary_and_single_records():
    zstandard = pytest.importorskip("zstandard")
    records = [warc.record([(b"WARC-Type", b"response"), (b"WARC-Record-ID", b"<urn:page:%d>" % k)], b"the same words again and again %d" % k) for k in range(200)]
    data = list(warc.compressed(records, 1 << 20))
    assert int.from_bytes(data[0][:4], "little") == warc.DICTIONARY_MAGIC and len(data) == 201
    archive = warc.SKIP.encode().join(data)
    assert list(warc.frames(archive)) == records
    dictionary = zstandard.ZstdCompressionDict(data[0][8:])
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[77]) == records[76]
    assert sum(map(len, data[1:])) < len(b"".join(records)) / 3


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_few_records_have_a_dictionary_too(n):
    records = [warc.record([(b"WARC-Type", b"response"), (b"WARC-Record-ID", b"<urn:page:%d>" % k)], b"some words and a number %d" % k) for k in range(n)]
    data = list(warc.compressed(records))
    size = int.from_bytes(data[0][4:8], "little")
    assert size > 0 and len(data[0]) == size + 8 and len(data) == n + 1
    assert list(warc.frames(warc.SKIP.encode().join(data))) == records
    if n > 1:  # records lean on the dictionary
        import zstandard

        assert sum(map(len, data[1:])) < sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)


def test_dictionaries_know_what_stands_late_in_records():
    rng = random.Random(4)
    late = bytes(rng.randrange(256) for _ in range(600))
    records = [bytes(rng.randrange(256) for _ in range(30_000)) + late for _ in range(40)]
    built = warc.build_dictionary(records)
    assert any(late[k : k + 64] in built.as_bytes() for k in range(0, 536, 8))


def test_archives_end_at_bytes(spark, tmp_path):
    """Files of large pages stay small: an archive ends before its records exceed the bytes, a longer page is alone."""
    rng = random.Random(5)
    html = lambda n: "".join(rng.choice("abcdefgh <>/") for _ in range(n))
    pages = spark.createDataFrame([(k, "u", html(250_000 if k == 7 else 40_000)) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "a"), archive_bytes=100_000, archive_frames=50)
    files = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part")]
    assert len(files) >= 15
    seen = 0
    for f in files:
        content = f.read_bytes()
        assert int.from_bytes(content[:4], "little") == warc.DICTIONARY_MAGIC
        records = list(warc.frames(content))
        assert len(records) == 1 or sum(map(len, records)) <= 100_000
        seen += len(records)
    assert seen == 30 == warc.read(spark, str(tmp_path / "a")).count()


# chat


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<|>[]/INSTs end\n", max_size=40))
def test_escaping_is_reversible_and_hides_control_strings(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(x in e for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
    assert chat.parse(chat.opening("user") + e + chat.CLOSING) == [("user", text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a|><\\\n", max_size=12), st.text(alphabet="b|><\\\n/end", max_size=16)), max_size=5))
def test_any_roles_and_texts_read_back(turns):
    formatted = "".join(chat.opening(r) + chat.escape(t) + chat.CLOSING for r, t in turns)
    assert chat.parse(formatted) == turns


def test_examples_and_digests(spark):
    rows = [(1, 0, "user", "hi <|end|>\n"), (1, 1, "assistant", "yo \\"), (1, 2, "user", None), (1, 3, "assistant", "</s>[INST]"), (2, 0, "user", "only"), (None, 0, None, None), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string").repartition(3)
    seg = chat.segments(df)
    got = {r["conv_id"]: r for r in chat.digests(seg).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        reply = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(turns) and g["loss_chars"] == len(reply)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(reply.encode()).hexdigest()
    shown = {(r["conv_id"], r["example"]): r for r in chat.render(seg).collect()}
    assert {k for k in shown if k[0] == 1} == {(1, 0), (1, 1)} and (2, 0) in shown and (None, 0) in shown
    for (conv, e), want in {(1, 0): "yo \\", (1, 1): "</s>[INST]"}.items():
        r = shown[conv, e]
        assert chat.unescape(r["text"][r["loss_start"] : r["loss_end"]]) == want
        assert len(r["text"]) == r["end"] and chat.parse(r["text"])[-1] == ("assistant", want)
    assert shown[2, 0]["loss_start"] is None
    assert sum(r["end"] for k, r in shown.items() if k[0] == 1) == got[1]["formatted_chars"]
    assert chat.digests(chat.segments(df.limit(0))).count() == 0


def test_ties_repeats_and_long_conversations(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1, "system", "z"), (1, None, "user", "first")]
    rows += [(2, k, "assistant" if k % 2 else "user", f"turn {k} " + "t" * 40) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat.digests(chat.segments(df)).collect()}
    for conv in (1, 2):
        turns = sorted((t is not None, t or 0, r, x) for c, t, r, x in rows if c == conv)
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256("".join(x for _, _, r, x in turns if r == "assistant").encode()).hexdigest()


def test_digests_are_read_from_whole_examples(spark):
    rows = [(c, k, "assistant" if k % 2 else "user", f"{c} says {k} <|end|>") for c in (1, 2) for k in range(7)]
    made = chat.expand(chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(made) == 8
    for r in made:
        want = [(role, t) for c, k, role, t in rows if c == r["conv_id"] and k <= (6 if r["last"] else 2 * r["example"] + 1)]
        assert chat.parse(r["text"]) == want
        assert r["loss_start"] is None if r["last"] else chat.unescape(r["text"][r["loss_start"] : r["loss_end"]]) == want[-1][1]
    wrong = [r.asDict() | ({"text": r["text"].replace("1 says 0", "1 says 9")} if (r["conv_id"], r["example"]) == (1, 1) else {}) for r in made]
    for given, fails in ((made, False), ([tuple(r.values()) for r in wrong], True)):
        back = chat.fold(chat.read_examples(spark.createDataFrame(given, chat.EXAMPLES)))
        if fails:
            with pytest.raises(Exception, match="no prefix"):
                back.collect()
        else:
            assert {r["conv_id"]: r["formatted_chars"] for r in back.collect()} == {c: sum(len(r["text"]) for r in made if r["conv_id"] == c) for c in (1, 2)}


# personal data


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.+- 01234(5)", max_size=40))
def test_emails_are_the_patterns_matches(text):
    assert pii.emails(text) == [m.span() for m in pii.EMAIL.finditer(text)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="12.. a", max_size=40))
def test_dotted_groups_are_the_patterns_matches(text):
    assert pii.dotted(text) == [m.span() for m in pii.IP.finditer(text)]


def test_base_spans_of_long_runs_take_linear_time():
    import time

    begin = time.time()
    for t in ("1" * 1_000_000 + ".", "1." * 500_000, "1.1.1.1" * 100_000, "+1" * 400_000, "a@" * 400_000, "4 " * 400_000, "x@y.z " * 100_000):
        pii.base_spans(t)
    assert time.time() - begin < 60


def test_base_spans():
    text = "a.b@c.de 1.2.3.4; 256.1.1.1; 4111-1111 1111 1111; 4111111111111112; +1 (234) 555-0000; +12"
    assert [(k, text[a:z]) for k, a, z in pii.base_spans(text)] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111-1111 1111 1111"), ("phone", "+1 (234) 555-0000")]


def test_revealing_terms_are_found(spark):
    rng = random.Random(5)
    rows = [(k, "\n".join(f"{prose(rng, 8)} Zorbliq {prose(rng, 3)} mail z@q.com {prose(rng, 5)}" for _ in range(2)), "en") for k in range(8)]
    rows += [(100 + k, prose(rng, 60) + "\n" + prose(rng, 40), "en") for k in range(300)]
    docs = frame(spark, rows)
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    text = dict((i, t) for i, t, _ in rows)
    for k in range(8):
        terms = {text[k][int(a) : int(z)] for kind, a, z in (s.split(":") for s in found[k]["spans"].split(",")) if kind in pii.TERM_KINDS}
        assert "Zorbliq" in terms and "the" not in terms
        assert found[k]["n_email"] == 2
    assert all(found[100 + k]["spans"] == "" for k in range(300))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("Zorbliq" not in clean[k] and "z@q.com" not in clean[k] and "[EMAIL]" in clean[k] for k in range(8))
    assert all(clean[100 + k] == text[100 + k] for k in range(300))


def test_terms_of_an_entity_in_one_line_are_masked_in_the_whole_document(spark):
    rng = random.Random(6)
    line = f"mail q@z.org {prose(rng, 40)} Vexomir {prose(rng, 5)}"
    rows = [(1, f"{line}\n{prose(rng, 10)} vexomir again", "en")]
    rows += [(10 + k, "\n".join(prose(rng, 30) for _ in range(10)), "en") for k in range(500)]
    docs = frame(spark, rows)
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    terms = [rows[0][1][int(a) : int(z)] for kind, a, z in (s.split(":") for s in found[1].split(",")) if kind in pii.TERM_KINDS]
    assert terms.count("Vexomir") == 1 and terms.count("vexomir") == 1 and "the" not in terms
    assert all(found[10 + k] == "" for k in range(500))
    assert "vexomir" not in {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}[1].lower()


def plain_disclosing(texts, chance=0.001, at=0.75):
    """(entity, term): share, counted line by line."""
    lines = [line for t in texts for line in (t or "").split("\n")]
    total, words, entities, both = len(lines), Counter(), Counter(), Counter()
    for line in lines:
        words.update(set(re.findall(r"[^\W\d_]{2,}", line.lower())))
        spans = pii.base_spans(line)
        here = {pii.entity(k, line[a:z]) for k, a, z in spans}
        near = {m[0].lower() for m in re.finditer(r"[^\W\d_]{2,}", line) if all(m.end() <= a or m.start() >= z for _, a, z in spans)}
        entities.update(here)
        both.update((e, w) for e in here for w in near)
    out = {}
    for (e, w), k in both.items():
        expected = entities[e] * words[w] / total
        if k <= expected or entities[e] >= total:
            continue
        tail = np.exp(-expected) * (np.e * expected / k) ** k / np.sqrt(2 * np.pi * k) / (1 - expected / (k + 1))
        share = np.log2(k * total / (entities[e] * words[w])) / np.log2(total / entities[e])
        if tail <= chance and share >= at:
            out[e, pii.code(w)] = share
    return out


def test_disclosing_terms_equal_the_plain_counts(spark):
    rng = random.Random(30)
    names = ["Zorbliq", "Vexomir", "Quandel", "Trumbix"]
    rows = []
    for k in range(160):
        lines = [prose(rng, rng.randrange(3, 12)) for _ in range(rng.randrange(1, 5))]
        if k % 4 == 0:
            who = rng.randrange(4)
            lines[rng.randrange(len(lines))] += f" {names[who]} writes from p{who}@x.org, {rng.choice(['10.0.0.1', '+1 555 123 4567', 'nothing'])} {rng.choice(names)}"
        rows.append((k, "\n".join(lines) if k % 50 else None, "en"))
    docs = frame(spark, rows)
    want = plain_disclosing([t for _, t, _ in rows])
    got = {(r["entity"], r["term"]): r["share"] for r in pii.disclosing(docs, pii.scan(docs)).collect()}
    assert len(want) >= 4 and set(got) == set(want)
    assert all(abs(got[k] - x) < 1e-9 for k, x in want.items())


def test_a_line_of_ten_thousand_addresses_is_one_class(spark):
    rng = random.Random(31)
    names = [f"w{''.join(rng.choices('abcdefghij', k=9))}" for _ in range(300)]
    line = " ".join(f"u{k}@x.org {names[k % 300]}" for k in range(10_000))
    rows = [(1, line + "\n" + prose(rng, 10), "en"), (2, f"again {line}"[6:] + "\nother " + names[0], "en")]
    rows += [(10 + k, "\n".join(prose(rng, 20) for _ in range(10)), "en") for k in range(200)]
    docs = frame(spark, rows)
    lines, kin, total = pii._counted(pii.scan(docs))
    assert total == 2004 and [r["m"] for r in lines.collect()] == [2]
    assert kin.count() == 10_000 and kin.select("kin").distinct().count() == 1
    assert pii.told_by_class(docs, lines, kin, total, pii.CHANCE, pii.GENERALISE_AT).count() <= 300  # pairs, not 10,000 x 300
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert found[1]["n_email"] == found[2]["n_email"] == 10_000
    text = dict((i, t) for i, t, _ in rows)
    for i in (1, 2):
        told = {text[i][int(a) : int(z)] for kind, a, z in (s.split(":") for s in found[i]["spans"].split(",")) if kind in pii.TERM_KINDS}
        assert set(names) - {names[0]} <= told and not told & set(WORDS)


def test_classes_of_many_pairs_meet_the_documents_own_terms(spark, monkeypatch):
    rng = random.Random(32)
    odd_words = ["Zorbliq", "Vexomir", "Quandel", "Trumbix", "Plorvane"]
    rows = []
    for k in range(120):
        here = rng.sample(odd_words, 2) if k % 5 == 0 else []
        rows.append((k, "\n".join([f"{prose(rng, 6)} {' '.join(here)} {'ask h@x.org' if here else ''} {prose(rng, 3)}", *(prose(rng, 9) for _ in range(4))]), "en"))
    docs = frame(spark, rows)
    want = {tuple(r) for r in pii.find(docs).select("doc_id", "spans").collect()}
    assert any("term" in s for _, s in want)
    monkeypatch.setattr(pii, "LISTED", 1)
    assert {tuple(r) for r in pii.find(docs).select("doc_id", "spans").collect()} == want


def test_generalised_terms_become_the_class_of_their_shape():
    assert pii.rewrite("Anna NATO went x@y.zz", "email:15:21,term:0:4,term:5:9,term:10:14") == "[NAME] [CAPITALS] [WORD] [EMAIL]"
    assert pii.rewrite("Anna went", "term_removed:0:4") == " went"


def test_pii_of_odd_rows(odd, none):
    assert pii.find(odd).count() == 12
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and out.count() == 12
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def test_overlapping_spans_are_merged():
    assert pii.rewrite("abcdefgh", "email:1:4,ip:3:6") == "a[EMAIL]gh"


# fingerprints


def gen_jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def test_fingerprints_estimate_generalised_jaccard(spark):
    rng = random.Random(11)
    docs = [(k, prose(rng, rng.choice([20, 60, 150]))) for k in range(80)]
    rows = {r["doc_id"]: r for r in fingerprint.compare_edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs, reverse=True)
    off = []
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + other[:cut]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off += [r["near_edited"] - gen_jaccard(t, edited), r["near_next"] - gen_jaccard(t, other)]
    assert abs(np.mean(off)) < 0.03 and np.sqrt(np.mean(np.square(off))) < 0.09


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprint.compare_edits(odd).collect()
    assert len(rows) == 12
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"0" * 256}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.compare_edits(none).count() == 0


# toxicity


def test_toxic_words_are_learned(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        words = prose(rng, rng.choice([20, 60])).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbly", "snarky", "vexful"]))
        rows.append((k, " ".join(words), "en"))
        labels.append((k, 1, int(bad), "x"))
    docs = frame(spark, rows)
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2}
    right = [(r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held]
    assert sum(right) / len(right) > 0.95


def plain_probabilities(rows, every, text, discount=3):
    """P_c(w | v) of each word of ``text`` by dictionaries: ``rows`` of (words, label), ``every`` text's words."""
    start = "\0"
    stem = lambda w, n: w.encode()[:n]
    n = [Counter(), Counter()]
    for words, label in rows:
        n[label].update(zip([start, *words], words))
    after = [Counter(w for _, w in n[c]) for c in (0, 1)]
    stems = [Counter() for _ in (0, 1)]
    for c in (0, 1):
        for w, k in after[c].items():
            stems[c][stem(w, 6)] += k
    company = Counter(k for _, k in {(None if v == start else stem(v, 4), stem(w, 4)) for words in every for v, w in zip([start, *words], words)})
    known = {w for c in (0, 1) for w in after[c]}
    in_class = Counter()
    for s in {stem(w, 6) for w in known}:
        in_class[s[:4]] += stems[0][s] + stems[1][s]

    def level(counts, key, below):
        own = [sum(max(x - discount, 0) for x in counts[c].values()) for c in (0, 1)]
        total = sum(counts[0].values()) + sum(counts[1].values())
        hand = 1 - sum(own) / total if min(own) > 0 else 1.0
        return [(1 - hand) * max(counts[c][key] - discount, 0) / max(own[c], 1e-9) + hand * below[c] for c in (0, 1)]

    out = []
    for v, w in zip([start, *text], text):
        k, s = stem(w, 4), stem(w, 6)
        both_s, both_w = stems[0][s] + stems[1][s], after[0][w] + after[1][w]
        shared = (company[k] + 0.5) / (sum(company.values()) + 0.5 * 2**20) * (both_s or 1) / (in_class[k] + 1)
        p = level(stems, s, [shared, shared])
        p = level(after, w, [x * (both_w or 1) / (both_s + 1) for x in p])
        out.append(level([Counter({b: x for (a, b), x in n[c].items() if a == v}) for c in (0, 1)], w, p))
    return np.array(out)


def test_toxicity_equals_plain_kneser_ney(spark):
    rng = random.Random(21)
    bad = ["scumbag", "idiotic", "idiots", "trash"]
    rows = [([rng.choice(bad if label and rng.random() < 0.4 else WORDS[:12]) for _ in range(rng.randrange(1, 15))], label) for label in [0, 1] * 60]
    more = [[rng.choice(WORDS) for _ in range(9)] for _ in range(30)]
    df = spark.createDataFrame([(" ".join(w), label) for w, label in rows], "text string, toxic int")
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([w for w, _ in rows] + more)], "doc_id long, text string")
    model = toxicity.Model(*toxicity.class_counts(df))
    model.with_continuation(toxicity.company(docs))
    assert model.evidence(*toxicity.tokens(np.zeros(0, np.uint8), np.array([0, 0]))).tolist() == [[0.0, 0.0]]
    for text in (["the", "idiots", "and", "trash"], ["scumbags", "idiotically", "zzz", "of", "the"], more[0], rows[1][0]):
        data = np.frombuffer(" ".join(text).encode(), np.uint8)
        got = model.probabilities(*toxicity.tokens(data, np.array([0, len(data)])))
        want = plain_probabilities(rows, [w for w, _ in rows] + more, text)
        assert np.allclose(got, want, rtol=1e-4)


def test_class_probabilities_sum_to_one(spark):
    rng = random.Random(22)
    rows = [(" ".join(rng.choice(WORDS[:10]) for _ in range(12)), k % 2) for k in range(80)]
    model = toxicity.Model(*toxicity.class_counts(spark.createDataFrame(rows, "text string, toxic int")))
    total = np.zeros(2)
    for w in WORDS[:10]:  # after "the": all known words, and what is left for unknown ones
        data = np.frombuffer(f"the {w}".encode(), np.uint8)
        total += model.probabilities(*toxicity.tokens(data, np.array([0, len(data)])))[1]
    assert (total <= 1 + 1e-9).all() and (total > 0.5).all()


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 1), (None, 1, 0), (6, 0, None)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        rows = toxicity.toxicity(odd, lab).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0


# language


def test_languages_are_told_apart(spark):
    rng = random.Random(4)
    french = "le la de et les des un une du que qui dans pour pas sur avec est au par plus".split()
    rows = []
    for k in range(200):
        words = [rng.choice(french if k % 2 else WORDS) for _ in range(12)]
        rows.append((k, " ".join(words), "fr" if k % 2 else "en"))
    got = langid.identify(frame(spark, rows)).collect()
    assert all(r["lang_pred"] == ("fr" if r["doc_id"] % 2 else "en") for r in got)


def plain_languages(rows):
    """lang_pred and score of each row by dictionaries, word by word."""
    letters = lambda t: "".join(c.lower() if c.isalpha() else " " for c in t).split()
    grams = lambda w, n: list(w) if n == 1 else [f"|{w}|"[i : i + n] for i in range(len(w) + 3 - n)]
    learned = [(t, lang) for i, t, lang in rows if lang and t and zlib.crc32(str(i).encode()) % 4 != 2]
    languages = sorted({lang for _, lang in learned})
    counts = {kind: {lang: Counter() for lang in languages} for kind in (0, 1, 2, 3, 4)}
    for t, lang in learned:
        for w in letters(t):
            counts[0][lang][w] += 1
            for n in (1, 2, 3, 4):
                counts[n][lang].update(grams(w, n))
    every = {kind: set().union(*c.values()) for kind, c in counts.items()}

    def logs(kind, key):
        return np.array([np.log((counts[kind][x][key] + 0.1) / (counts[kind][x].total() + 0.1 * (len(every[kind]) + 1))) for x in languages])

    def word(w):
        if w in every[0]:
            return logs(0, w)
        for n in (4, 3, 2, 1):
            known = [g for g in grams(w, n) if g in every[n]]
            if known:
                return np.mean([logs(n, g) for g in known], 0)
        return np.zeros(len(languages))

    out = {}
    for i, t, _ in rows:
        words = letters(t or "")
        total = sum(map(word, words), np.zeros(len(languages)))
        best = int(total.argmax())
        out[i] = (languages[best], 1 / np.exp((total - total[best]) / np.sqrt(len(words))).sum()) if words else ("und", 0.0)
    return out


def test_languages_equal_the_plain_backoff(spark):
    rng = random.Random(14)
    french = "le la de et les été un une où que qui dans pour pas sur avec est au par plus cœur".split()
    rows = []
    for k in range(120):
        own = french if k % 2 else WORDS
        words = [rng.choice(own) + rng.choice(["", "", "s", "ère" if k % 2 else "ing"]) for _ in range(rng.randrange(9))] + rng.choice([[], ["Zzyx"], ["ΛΌΓΟΝ", "日本"], ["supercali" * 20], ["42", "—½"]])
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(words), rng.choice(["fr" if k % 2 else "en", None])))
    want = plain_languages(rows)
    got = langid.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4


def test_words_are_runs_of_letters_at_any_width():
    texts = ["Ünïcode 日本語 x1y", "", "𝒜bc — ½ ñ", "éé"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    w = langid.Words(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert ["".join(map(chr, w.code[a:z])) for a, z in zip(w.start, w.end)] == ["ünïcode", "日本語", "x", "y", "𝒜bc", "ñ", "éé"]
    assert w.owner.tolist() == [0, 0, 0, 0, 2, 2, 3]


def test_language_of_odd_rows(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == 12
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 4)} == {"und"}
    kept = langid.keep_identified(odd, 0.3)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {5, 6, 7, 8, None}
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0


# decontamination


def edit_distance_within(item, text):
    """Fewest edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.choice([5, 12, 40]))) for k in range(12)] + [(90, None), (91, "ab"), (92, "")]
    docs = []
    for k in range(40):
        item = items[k % 12][1]
        w = list(item)
        for _ in range(k % 6 * len(item) // 100):
            w[rng.randrange(len(w))] = rng.choice("abcxyzé日")
        docs.append((k, prose(rng, 30) + " " + "".join(w).upper() + "!\n" + prose(rng, 20) if k % 3 else prose(rng, 60), "en"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    norm = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())
    for i, t, _ in docs:
        for j, q in items[:12]:
            k = decontam.budget(len(norm(q)), decontam.EDIT_RATE)[0]
            near = edit_distance_within(norm(q), norm(t))
            assert ((i, j) in got) == (near <= k), (i, j, near, k)
            if (i, j) in got:
                assert got[i, j]["edits"] == near and 0 <= got[i, j]["start"] < got[i, j]["end"] <= len(t)


def test_repeats_in_item_and_text_take_bounded_time_and_are_found():
    import time

    begin = time.time()
    index = decontam.Index([(1, "a" * 8000), (2, "ab" * 3000 + "é"), (3, "the end of the line")])
    data = ("x " + "a" * 10_000 + " the end of thé line " + "ab" * 3000 + "é").encode()
    got = decontam.search(index, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert {(item, edits) for _, item, edits, _, _ in got} == {(1, 0), (2, 0)}  # one edit in 19 characters is too much
    data = ("b" * 5 + "a" * 3950 + "c" + "a" * 4020).encode()
    got = decontam.search(decontam.Index([(1, "a" * 8000)]), np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert [(item, edits) for _, item, edits, _, _ in got] == [(1, 30)]
    assert time.time() - begin < 60


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=24), st.text(alphabet="abc", max_size=40), st.integers(0, 6))
def test_banded_alignment_equals_the_whole_table(item, text, k):
    code = lambda t: np.array([ord(c) for c in t], np.uint32)
    near = edit_distance_within(item, text)
    got = decontam.align(code(item), code(text), k)
    assert (got is not None) == (near <= k and len(text) + k >= len(item)) or (got is None and near == len(item))
    if got:
        edits, a, z = got
        assert edits == near and edit_distance_within(text[a:z], item) <= max(edits, 0) + abs(len(item) - (z - a))


def test_fifty_blocks_of_items_are_one_plan_and_planted_passages_are_found(spark):
    rng = random.Random(40)
    items = [(i, prose(rng, rng.randrange(15, 60))) for i in range(300)]
    docs, planted = [], set()
    for k in range(400):
        text = prose(rng, 120)
        if k % 4 == 0:
            for i in rng.sample(range(300), 2):
                passage = list(items[i][1])
                for _ in range(int(len(passage) * 0.04)):  # within the budget of edits
                    passage[rng.randrange(len(passage))] = rng.choice("qxz")
                text += ". " + "".join(passage) + ". " + prose(rng, 20)
                planted.add((k, i))
        docs.append((k, text, "en"))
    docs = frame(spark, docs)
    benchmark = spark.createDataFrame([*items, (900, None), (901, ""), (902, "short")], "item_id long, text string")
    size = sum(len(t) for _, t in items)
    whole = decontam.matches(docs, benchmark)
    blocks = decontam.matches(docs, benchmark, block_bytes=size // 49)
    want = {tuple(r) for r in whole.collect()}
    assert planted <= {(r[0], r[1]) for r in want}  # recall 1 on what is planted
    assert {tuple(r) for r in blocks.collect()} == want
    plan = [decontam.matches(docs, benchmark, block_bytes=size // n)._jdf.queryExecution().simpleString() for n in (4, 49)]
    assert plan[0].count("MapInArrow") == plan[1].count("MapInArrow") and "Union" in plan[1]


def test_a_block_that_many_texts_go_to_is_copied_to_several_tasks(spark, monkeypatch):
    rng = random.Random(41)
    items = [(i, prose(rng, 30)) for i in range(20)]
    docs = frame(spark, [(k, f"{prose(rng, 20)}. {items[k % 2][1]}. {prose(rng, 20)}" if k % 3 else prose(rng, 40), "en") for k in range(150)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {tuple(r) for r in decontam.matches(docs, benchmark).collect()}
    monkeypatch.setattr(decontam, "SLOT_BYTES", 2_000)
    assert len(want) >= 100 and {tuple(r) for r in decontam.matches(docs, benchmark, block_bytes=500).collect()} == want


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "a null id here"), (2, None)], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.matches(odd, bench).collect()] == [None]
    assert decontam.without_leaks(odd, bench).count() == 11
    assert decontam.matches(odd, bench, block_bytes=1).count() == 1
    assert decontam.matches(none, bench).count() == 0 and decontam.matches(odd, bench.limit(0)).count() == 0
    assert decontam.without_leaks(odd, bench.limit(0)).count() == 12


# main text


STOPS = frozenset("the of and to in a is".split())
LONG = "The cat sat in the house of the man and the dog went to the park in the rain of the day. " * 3


def test_main_text_rules():
    page = f"<head><title>t</title><body><div class='nav-bar'><a href=/>x</a></div><h2>Head</h2><p>{LONG}<p>Short &amp; sweet.<p>{LONG}<div>Buy now</div><footer>f</footer>"
    assert html.main_text(page, STOPS) == "\n\n".join(["Head", LONG.strip(), "Short & sweet.", LONG.strip()])
    article = "<nav>n</nav><article><header><h1>T</h1></header><p>one<br>two <a href=x>three</a><div class=ad>x</div><script>var a='</p>'</script><ul><li>i<li>j</ul><section class='comments'>c</section></article><aside>s</aside>"
    assert html.main_text(article, frozenset()) == "T\n\none two three\n\ni\n\nj"
    assert html.main_text(None, STOPS) == "" and html.main_text("<", STOPS) == html.main_text("<", STOPS)


def test_a_teaser_article_does_not_settle_the_page():
    page = f"<article><p>teaser</p></article><div><p>{LONG}</p><p>{LONG}</p></div>"
    assert html.main_text(page, STOPS) == LONG.strip() + "\n\n" + LONG.strip()
    page = f"<article><p>{LONG}</p><p>{LONG}</p></article><div><p>{LONG}</p></div>"  # the larger part: a prior
    assert html.main_text(page, STOPS) == LONG.strip() + "\n\n" + LONG.strip()


def plain_blocks(page):
    """Blocks of a well-formed page by the standard parser: (text, share of linked letters, boilerplate, in an article, heading)."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out, self.now = [], [], []

        def end_block(self):
            text = " ".join("".join(t for t, _ in self.now).split())
            if text:
                linked = sum(len("".join(t.split())) for t, link in self.now if link)
                tags = [t for t, _ in self.open]
                boiler = any(t in ("nav", "footer", "aside") or c == "ad" for t, c in self.open)
                self.out.append((text, linked / len(text.replace(" ", "")), boiler, "article" in tags, any(t in ("h1", "h2") for t in tags)))
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag != "a" and tag != "b":
                self.end_block()
            self.open.append((tag, dict(attrs).get("class")))

        def handle_endtag(self, tag):
            if tag != "a" and tag != "b":
                self.end_block()
            self.open.pop()

        def handle_data(self, data):
            self.now.append((data, any(t == "a" for t, _ in self.open)))

    w = Walk()
    w.feed(page)
    w.end_block()
    return w.out


def plain_main_text(page, stops):
    """The two passes, straight from their definition."""
    found = plain_blocks(page)

    def label(x, main):
        text, density, boiler, _, heading = x
        if boiler or density > (0.5 if main else 0.2):
            return "bad"
        if len(text) < 70:
            return "bad" if density and not main else "near" if heading else "short"
        words = re.findall(r"[^\W\d_]+", text.lower())
        share = sum(w in stops for w in words) / max(1, len(words))
        return ("good" if len(text) > 200 else "near") if share >= 0.2 else "near" if share >= 0.1 or main else "bad"

    def settle(labels, edge):
        out = []
        for i, x in enumerate(labels):
            left = next((y for y in labels[:i][::-1] if y in ("good", "bad")), edge)
            right = next((y for y in labels[i + 1 :] if y in ("good", "bad")), edge)
            out.append(x if x in ("good", "bad") else left if left == right else "good" if x == "near" else "bad")
        return out

    labels = [label(x, x[3]) for x in found]
    inside = sum(len(x[0]) for x, y in zip(found, labels) if x[3] and y != "bad")
    outside = sum(len(x[0]) for x, y in zip(found, labels) if not x[3] and y == "good")
    if inside and inside >= outside:
        run = 0
        runs = []
        for k, x in enumerate(found):
            run += k > 0 and x[3] != found[k - 1][3]
            runs.append(run)
        for r in set(runs):
            own = [k for k in range(len(found)) if runs[k] == r and found[k][3] and not found[k][2]]
            for k, y in zip(own, settle([labels[k] for k in own], "good")):
                labels[k] = y
        labels = [y if x[3] or y == "bad" else "short" for x, y in zip(found, labels)]
    else:
        labels = [label(x, False) for x in found]
    return "\n\n".join(x[0] for x, y in zip(found, settle(labels, "bad")) if y == "good")


def test_extraction_equals_the_plain_two_passes():
    rng = random.Random(5)
    junk = "xq zzv wkj ptt vvn".split()

    def piece(inside):
        words = [rng.choice(rng.choice([sorted(STOPS), WORDS, junk])) for _ in range(rng.choice([1, 4, 15, 30, 60]))]
        if rng.random() < 0.4:
            k = rng.randrange(len(words))
            words[k:] = [f"<a href='x'>{' '.join(words[k:])}</a>"]
        text = " ".join(words)
        kind = rng.choice(["p", "p", "p", "h2", "li", "div class='ad'", "aside"])
        return f"<{kind}>{text}</{kind.split()[0]}>"

    kept = 0
    for _ in range(300):
        parts = [piece(False) for _ in range(rng.randrange(6))]
        if rng.random() < 0.7:
            parts.append("<article><h1>A title</h1>" + "".join(piece(True) for _ in range(rng.randrange(7))) + "</article>")
        parts += [piece(False) for _ in range(rng.randrange(4))]
        page = "<html><body><nav><a href='/'>home</a></nav>" + "".join(parts) + "<footer>f</footer></body></html>"
        assert html.main_text(page, STOPS) == plain_main_text(page, STOPS)
        kept += bool(html.main_text(page, STOPS))
    assert kept > 100


def test_extraction_of_very_long_and_broken_pages_takes_linear_time():
    import time

    begin = time.time()
    for t in ('<a "' * 250_000, "<b>" * 330_000, "</b>" * 250_000, "<b></i>" * 140_000, "<div>" * 200_000, "<p><a>" * 160_000, "<html " * 160_000, '<a href="x>' * 90_000 + "<p>hi</p>"):
        html.main_text(t, STOPS)
    assert time.time() - begin < 60
    assert html.main_text("<div>" * 100_000 + f"<p>{LONG}", STOPS) == LONG.strip()


def test_stop_words_go_by_the_language_of_the_page(spark):
    en, fr = "the cat and the dog and the house " * 8, "le chat et le chien et le lit " * 8
    pages = [(k, "u", f"<html lang='en'><p>{en}</p>") for k in range(30)] + [(100, "u", f"<html lang=fr-FR><p>{fr}</p>"), (101, "u", f"<p>{fr}</p>"), (102, "u", f"<html lang=en><p>{fr}</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    stops = html.stop_words(df, share=0.1)
    assert stops.by_language["fr"] == {"le", "et", "chat", "chien", "lit"} and "the" in stops.by_language["en"]
    got = {r["page_id"]: r["text"] for r in html.extract(df, stops).collect()}
    assert got[0] == en.strip() and got[100] == got[101] == fr.strip() and got[102] == ""


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None), (1, None, ""), (None, "v", "<article>é &eacute;&nbsp;x</article>"), (2, "w", "<" * 5000), (3, "w", "<p " * 2000), (4, "x", "&#99999999; &bogus; </div></div>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = html.extract(df).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["url"] == "v"] == ["é é x"]
    assert html.extract(df.limit(0)).count() == 0
