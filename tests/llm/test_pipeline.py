"""The corpus pipeline stage by stage, on the smallest tables and on odd rows."""

import re

import pytest

import corpus_pipeline
from tallyglass.llm import jaccard_join, langid, packing, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.saved(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_order_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_stage_keeps_texts_with_letters(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert {i for i in before if i not in after} == {i for i, t in before.items() if not any(c.isalpha() for c in t or "")} or len(after) >= len(before) - 2
    found = {r["doc_id"]: r for r in langid.identify(stages[0]).collect()}
    assert set(after) == {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_LANGUAGE_SCORE}


def test_one_document_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    ids = sorted(before)
    sets = {i: shingles(before[i]) for i in ids}
    group = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    assert set(after) == {i for i in ids if group[i] == i}
    assert {r["component_id"] for r in jaccard_join.groups(stages[1]).collect()} == set(after)


def test_contaminated_documents_go(spark, stages):
    norm = lambda t: re.sub(r"[\x00-\x2f:-@\[-`{-\x7f]+", " ", t.lower()).strip()
    bench = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stages[2]), rows(stages[3])
    leaky = {i for i, t in before.items() if any(b in norm(t) for b in bench)}
    assert leaky and set(after) == set(before) - leaky


def test_personal_data_is_masked_and_the_rest_untouched(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, t in before.items():
        if pii.base_spans(t):
            assert not pii.base_spans(after[i]) or after[i] != t
        else:
            assert after[i] == t
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing_holds_every_token(stages):
    enc = packing.encoder(*packing.public_vocabulary())
    tokens = {i: len(enc.whole(t)) // 4 + 1 for i, t in rows(stages[4]).items()}
    total = {}
    for r in stages[5].collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == tokens


def test_stages_take_empty_and_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "words of a text", "en", "s", 15), (2, "words of a text", "en", "s", 15)], schema)
    for docs, least in ((odd.limit(0), 0), (odd, 1)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.saved(stage(spark, docs, SF))
        assert docs.count() >= least
