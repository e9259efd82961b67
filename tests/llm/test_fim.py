"""Fill-in-middle examples against slices of Python strings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import fim

SCHEMA = "doc_id long, text string, n string, Form int"


def plainly(key, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "a", "\n", "é\n x\r", "😀" * 3, "x<P>y", "$1 \\ {2}", "<", "S><P", "a\x00b", "naïve 👩‍👩‍👧 text\n" * 7, "ab\n" * 40_000, "😀b" * 2_048, "same", "same"]
    out = [(i, t, "old", 1) for i, t in enumerate(texts * 6)]
    return [*out, (None, "no key", None, None), (None, None, None, None), (0, None, "old", 1)]


def test_texts(spark, rows):
    made = fim.transform(spark.createDataFrame(rows, SCHEMA))
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_marks(spark, rows):
    marks = ("<|prefix|>", "<|suffix|>", "[M.*]")
    made = fim.transform(spark.createDataFrame(rows, SCHEMA), seed=7, plain=0, suffix_first=50, marks=marks)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got if r.text} == {"psm", "spm"}
    with pytest.raises(ValueError):
        fim.transform(made, marks=("a", "a", "b"))


def test_nothing(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_and_no_shuffle(spark, rows):
    plan = fim.transform(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
