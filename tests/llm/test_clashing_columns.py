"""Tables with further columns called like every helper column of the operators keep them, and get the same rows."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forgelake import llm
from forgelake.llm import bpe, decontaminate, html_text, line_dedup, near_dedup, whitening

OWN = {"doc_id", "text", "lang", "source", "n_chars", "item_id", "html", "page_id", "url", "embedding"}


def helper_names():
    """Every name the operators give to a column, whatever for."""
    sources = [*Path(llm.__file__).parent.glob("*.py"), Path(corpus_pipeline.__file__)]
    found = set()
    for path in sources:
        text = path.read_text()
        found |= set(re.findall(r'"(_[a-z_0-9]+)"', text)) | set(re.findall(r'\.alias\("(\w+)"\)', text))
        found |= set(re.findall(r'withColumn\("(\w+)"', text)) | set(re.findall(r'free_name\("(\w+)"', text))
    return sorted({n.lower() for n in found} - OWN)


def with_helpers(df):
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in helper_names()))


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n))


def some_documents(documents):
    rng = random.Random(1)
    passage = prose(rng, 40)
    rows = [(i, f"{prose(rng, 60)}\n{passage if i % 5 == 0 else prose(rng, 12)}", "aa", "s") for i in range(30)]
    return documents([*rows, (40, rows[2][1], "aa", "s"), (2, rows[2][1], "aa", "s"), (41, None), (42, "")])


def compared(function, df, key, column):
    """The rows of ``function`` with and without the further columns; those keep their values."""
    plain = sorted(map(repr, function(df).select(key, column).collect()))
    found = function(with_helpers(df))
    assert all(r[n] == f"own {n}" for r in found.select(*helper_names()).collect() for n in helper_names())
    assert sorted(map(repr, found.select(key, column).collect())) == plain and plain


def test_there_are_such_names():
    assert {"_deleted", "_row", "_copies", "_words", "_text", "_matches", "_html", "_found"} <= set(helper_names())


@pytest.mark.parametrize("name", ["near_dedup", "line_dedup", "decontamination", "language"])
def test_stages_of_the_pipeline(spark, documents, tmp_path, name):
    docs = some_documents(documents)
    item = docs.filter("doc_id = 7").first()["text"].split("\n")[0]
    folder = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    compared(lambda d: stage(spark, d, folder), docs, "doc_id", "text")


def test_operators(spark, documents):
    docs = some_documents(documents)
    compared(line_dedup.deduplicate, docs, "doc_id", "text")
    compared(near_dedup.deduplicate, docs, "doc_id", "text")
    benchmark = spark.createDataFrame([(1, docs.filter("doc_id = 7").first()["text"])], "item_id long, text string")
    compared(lambda d: decontaminate.find(d, benchmark), docs, "doc_id", "text")
    compared(lambda d: decontaminate.clean(d, benchmark), docs, "doc_id", "text")
    compared(lambda d: bpe.encode(d)[0], docs, "doc_id", "text")
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(20)], "doc_id long, embedding array<float>")
    compared(lambda d: whitening.whiten(d)[0], vectors, "doc_id", "embedding")
    pages = spark.createDataFrame([(1, "<p>one"), (2, None)], "page_id long, html string")
    compared(html_text.extract, pages, "page_id", "text")
