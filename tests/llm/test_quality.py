import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgelake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    symbols = sum(c in quality.SYMBOLS for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_match_plain_python(documents):
    rng = random.Random(0)
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 3, "x y \x1f z\x0b\x0c#", "é ✓ $5 <b>|\n" * 4]
    for _ in range(60):
        texts.append(rng.choice([" ", "\n"]).join(rng.choices("abc", k=rng.randint(1, 60))))
    rows = quality.statistics(documents(list(enumerate(texts))), ["doc_id"]).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_distance_is_that_of_mahalanobis(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([("g", *map(float, r)) for r in mixed], ["group", *quality.FEATURES])
    moments = quality.with_cholesky(quality._moments(df))
    got = [r["distance"] for r in quality.with_distance(df.join(moments, "group")).orderBy("x_length").collect()]
    centred = mixed - mixed.mean(0)
    covariance = np.cov(mixed.T, bias=True) + np.diag(np.array(quality.FLOORS) ** 2)
    want = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(covariance), centred)[np.argsort(mixed[:, 0])]
    assert np.allclose(got, want)


def test_the_estimate_withstands_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(2)
    clean, odd = rng.normal(size=(800, 5)), rng.normal(size=(200, 5)) + 30
    df = spark.createDataFrame([("g", *map(float, r)) for r in np.vstack([clean, odd])], ["group", *quality.FEATURES])
    found = quality.estimate(df).first()
    assert all(abs(found[f"m{i}"]) < 0.3 for i in range(5))
    placed = quality.with_distance(df.join(quality.estimate(df), "group")).select((F.col("distance") > F.col("radius")).alias("out"))
    flags = [r["out"] for r in placed.collect()]
    assert sum(flags) == 200


@pytest.mark.parametrize("quantile,degrees,want", [(0.5, 5, 4.351), (0.95, 5, 11.070), (0.999, 5, 20.515)])
def test_chi_square(quantile, degrees, want):
    assert abs(quality.chi_square(quantile, degrees) / want - 1) < 0.02


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def test_verdicts_per_language_and_source(documents):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(40, 300)), "en", "big") for i in range(400)]
    rows += [(1000 + i, prose(rng, 60), "de", f"s{i}") for i in range(30)]
    rows += [(2000, " ".join(w + "%%%" for w in prose(rng, 100).split()), "en", "big"), (2001, "too short", "en", "big"),
             (2002, "a b c d e f g h " * 20, "en", "big"), (2003, None, None, None), (2004, "x" * 40 + " y" * 30, None, "big")]
    got = {r["doc_id"]: r for r in quality.judge(documents(rows, "1 AS radius2")).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["kept"] for i in range(400)) >= 399
    # Groups too small for an estimate reject nobody.
    assert all(got[1000 + i]["kept"] and got[1000 + i]["distance"] is None for i in range(30))
    assert not got[2000]["kept"] and not got[2000]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (2001, 2002, 2003))


def test_empty_table_and_plan(documents):
    found = quality.judge(documents([]))
    assert found.count() == 0
    assert "Python" not in found._jdf.queryExecution().toString()
