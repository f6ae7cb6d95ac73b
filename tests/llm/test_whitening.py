import numpy as np
import pytest
from pyspark.sql import functions as F

from forgelake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, weights="one", components=16):
    """The same by plain numpy over all rows at once."""
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = {k: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for k, v in kept}
    counts = {}
    for k, _ in kept:
        counts[tuple(x[k])] = counts.get(tuple(x[k]), 0) + 1
    fit = np.array(list(counts), np.float64)
    w = np.ones(len(fit)) if weights == "one" else np.array(list(counts.values()), float)
    n = int(w.sum())
    sums = [sum(int(v[i]) * int(c) for v, c in zip(counts, w, strict=True)) for i in range(fit.shape[1])]
    centred = fit - np.array(sums) / n
    e, axes = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    order = np.argsort(-e)[:components]
    out = {}
    for k, _ in kept:
        y = (np.array(x[k], float) - np.array(sums) / n) @ axes[:, order] / np.sqrt(e[order])
        out[k] = (n, sum((n * a - s) ** 2 for a, s in zip(x[k], sums, strict=True)), y, e[order] / e.sum())
    return out


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_equals_numpy(spark, weights):
    random = np.random.default_rng(1)
    mix = random.normal(size=(8, 8))
    rows = [(i, (random.normal(size=8) @ mix).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(100)]
    rows += [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [float("nan")] + rows[0][1][1:]), (2003, [float("inf")] * 8)]
    found, column, _ = whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=5, weights=weights)
    got = whitening.by_component(found, column, ["vec_id"]).collect()
    want = brute(rows, weights, 5)
    assert len(got) == 5 * 400 and {r["vec_id"] for r in got} == set(want)
    sign = {}
    for r in got:
        n, deviation, y, share = want[r["vec_id"]]
        c = r["component"] - 1
        sign.setdefault(c, np.sign(r["whitened"] * y[c]))
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["whitened"] * sign[c] == pytest.approx(y[c], abs=1e-8)
        assert r["explained"] == pytest.approx(share[c], rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_corner_cases(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA))[0].count() == 0
    # One vector has no direction; vectors of other lengths are fitted apart; an empty one has no component.
    rows = [(1, [1.0]), (2, [1.0, 2.0]), (3, [3.0, 1.0]), (3, [3.0, 1.0]), (None, [2.0, 5.0]), (5, [])]
    found, column, fits = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert found.count() == 6
    got = whitening.by_component(found, column, ["vec_id"]).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == [(-1, 1), (-1, 2), (2, 1), (2, 2), (3, 1), (3, 1), (3, 2), (3, 2)]
    assert {r["n"] for r in got} == {3}


def test_huge_entries_are_exact_or_null(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])]
    found, column, _ = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    got = {r["vec_id"]: r[column]["deviation"] for r in found.collect()}
    assert got[1] is None and got[2] is None
    # S is the sum of 2^56, -2^56 and 320, and of 0, 64 and 128, besides the shift.
    assert got[3] == (3 * 320 - 320) ** 2 + (3 * 128 - 192) ** 2


def test_other_columns_stay_and_names_may_clash(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(20)], SCHEMA)
    names = ["_x", "_key", "_whitening", "key", "x", "copies", "weight", "d", "n", "whitened", "deviation"]
    clashing = rows.select("*", *(F.lit(7).alias(c) for c in names))
    found, column, _ = whitening.whiten(clashing)
    assert found.columns == [*clashing.columns, column]
    got = found.collect()
    assert len(got) == 20 and all(r[c] == 7 for r in got for c in names)


def test_query_over_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_whitening"](spark, folder).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows)
    assert len(got) == 16 * len(want)
    for c, part in got.groupby("component"):
        y = np.array([want[k][2][c - 1] for k in part["vec_id"]])
        assert np.abs(np.abs(y) - np.abs(part["whitened"])).max() < 1e-7
        assert abs(abs(np.sign(y) @ np.sign(part["whitened"])) - len(part)) < 1
    assert got["deviation"].tolist() == [want[k][1] for k in got["vec_id"]]
    assert got["identity_error"].max() < 1e-8
