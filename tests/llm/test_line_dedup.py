import random

import pytest

from forgelake.llm import line_dedup


def brute_force(rows, min_words):
    """Every run of lines with enough words that begins at an earlier place too is deleted."""
    docs = [(i, t.split("\n")) for i, t in rows if t is not None]
    first, runs = {}, []
    for d, (_, lines) in enumerate(docs):
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b].split())
                if words >= min_words:
                    key = tuple(lines[a : b + 1])
                    runs.append((d, a, b, key))
                    first.setdefault(key, (d, a))
    gone = {d: set() for d in range(len(docs))}
    for d, a, b, key in runs:
        if (d, a) > first[key]:
            gone[d].update(range(a, b + 1))
    out = {i: None for i, t in rows if t is None}
    for d, (i, lines) in enumerate(docs):
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone[d])
    return out


def texts(rows, documents, **options):
    return {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(documents(rows), **options).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(documents, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 2, 3, 7, 12]))) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.8 else f"own {i} {rng.random()}" for _ in range(rng.randint(1, 14))]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    assert texts(rows, documents) == brute_force(rows, line_dedup.MIN_WORDS)


def test_long_runs_of_short_lines_need_deep_ranks(documents):
    lines = [f"x{i}" for i in range(60)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[5:40], "end"])), (3, "\n".join(lines[50:58]))]
    got = line_dedup.deduplicate(documents(rows)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_force(rows, line_dedup.MIN_WORDS)
    assert {r["doc_id"]: [tuple(d) for d in r["_deleted"] or []] for r in got} == {1: [], 2: [(1, 35)], 3: []}


def test_prefix_doubling_orders_suffixes(spark):
    lines = [5, 3, 5, 3, 5, 3, 9]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "_row long, line int, rank long")
    last = line_dedup.prefix_doubling(df, 4)
    assert len(last) == 3
    for h, level in enumerate(last):
        got = {r["line"]: r["rank"] for r in level.collect()}
        prefix = {i: tuple(lines[i : i + 2**h]) for i in got}
        assert all((got[i] < got[j]) == (prefix[i] < prefix[j]) for i in got for j in got)


@pytest.mark.parametrize("text", ["", "a", " a  b ", "a\tb c", "\t", "a b c", "x \x0b y\r"])
def test_words_in_a_line(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(line_dedup.words_in(df["t"])).first()[0] == len(text.split())


def test_corner_cases(documents):
    long = "one two three four five six seven eight nine ten"
    rows = [(3, None), (2, ""), (1, long), (5, long), (None, long), (4, f"{long}\nown\n{long}\n{long}")]
    got = texts(rows, documents)
    assert got == {3: None, 2: "", 1: long, 4: "own", 5: "", None: ""}
    same = line_dedup.deduplicate(documents([(7, long), (7, long)], "'p' AS deleted2")).collect()
    assert sorted(r["text"] for r in same) == ["", long]
    assert line_dedup.deduplicate(documents([])).count() == 0
    assert texts([(1, "a\nb"), (2, "c")], documents) == {1: "a\nb", 2: "c"}
