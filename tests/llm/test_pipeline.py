import random

import corpus_pipeline
from forgelake.llm import language

LETTERS = {"aa": "bcdaeiou", "bb": "fghaeiou"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(3, 8))) for _ in range(n))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_pipeline_keeps_clean_documents_and_drops_the_planted(spark, documents, tmp_path):
    rng = random.Random(0)
    clean = [(i, prose(rng, "aa" if i % 2 else "bb", 120), "aa" if i % 2 else "bb", "s") for i in range(40)]
    item = prose(rng, "aa", 30)
    near = clean[1][1].split()
    near[60] = "hadda"
    passage = prose(rng, "bb", 60)
    planted = [
        (100, "12 34 !!", None, None),
        (101, None, None, None),
        (102, clean[3][1], "aa", "s"),
        (103, " ".join(near), "aa", "s"),
        (104, f"{prose(rng, 'aa', 50)} {item} {prose(rng, 'aa', 50)}", "aa", "s"),
        (105, f"{prose(rng, 'bb', 50)}\n{passage}", None, "s"),
        (106, f"{passage}\n{prose(rng, 'bb', 55)}", "bb", "s"),
    ]
    folder = str(tmp_path)
    documents([*clean, *planted], "'x' AS length").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}"
        function(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "length"]
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    everyone = {r[0] for r in [*clean, *planted]}
    assert set(kept["language"]) == everyone - {100, 101} and kept["language"][105]["lang"] == "bb"
    # The exact copy loses its only line; the shared passage stays where it came first.
    assert set(kept["line_dedup"]) == set(kept["language"]) - {102}
    assert passage in kept["line_dedup"][105]["text"] and passage not in kept["line_dedup"][106]["text"]
    assert kept["line_dedup"][106]["n_chars"] == len(kept["line_dedup"][106]["text"])
    assert set(kept["near_dedup"]) == set(kept["line_dedup"]) - {103}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {104}
    assert set(range(40)) <= set(kept["decontamination"])
    pieces = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in pieces.collect()} == set(kept["decontamination"])


def test_stages_on_an_empty_table(spark, documents, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, documents([]), str(tmp_path)).count() == 0


def test_language_stage_without_labels_keeps_texts_with_letters(spark, documents, tmp_path):
    docs = documents([(1, "abc"), (2, "12"), (3, None)])
    assert [r["doc_id"] for r in stage("language")(spark, docs, str(tmp_path)).collect()] == [1]
    assert language.UNKNOWN == "und"


def test_language_stage_drops_other_languages_and_random_letters(spark, documents, tmp_path):
    rng = random.Random(3)
    vocabulary = {lang: [prose(rng, lang, 1) for _ in range(150)] for lang in LETTERS}
    text = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    rows = [(i, text(lang, 60), lang if i % 5 else None, "s") for i, lang in enumerate(list(LETTERS) * 60)]
    short = [(200, text("aa", 2), None, "s"), (201, text("bb", 4), "bb", "s")]
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = lambda alphabet: " ".join("".join(rng.choices(alphabet, k=rng.randint(3, 8))) for _ in range(60))
    junk = [(300 + i, noise(letters), None, "s") for i in range(10)]
    junk += [(320 + i, noise("абвгдежзиклмнопрст"), None, "s") for i in range(10)]
    junk += [(340 + i, noise("bcdfghaeiou"), None, "s") for i in range(10)]
    kept = stage("language")(spark, documents([*rows, *short, *junk]), str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in [*rows, *short]}
    assert all(r["lang"] == list(LETTERS)[r["doc_id"] % 2] for r in kept if r["doc_id"] < 200)


def test_language_stage_judges_every_text_once(spark, documents, tmp_path, monkeypatch):
    """Shares come from all labelled rows: there is no second, sampled pass for them."""
    rng = random.Random(5)
    rows = [(i, prose(rng, "aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb", "s") for i in range(60)]
    judged, real = [], language.predict

    def watched(docs, *args, **options):
        judged.append(docs.count())
        return real(docs, *args, **options)

    monkeypatch.setattr(language, "predict", watched)
    assert stage("language")(spark, documents(rows), str(tmp_path)).count() == 60
    assert judged == [60]


def test_packing_remembers_few_words(spark, documents, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(20)]
    want = {tuple(r) for r in stage("packing")(spark, documents(rows), str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()}
    monkeypatch.setattr(corpus_pipeline, "PACKED_WORDS", 8)
    got = {tuple(r) for r in stage("packing")(spark, documents(rows), str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert got == want
