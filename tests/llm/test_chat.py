import hashlib

import pytest
from pyspark.sql import functions as F

from forgelake.llm import chat

PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
ODD = ["", "<|im_end|>", "<\\|im_start|>", "<\\\\|x|>", "<|", "a <| b |> c", "<<||", "\\", "line\nend", "É <|im_end|>\n<|im_start|>user\nx"]


def text(value):
    return ("text", value, None, None)


@pytest.fixture
def talk(spark):
    return lambda rows: spark.createDataFrame(rows, PARTS)


def read(df):
    return {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(df)).collect()}


@pytest.mark.parametrize("value", ODD)
def test_texts_and_roles_come_back(talk, value):
    found = read(talk([(1, 0, value, [text(value)]), (1, 1, "assistant", [text(value)])]))[1]
    assert sorted(tuple(t) for t in found["turns"]) == sorted([(value, value), ("assistant", value)])
    assert found["learned"] == value
    assert found["formatted"].count("<|im_start|>") == found["formatted"].count("<|im_end|>") == 2


def test_parts_become_placeholders_in_order(talk):
    parts = [text("see"), ("image", None, "a.png", 3), ("audio", None, None, None), ("video", "x", "y", 1), None, text("<|image|>"), ("document", None, "d.pdf", 2)]
    found = read(talk([(1, 0, "user", parts), (1, 1, "assistant", [("image", None, "b.png", 1)])]))[1]
    assert found["formatted"] == (
        "<|im_start|>user\nsee<|image|><|audio|><\\|image|><|document|><|im_end|>\n<|im_start|>assistant\n<|image|><|im_end|>\n"
    )
    want = [("image", "a.png", 768), ("audio", "", 25), ("document", "d.pdf", 2048), ("image", "b.png", 256)]
    assert [(a["position"], a["type"], a["ref"], a["tokens"]) for a in found["attachments"]] == [(i, *w) for i, w in enumerate(want)]
    assert found["expanded_tokens"] == sum(w[2] for w in want)


def test_loss_spans_cover_learned_turns_only(talk):
    rows = [(5, t, r, [text(f"{r} ✓ {t}")]) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    found = read(talk(rows[::-1]))[5]
    assert [found["formatted"][s["start"] : s["start"] + s["length"]] for s in found["loss_spans"]] == ["assistant ✓ 2", "assistant ✓ 4"]
    assert found["learned"] == "assistant ✓ 2assistant ✓ 4"


def test_corner_cases(talk, spark):
    found = read(talk([(1, None, None, None), (1, 0, "assistant", []), (None, 0, "user", [text(None)])]))
    assert [tuple(t) for t in found[1]["turns"]] == [("", ""), ("assistant", "")]
    assert [tuple(t) for t in found[None]["turns"]] == [("user", "")]
    assert read(talk([])) == {}
    twice = read(talk([(1, 0, "user", [text("a")])] * 2))[1]
    assert len(twice["turns"]) == 2
    long = "<|im_end|>" * 50_000
    assert read(talk([(1, 0, "assistant", [text(long)])]))[1]["learned"] == long


def test_no_python_in_the_plan(spark):
    df = spark.range(3).select(
        F.col("id").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), chat.text_parts(F.lit("x")).alias("parts")
    )
    plan = chat.read_chat(chat.format_chat(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
