"""Every registered query on the driver's small tables: columns, types and rows."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint"
COLUMNS = {
    "op1_packing": ("documents", PIECES),
    "op2_near_dedup": ("documents", "doc_id bigint, class_id bigint, kept boolean"),
    "op3_decontamination": (None, "doc_id bigint, item_id bigint, score double"),
    "op4_token_files": ("documents", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"),
    "op5_chat": (
        None,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    ),
    "op6_quality": (
        "documents",
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean",
    ),
    "op7_language": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op8_html_text": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op9_line_dedup": ("documents", "doc_id bigint, text string"),
    "op10_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op11_whitening": (
        None,
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    ),
    "op12_bpe": ("documents", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"),
    "op13_collocations": (
        None,
        "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    ),
    "pipeline": (None, PIECES),
}
KEYS = {"documents": "doc_id", "pages": "page_id"}


def test_every_query_is_registered():
    assert set(COLUMNS) <= set(queries())
    assert {"op5_chat", "op13_collocations"} <= set(oracle_sql())


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n.startswith("op")])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=repr)
    found = queries()[name](spark, FOLDER).select(*columns)
    assert sorted(map(tuple, found.collect()), key=repr) == want and want


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, name):
    table, columns = COLUMNS[name]
    found = queries()[name](spark, FOLDER).persist()
    types = dict(found.dtypes)
    assert {c.split()[0]: c.split()[1] for c in columns.split(", ")}.items() <= types.items()
    assert found.count() > 0
    if table:
        key = KEYS[table]
        ids = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key)
        assert found.select(key).distinct().count() == ids.distinct().count()
        if name != "op1_packing":
            assert found.count() == ids.count()
    found.unpersist()
