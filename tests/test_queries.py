"""Every named query against its SQL on DuckDB, on the driver's tables and on skewed ones."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry
from forgelake.operators.ordering import CHUNK_ROWS_KEY
from forgelake.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("FORGELAKE_TESTDATA", "/root/testdata/sf0.001")
# Those whose work depends on how rows spread over keys.
SKEWED = [
    "ingest_issues_json", "ingest_contributors_json", "ingest_counts", "page_cut", "contact_upsert", "repo_upsert",
    "upsert_written", "change_classes", "issue_upsert", "pr_upsert", "repos_with_issue_counts", "top_contributors",
    "org_links", "profile_page_repos", "bfs_reach", "bfs_budget", "markov_transitions", "markov_weights", "markov_lists",
    "markov_remove", "markov_walk", "stream_upsert", "stream_landed_issues", "bfs_entities", "crawl_tables", "table_counts",
]

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        if file.endswith(".parquet"):
            path = f"{folder}/{file}" if os.path.isfile(f"{folder}/{file}") else f"{folder}/{file}/*.parquet"
            con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def assert_agrees(spark, folder, name):
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    con = connect(folder)
    described = con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == {d[0]: d[1] for d in described}
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert got, "no rows to compare"
    assert table(df.columns, got) == table(columns, result.fetchall())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    assert_agrees(spark, FOLDER, name)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    df = entry(spark)
    assert df.columns == ["hash", "owner", "name", "language", "url", "issues_count"]
    # Some repositories have no issue, so the outer join meets zeros.
    assert df.filter("issues_count = 0").count() > 0 and df.filter("issues_count > 0").count() > 0


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The driver's tables with a third of the rows on one part, order line, customer, user and site."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    third = lambda *c: F.pmod(F.xxhash64(*c), F.lit(3)) == 0

    def moved(name, when, **values):
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        for column, value in values.items():
            df = df.withColumn(column, F.when(when, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")

    for name in ("region", "nation", "supplier", "documents", "embeddings", "benchmark", "labels", "conversations", "customer"):
        moved(name, F.lit(False))
    moved("part", F.lit(False))
    moved("orders", third("o_orderkey"), o_custkey=3)
    # Moved lines stay apart in their arrival order by their supplier and date.
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").dropDuplicates(["l_suppkey", "l_shipdate"])
    hot = third("l_orderkey", "l_suppkey")
    for column, value in (("l_partkey", 7), ("l_orderkey", 11), ("l_linenumber", 1)):
        lines = lines.withColumn(column, F.when(hot, F.lit(value)).otherwise(F.col(column)).cast(lines.schema[column].dataType))
    lines.repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    moved("events", third("event_id"), user_id=1)
    moved("pages", third("page_id"), url="http://one.example/x")
    return folder


@pytest.mark.parametrize("name", SKEWED)
def test_skewed_query(spark, skewed, name):
    spark.conf.set(CHUNK_ROWS_KEY, "60")
    try:
        assert_agrees(spark, skewed, name)
    finally:
        spark.conf.unset(CHUNK_ROWS_KEY)
