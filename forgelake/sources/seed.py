"""Sample rows that show the engine's corner cases.

A contact that is seen twice, the second time with less; a repository with several issues and one
without any; an issue saved again with another address; and an empty table of pull requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelake import schemas

_URL = "https://hub.example"
_CONTACTS = [
    {"id": "31", "login": "mira", "url": f"{_URL}/mira", "location": "Oslo", "bio": "Maps and tides"},
    {"id": "32", "login": "tomo", "url": f"{_URL}/tomo", "company": "Harbour Lab"},
    {"id": "31", "login": "mira", "url": f"{_URL}/mira"},
]
_REPOS = [
    {"name": "tides", "owner": "mira", "url": f"{_URL}/mira/tides", "language": "Fortran", "stars": 12},
    {"name": "charts", "owner": "mira", "url": f"{_URL}/mira/charts", "language": "", "stars": 0, "license": "mit"},
    {"name": "buoys", "owner": "tomo", "url": f"{_URL}/tomo/buoys", "language": "Ada", "stars": 3},
]
_ISSUES = [
    {"id": str(n), "repo_id": "mira/tides", "title": title, "url": f"{_URL}/mira/tides/issues/{n}", "state": state, "author": "tomo"}
    for n, title, state in ((7, "Wrong phase at neap", "open"), (8, "Read gauge files", "closed"), (9, "Leap second", "open"))
] + [
    {"id": "1", "repo_id": "tomo/buoys", "title": "Lost signal", "url": f"{_URL}/tomo/buoys/issues/1", "state": "open"},
    {"id": "1", "repo_id": "tomo/buoys", "title": "Lost signal", "url": f"{_URL}/tomo/buoys/issues/1-moved", "state": "closed"},
]
_PULL_REQUESTS: list[dict] = []


def _table(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    """Rows in the entity's schema, absent texts empty, with their order of arrival ``seq``."""
    full = [tuple(row.get(f) for f in schema.names) + (seq,) for seq, row in enumerate(rows)]
    df = spark.createDataFrame(full, T.StructType([*schema.fields, T.StructField("seq", T.LongType())]))
    texts = [f.name for f in schema.fields if f.dataType.simpleString() == "string"]
    return df.fillna("", texts).fillna(False)


def seed_tables(spark: SparkSession, now: Column | None = None) -> dict[str, DataFrame]:
    moment = F.current_timestamp() if now is None else now
    issues = _table(spark, _ISSUES, schemas.ISSUE)
    created = F.when(F.col("state") == "closed", moment - F.expr("INTERVAL 1 DAY")).otherwise(moment)
    return {
        "contacts": _table(spark, _CONTACTS, schemas.CONTACT),
        "repositories": _table(spark, _REPOS, schemas.REPO),
        "issues": issues.withColumn("created_at", created),
        "pull_requests": _table(spark, _PULL_REQUESTS, schemas.PULL_REQUEST).withColumn("created_at", moment),
    }
