"""Stored entities and the landing table of raw responses."""

from pyspark.sql import types as T

_TEXT, _NUMBER, _FLAG, _TIME = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CONTACT = _struct(
    id=_TEXT, login=_TEXT, url=_TEXT, avatar=_TEXT, company=_TEXT, email=_TEXT, location=_TEXT, bio=_TEXT, hash=_TEXT,
    updated_at=_TIME,
)
REPO = _struct(
    id=_TEXT, name=_TEXT, owner=_TEXT, url=_TEXT, description=_TEXT, stars=_NUMBER, language=_TEXT,
    has_open_license=_FLAG, license=_TEXT, hash=_TEXT, updated_at=_TIME, createdAt=_TIME,
)
PULL_REQUEST = _struct(
    id=_TEXT, repo_id=_TEXT, title=_TEXT, url=_TEXT, state=_TEXT, body=_TEXT, author=_TEXT, created_at=_TIME,
    updated_at=_TIME, hash=_TEXT,
)
ISSUE = T.StructType([*PULL_REQUEST.fields, T.StructField("responses", _TEXT)])
TRANSITION = _struct(seq=_NUMBER, from_state=_TEXT, to_state=_TEXT)

# One row per fetched page; a failed fetch lands with its status and a NULL body.
LANDING = _struct(
    endpoint=_TEXT, params=T.MapType(_TEXT, _TEXT), page=T.IntegerType(), status=T.IntegerType(), body=_TEXT
)
