"""Fingerprints and key texts. Each function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields each entity's fingerprint covers, in hashing order.
CONTACT_IDENTITY = ("login", "url")
REPO_IDENTITY = ("owner", "name", "url")
ISSUE_IDENTITY = ("repo_id", "id", "url")

# The key prefix of each entity.
CONTACT_PREFIX = "contact:"
REPO_PREFIX = "repo:"
ISSUE_PREFIX = "issue:"
PULL_REQUEST_PREFIX = "pr:"


def fingerprint(*parts: str | Column) -> Column:
    """Hex SHA-256 of the parts joined without a separator; NULL counts as the empty text."""
    return F.sha2(F.concat_ws("", *parts), 256)


def with_fingerprint(df: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """Fill an absent or empty ``hash``; a hash that is already there is trusted."""
    computed = fingerprint(*identity)
    if "hash" not in df.columns:
        return df.withColumn("hash", computed)
    return df.withColumn("hash", F.when(F.coalesce("hash", F.lit("")) == "", computed).otherwise(F.col("hash")))


def _byte(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def short_hash(value: str | Column) -> Column:
    """A fingerprint as few bytes, for rows that move: hex digests by their bytes, any other text as it is, told apart
    by the first byte."""
    value = F.col(value) if isinstance(value, str) else value
    digest = value.rlike(r"^[0-9a-f]{64}\z")
    return F.when(digest, F.concat(_byte("01"), F.unhex(value))).when(
        value.isNotNull(), F.concat(_byte("00"), F.encode(value, "UTF-8"))
    )


def long_hash(value: str | Column) -> Column:
    """The fingerprint that :func:`short_hash` was made of."""
    value = F.col(value) if isinstance(value, str) else value
    rest = F.substring(value, 2, 1 << 30)
    return F.when(F.substring(value, 1, 1) == _byte("01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def shown_hash(owner: str | Column, name: str | Column, stored: str | Column | None = None) -> Column:
    """Hash a repository is listed with: the stored one, else one over ``owner/name``.

    The fallback differs on purpose from the stored fingerprint of the same repository.
    """
    fallback = F.sha2(F.concat_ws("/", owner, name), 256)
    if stored is None:
        return fallback
    stored = F.col(stored) if isinstance(stored, str) else stored
    return F.when(F.coalesce(stored, F.lit("")) == "", fallback).otherwise(stored)


def repo_id(owner: str | Column = "owner", name: str | Column = "name") -> Column:
    return F.concat_ws("/", owner, name)


def contact_key(login: str | Column = "login") -> Column:
    return F.concat_ws("", F.lit(CONTACT_PREFIX), login)


def repo_key(owner: str | Column = "owner", name: str | Column = "name") -> Column:
    return F.concat_ws("", F.lit(REPO_PREFIX), repo_id(owner, name))


def issue_key(repo: str | Column = "repo_id", number: str | Column = "id") -> Column:
    return F.concat_ws("", F.lit(ISSUE_PREFIX), F.concat_ws("/", repo, number))


def pull_request_key(repo: str | Column = "repo_id", number: str | Column = "id") -> Column:
    return F.concat_ws("", F.lit(PULL_REQUEST_PREFIX), F.concat_ws("/", repo, number))


def id_text(number: str | Column) -> Column:
    """A numeric id as decimal text; absent counts as 0."""
    number = F.col(number) if isinstance(number, str) else number
    return F.coalesce(number, F.lit(0).cast("bigint")).cast("string")


def or_now(moment: str | Column, now: Column | None = None) -> Column:
    """``moment``, or the job's time where it is absent."""
    return F.coalesce(moment, F.current_timestamp() if now is None else now)
