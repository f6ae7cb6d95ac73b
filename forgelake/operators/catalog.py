"""Read queries over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelake.functions.identity import issue_key, pull_request_key, shown_hash
from forgelake.operators.ordering import TOP_ROWS, rows_between
from forgelake.schemas import REPO

# Field lists of the repository listings.
SUMMARY_FIELDS = ("hash", "owner", "name", "language", "url")
EXTRA_FIELDS = ("description", "stars", "license", "has_open_license", "updated_at", "createdAt")
SEARCH_FIELDS = ("hash", "owner", "name", "language")
# Parameter texts that switch an option on.
EXPAND_ON = ("1", "true", "full")
COUNT_ON = ("count", "true", "1")
# Paging defaults and the user ranking.
PAGE_LIMIT = 100
TOP_USERS = 30
MIN_FOLLOWERS = 10


def is_on(value: str | bool | None, words: tuple[str, ...]) -> bool:
    return value if isinstance(value, bool) else value in words


def _hash_column(repos: DataFrame) -> Column:
    return shown_hash("owner", "name", "hash" if "hash" in repos.columns else None).alias("hash")


def _project(repos: DataFrame, fields) -> DataFrame:
    """The fields of a listing; one that the table does not have is there as a NULL of its type."""

    def column(field: str) -> Column:
        if field == "hash":
            return _hash_column(repos)
        return F.col(field) if field in repos.columns else F.lit(None).cast(REPO[field].dataType).alias(field)

    return repos.select(*map(column, fields))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("repo_id").agg(F.count("*").alias("issues_count"))


def list_repos(
    repos: DataFrame,
    *,
    expand: str | bool = False,
    include_issues: str | bool = False,
    issues: DataFrame | None = None,
) -> DataFrame:
    """All repositories; optionally with more fields and with their number of issues."""
    fields = [*SUMMARY_FIELDS]
    if is_on(expand, EXPAND_ON):
        fields += EXTRA_FIELDS
    listed = _project(repos, fields)
    if not is_on(include_issues, COUNT_ON):
        return listed
    # Counted before the join: it then meets one row per repository, however many issues one has.
    counts = issue_counts(issues)
    return (
        listed.withColumn("repo_id", F.concat_ws("/", "owner", "name"))
        .join(counts, "repo_id", "left")
        .withColumn("issues_count", F.coalesce("issues_count", F.lit(0).cast("bigint")))
        .drop("repo_id")
    )


def find_repo(repos: DataFrame, owner: str, name: str, *, expand: str | bool = False) -> DataFrame:
    return list_repos(repos.filter((F.col("owner") == owner) & (F.col("name") == name)), expand=expand)


def search_repos(repos: DataFrame, *, language: str = "", min_stars: int | None = None) -> DataFrame:
    """Repositories of a language (all when empty), optionally with at least ``min_stars``."""
    found = repos
    if language:
        found = found.filter(F.col("language") == language)
    if min_stars is not None:
        found = found.filter(F.col("stars") >= min_stars)
    return _project(found, SEARCH_FIELDS)


def list_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.select("login", "hash")


def find_contact(contacts: DataFrame, login: str) -> DataFrame:
    return contacts.filter(F.col("login") == login)


def repo_issues(issues: DataFrame, repo: str) -> DataFrame:
    """Issues of one repository in key order."""
    return issues.filter(F.col("repo_id") == repo).orderBy(issue_key())


def repo_pull_requests(pull_requests: DataFrame, repo: str) -> DataFrame:
    return pull_requests.filter(F.col("repo_id") == repo).orderBy(pull_request_key())


def page_bounds(page: str | int | None = None, limit: str | int | None = None) -> tuple[int, int]:
    """Offset and limit of a page request; what is no number counts as 0."""

    def number(value, default):
        if value is None:
            return default
        try:
            return int(value)
        except ValueError:
            return 0

    size = number(limit, PAGE_LIMIT)
    if size < 0:
        raise ValueError("limit must not be negative")
    return max((number(page, 1) - 1) * size, 0), size


def issue_page(
    issues: DataFrame,
    page: str | int | None = None,
    limit: str | int | None = None,
    *,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """One page of all issues in byte order of their key text."""
    offset, size = page_bounds(page, limit)
    keyed = issues.withColumn("key", issue_key())
    return rows_between(keyed, ["key"], offset, size, top_rows=top_rows)


def table_counts(
    tables: dict[str, DataFrame], tagged: DataFrame | None = None, names: Sequence[str] = (), entity: str = "entity"
) -> DataFrame:
    """Row count per table, empty tables included.

    Several tables that come out of one scan are given together as ``tagged``, whose ``entity`` is one of
    ``names``: they are counted in that one pass.
    """
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()]
    if tagged is not None:
        each = [F.count(F.when(F.col(entity) == name, 1)).alias(f"_{i}") for i, name in enumerate(names)]
        pairs = [F.struct(F.lit(name).alias("entity"), F.col(f"_{i}").alias("n")) for i, name in enumerate(names)]
        parts.append(tagged.agg(*each).select(F.explode(F.array(*pairs)).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)


def table_summary(tables: dict[str, DataFrame], tagged: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """The same counts as one row with a column per table."""
    counts = table_counts(tables, tagged, names)
    return counts.agg(*[F.sum(F.when(F.col("entity") == n, F.col("n"))).alias(n) for n in sorted([*tables, *names])])


def count_prefix(keys: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return keys.filter(F.col(key).startswith(prefix)).agg(F.count("*").alias("n"))


def count_keys(tables: dict[str, tuple[DataFrame, Column]], prefix: str) -> DataFrame:
    """How many keys of all tables begin with ``prefix``. ``tables`` has the rows and their key by the prefix of the
    table's own keys, which tells for most tables without reading them: none match, or all do."""
    parts = []
    for own, (rows, key) in tables.items():
        if own.startswith(prefix):
            parts.append(rows)
        elif prefix.startswith(own):
            parts.append(rows.filter(key.startswith(prefix)))
    if not parts:
        spark = next(iter(tables.values()))[0].sparkSession
        return spark.range(1).select(F.lit(0).cast("bigint").alias("n"))
    counts = [rows.agg(F.count("*").alias("n")) for rows in parts]
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("n"))


def top_users(users: DataFrame, *, language: str = "", min_followers: int = MIN_FOLLOWERS, n: int = TOP_USERS) -> DataFrame:
    """Users with more than ``min_followers`` followers, the most followed first."""
    ranked = users.filter(F.col("followers") > min_followers)
    if language:
        ranked = ranked.filter(F.col("language") == language)
    return ranked.orderBy(F.desc("followers"), "login").limit(n)


def distinct_users(visited: DataFrame, login: str = "login") -> DataFrame:
    return visited.agg(F.countDistinct(login).alias("n"))
