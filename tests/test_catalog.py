import pytest

from forgelake.operators import catalog
from forgelake.sources.seed import seed_tables


@pytest.fixture(scope="module")
def store(spark):
    return seed_tables(spark)


def test_round_trip_by_key(store):
    found = catalog.find_repo(store["repositories"], "mira", "tides", expand="true").first()
    assert (found.stars, found.description, found.language) == (12, "", "Fortran")
    assert catalog.find_repo(store["repositories"], "MIRA", "tides").isEmpty()
    assert catalog.find_contact(store["contacts"], "tomo").first().company == "Harbour Lab"
    assert catalog.find_contact(store["contacts"], "nobody").isEmpty()


def test_listing_fields_follow_the_options(store):
    repos, issues = store["repositories"], store["issues"]
    assert catalog.list_repos(repos).columns == list(catalog.SUMMARY_FIELDS)
    assert catalog.list_repos(repos, expand="no").columns == list(catalog.SUMMARY_FIELDS)
    for on in ("1", "true", "full", True):
        assert catalog.list_repos(repos, expand=on).columns == [*catalog.SUMMARY_FIELDS, *catalog.EXTRA_FIELDS]
    for on in ("count", "true", "1"):
        assert "issues_count" in catalog.list_repos(repos, include_issues=on, issues=issues).columns
    assert catalog.list_contacts(store["contacts"]).columns == ["login", "hash"]


def test_issue_counts_include_zero(spark, store):
    got = catalog.list_repos(store["repositories"], include_issues="count", issues=store["issues"])
    assert {r.name: r.issues_count for r in got.collect()} == {"tides": 3, "charts": 0, "buoys": 2}


def test_search(store):
    names = lambda **o: sorted(r.name for r in catalog.search_repos(store["repositories"], **o).collect())
    assert names() == ["buoys", "charts", "tides"] and names(language="Ada") == ["buoys"] and names(language="ada") == []
    assert names(min_stars=5) == ["tides"] and names(language="Ada", min_stars=5) == []
    assert catalog.search_repos(store["repositories"]).columns == list(catalog.SEARCH_FIELDS)


@pytest.mark.parametrize(
    "page, limit, want",
    [(None, None, (0, 100)), ("2", "10", (10, 10)), ("0", None, (0, 100)), ("-5", "10", (0, 10)), ("x", "10", (0, 10)),
     ("3", "x", (0, 0)), (3, 7, (14, 7))],
)
def test_page_bounds(page, limit, want):
    assert catalog.page_bounds(page, limit) == want


def test_negative_limit_is_rejected():
    with pytest.raises(ValueError):
        catalog.page_bounds("1", "-1")


@pytest.mark.parametrize("top_rows", [-1, 1000])
def test_issue_pages_cover_all_issues_in_key_order(spark, top_rows):
    rows = [(f"a/b{'-c' * (i % 2)}", str(i)) for i in range(25)]
    issues = spark.createDataFrame(rows, "repo_id string, id string").repartition(5)
    seen = []
    for page in (1, 2, 3, 4):
        got = catalog.issue_page(issues, page, 10, top_rows=top_rows).collect()
        seen += sorted(r.key for r in got)
    assert seen == sorted(f"issue:{r}/{i}" for r, i in rows)


def test_tickets_of_one_repository(spark):
    rows = [("a/b", "9"), ("a/b", "10"), ("a/b-c", "1"), ("a/bb", "2")]
    tickets = spark.createDataFrame(rows, "repo_id string, id string")
    assert [r.id for r in catalog.repo_issues(tickets, "a/b").collect()] == ["10", "9"]
    assert [r.id for r in catalog.repo_pull_requests(tickets, "a/b").collect()] == ["10", "9"]


def test_counts_include_empty_tables(store):
    tables = {**store, "issues": store["issues"].limit(0)}
    want = {"contacts": 3, "issues": 0, "pull_requests": 0, "repositories": 3}
    assert {r.entity: r.n for r in catalog.table_counts(tables).collect()} == want
    summary = catalog.table_summary(tables)
    assert summary.columns == sorted(want) and summary.first().asDict() == want


def test_prefix_count(spark):
    keys = spark.createDataFrame([("issue:a",), ("issue:b",), ("issues",), ("pr:a",)], "key string")
    assert catalog.count_prefix(keys, "issue:").first().n == 2


def test_top_users(spark):
    users = spark.createDataFrame(
        [("b", 20, "C"), ("a", 20, "C"), ("c", 10, "C"), ("d", 99, "D"), ("e", 11, "C")], "login string, followers int, language string"
    )
    assert [r.login for r in catalog.top_users(users).collect()] == ["d", "a", "b", "e"]
    assert [r.login for r in catalog.top_users(users, language="C", n=2).collect()] == ["a", "b"]
