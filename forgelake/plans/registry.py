"""Named queries over the driver's tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelake.functions import text
from forgelake.functions.identity import (
    CONTACT_IDENTITY,
    CONTACT_PREFIX,
    ISSUE_PREFIX,
    PULL_REQUEST_PREFIX,
    REPO_IDENTITY,
    REPO_PREFIX,
    contact_key,
    fingerprint,
    issue_key,
    pull_request_key,
    repo_key,
    shown_hash,
)
from forgelake.operators import catalog, frontier, markov, upsert
from forgelake.operators.crawl import crawl
from forgelake.plans.bindings import HUB, Bound, with_views
from forgelake.session import materialize, scratch_path
from forgelake.sources import pages, responses
from forgelake.streaming.ingest import WriteLog, live_counts, newest_counts, upsert_stream
from forgelake.streaming.landing import stream_tickets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The time jobs stamp rows with, so that results repeat.
NOW = "2024-01-01 00:00:00"
TICKET = ("id", "repo_id", "title", "url", "state", "author", "created_at", "updated_at")


def query(sql: str):
    """Register a query over the bindings, and its SQL, under the function's name."""

    def register(build: Callable[[Bound], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Bound(spark, folder))
        ORACLES[name] = sql
        return build

    return register


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _local_times(df: DataFrame) -> DataFrame:
    """Timestamps as the driver's tables hold them, without a zone."""
    zoned = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


# Ingest ------------------------------------------------------------------------------------------

_ISSUES_SQL = f"SELECT {', '.join(TICKET)} FROM raw_issues WHERE pull_request IS NULL"


@query(f"{with_views('raw_issues')} {_ISSUES_SQL}")
def ingest_issues_not_prs(b: Bound) -> DataFrame:
    # Both states in one pass instead of a union of two.
    wanted = F.col("pull_request").isNull() & F.col("state").isin(*responses.STATES)
    return b.raw_issues().filter(wanted).select(*TICKET)


@query(f"{with_views('raw_issues')} {_ISSUES_SQL}")
def ingest_issues_json(b: Bound) -> DataFrame:
    return _local_times(responses.issues(b.landed_tickets("issues", b.raw_issues())).select(*TICKET))


@query(f"{with_views('raw_issues')} {_ISSUES_SQL.replace('IS NULL', 'IS NOT NULL')}")
def ingest_prs_json(b: Bound) -> DataFrame:
    pulls = b.raw_issues().filter(F.col("pull_request").isNotNull())
    return _local_times(responses.pull_requests(b.landed_tickets("pulls", pulls)).select(*TICKET))


@query(
    f"""{with_views('contact')} SELECT id, login, url, '' AS avatar, company, '' AS email, location, '' AS bio,
    TIMESTAMP '{NOW}' AS updated_at FROM contact"""
)
def ingest_profiles_json(b: Bound) -> DataFrame:
    return responses.user_profiles(b.landed_users(), now())


_REPO_SQL = "SELECT id, name, owner, url, description, stars, language, has_open_license, license FROM repo"
_REPO_FIELDS = ("id", "name", "owner", "url", "description", "stars", "language", "has_open_license", "license")


@query(f"{with_views('repo')} {_REPO_SQL}")
def ingest_repos_json(b: Bound) -> DataFrame:
    return responses.owned_repos(b.landed_repos()).select(*_REPO_FIELDS)


@query(
    f"""{with_views('repo')} {_REPO_SQL}"""
)
def ingest_starred_json(b: Bound) -> DataFrame:
    return responses.starred_repos(b.landed_repos("starred")).select(*_REPO_FIELDS)


@query(
    f"""{with_views('contact', 'repo', 'contributor')}
    SELECT r.id AS repo_id, c.id, c.login, c.url, '' AS avatar
    FROM contributor k JOIN repo r ON r.part_key = k.repo_pos JOIN contact c ON c.id = CAST(k.dst AS VARCHAR)"""
)
def ingest_contributors_json(b: Bound) -> DataFrame:
    return responses.contributors(b.landed_contributors()).select("repo_id", "id", "login", "url", "avatar")


@query("SELECT c_mktsegment AS language, c_name AS login FROM customer")
def search_logins_json(b: Bound) -> DataFrame:
    return responses.search_logins(b.landed_searches()).select("language", "login")


@query(
    f"""{with_views('raw_issues')} SELECT repo_id, state, COUNT(*) AS n FROM raw_issues WHERE pull_request IS NULL
    GROUP BY repo_id, state"""
)
def ingest_counts(b: Bound) -> DataFrame:
    return responses.ingest_counts(b.raw_issues().filter(F.col("pull_request").isNull()), ["repo_id", "state"])


@query(
    f"""{with_views('raw_issue_pages')}, cut AS (
      SELECT *, MIN(CASE WHEN n = 0 THEN page END) OVER (PARTITION BY endpoint) AS cut FROM raw_issue_pages)
    SELECT endpoint, page, n FROM cut WHERE cut IS NULL OR page < cut"""
)
def page_cut(b: Bound) -> DataFrame:
    return responses.cut_pages(b.raw_issue_pages(), ["endpoint"], F.col("n") == 0)


# Fingerprints and upserts ------------------------------------------------------------------------


@query(
    f"""{with_views('repo')} SELECT owner, name, sha256(owner || name || url) AS stored_hash,
    sha256(owner || '/' || name) AS fallback_hash FROM repo"""
)
def repo_fingerprint(b: Bound) -> DataFrame:
    return b.repo().select(
        "owner", "name", fingerprint(*REPO_IDENTITY).alias("stored_hash"), shown_hash("owner", "name").alias("fallback_hash")
    )


@query(
    f"""{with_views('contact_obs')}, x AS (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY login ORDER BY seq DESC) AS rn FROM contact_obs)
    SELECT login, url, company, sha256(login || url) AS hash, TIMESTAMP '{NOW}' AS updated_at FROM x WHERE rn = 1"""
)
def contact_upsert(b: Bound) -> DataFrame:
    state = upsert.upsert_contacts(b.contact_obs(), b.CONTACT_ARRIVAL, now=now())
    return state.select("login", "url", "company", "hash", "updated_at")


def _written_sql(view: str, keys: str, hashed: str) -> str:
    """Rows of an observation view that an upsert writes, with their change class."""
    return f"""{with_views(view)},
    h AS (SELECT *, sha256({hashed}) AS hash FROM {view}),
    f AS (SELECT *, LAG(hash) OVER (PARTITION BY {keys} ORDER BY seq) AS before FROM h),
    c AS (SELECT *, CASE WHEN before IS NULL THEN 'new' WHEN before <> hash THEN 'changed' ELSE 'unchanged' END AS change FROM f),
    w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY seq DESC) AS rn FROM c WHERE change <> 'unchanged')"""


_REPO_OBS = _written_sql("repo_obs", "owner, name", "owner || name || url")


@query(f"{_REPO_OBS} SELECT owner, name, url, stars, hash, TIMESTAMP '{NOW}' AS updated_at FROM w WHERE rn = 1")
def repo_upsert(b: Bound) -> DataFrame:
    state = upsert.upsert_repos(b.repo_obs(), b.ARRIVAL, now=now())
    return state.select("owner", "name", "url", "stars", "hash", "updated_at")


def _classified_repos(b: Bound) -> DataFrame:
    return upsert.classify(b.repo_obs(), upsert.REPO_KEY, b.ARRIVAL, REPO_IDENTITY)


@query(f"{_REPO_OBS} SELECT owner, name, url, stars, hash, change FROM w")
def upsert_written(b: Bound) -> DataFrame:
    return upsert.written(_classified_repos(b)).select("owner", "name", "url", "stars", "hash", "change")


@query(f"{_REPO_OBS} SELECT change, COUNT(*) AS n FROM c GROUP BY change")
def change_classes(b: Bound) -> DataFrame:
    return upsert.change_counts(_classified_repos(b))


def _ticket_upsert_sql(view: str) -> str:
    return f"""{_written_sql(view, "repo_id, id", "repo_id || id || url")}
    SELECT repo_id, id, url, hash, COALESCE(updated_at, TIMESTAMP '{NOW}') AS updated_at FROM w WHERE rn = 1"""


@query(_ticket_upsert_sql("issue_obs"))
def issue_upsert(b: Bound) -> DataFrame:
    state = upsert.upsert_issues(b.issue_obs(), b.ARRIVAL, now=now())
    return state.select("repo_id", "id", "url", "hash", "updated_at")


@query(_ticket_upsert_sql("pr_obs"))
def pr_upsert(b: Bound) -> DataFrame:
    state = upsert.upsert_pull_requests(b.pr_obs(), b.ARRIVAL, now=now())
    return state.select("repo_id", "id", "url", "hash", "updated_at")


def _halves(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The rows that arrived before the median of ``by``, and the others, those without a value too."""
    middle = rows.agg(F.percentile_approx(by, 0.5)).first()[0]
    early = F.coalesce(F.col(by) < middle, F.lit(False))
    return rows.filter(early), rows.filter(~early)


# The first half of the sightings is stored, the second half comes in: the same state as at once.


@query(ORACLES["contact_upsert"])
def contact_upsert_stored(b: Bound) -> DataFrame:
    first, second = _halves(b.contact_obs(), b.CONTACT_ARRIVAL[0])
    stored = materialize(upsert.upsert_contacts(first, b.CONTACT_ARRIVAL, now=now()), "stored-contacts")
    state = upsert.upsert_contacts(second, b.CONTACT_ARRIVAL, stored, now())
    return state.select("login", "url", "company", "hash", "updated_at")


@query(ORACLES["repo_upsert"])
def repo_upsert_stored(b: Bound) -> DataFrame:
    first, second = _halves(b.repo_obs(), b.ARRIVAL[0])
    stored = materialize(upsert.upsert_repos(first, b.ARRIVAL, now=now()), "stored-repos")
    state = upsert.upsert_repos(second, b.ARRIVAL, stored, now())
    return state.select("owner", "name", "url", "stars", "hash", "updated_at")


@query(
    f"""{_REPO_OBS} SELECT hash, owner, name, TIMESTAMP '{NOW}' AS updated_at, stars FROM w WHERE rn = 1"""
)
def repo_list_stored(b: Bound) -> DataFrame:
    """A listing of stored repositories shows their stored hash, not the fallback."""
    stored = materialize(upsert.upsert_repos(b.repo_obs(), b.ARRIVAL, now=now()), "stored-repos")
    shown = stored.withColumn("language", F.lit(""))
    listed = catalog.list_repos(shown, expand="true")
    return listed.select("hash", "owner", "name", "updated_at", "stars")


@query(ORACLES["issue_upsert"])
def issue_upsert_stored(b: Bound) -> DataFrame:
    first, second = _halves(b.issue_obs(), b.ARRIVAL[0])
    stored = materialize(upsert.upsert_issues(first, b.ARRIVAL, now=now()), "stored-issues")
    state = upsert.upsert_issues(second, b.ARRIVAL, stored, now())
    return state.select("repo_id", "id", "url", "hash", "updated_at")


@query(
    f"""{with_views('repo', 'ticket_keys')}, kept AS (SELECT part_key, id FROM repo WHERE language <> 'Brand#2')
    SELECT 'repositories' AS entity, id AS key FROM kept
    UNION ALL SELECT CASE WHEN t.is_pr THEN 'pull_requests' ELSE 'issues' END, k.id || '/' || CAST(t.number AS VARCHAR)
    FROM ticket_keys t JOIN kept k ON k.part_key = t.part_key"""
)
def repo_delete_cascade(b: Bound) -> DataFrame:
    repo = b.repo()
    doomed = repo.filter(F.col("language") == "Brand#2")
    left = upsert.delete_repos(doomed, repo, b.issue(), b.pr())
    keys = {"repositories": F.col("id"), "issues": F.concat_ws("/", "repo_id", "id"), "pull_requests": F.concat_ws("/", "repo_id", "id")}
    return reduce(
        DataFrame.unionByName, [left[name].select(F.lit(name).alias("entity"), key.alias("key")) for name, key in keys.items()]
    )


# Catalog reads -----------------------------------------------------------------------------------

_SUMMARY_SQL = "sha256(owner || '/' || name) AS hash, owner, name, language"


@query(f"{with_views('contact')} SELECT login, hash, company, location FROM contact WHERE login = 'Customer#000000042'")
def contact_by_login(b: Bound) -> DataFrame:
    return catalog.find_contact(b.contact(), "Customer#000000042").select("login", "hash", "company", "location")


@query(
    f"""{with_views('repo')} SELECT {_SUMMARY_SQL}, url FROM repo
    WHERE owner = 'Customer#000000042' AND name = 'part-42'"""
)
def repo_by_key(b: Bound) -> DataFrame:
    return catalog.find_repo(b.repo(), "Customer#000000042", "part-42")


@query(
    f"""{with_views('repo_obs')}, k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
    SELECT owner, name, url, stars FROM repo_obs WHERE (owner, name) IN (
      SELECT ('owner-' || CAST(l_orderkey AS VARCHAR), 'repo-' || CAST(l_linenumber AS VARCHAR)) FROM k)"""
)
def existing_keys(b: Bound) -> DataFrame:
    returned = b.repo_obs(b.table("lineitem").filter(F.col("l_returnflag") == "R"))
    return upsert.existing(b.repo_obs(), returned, upsert.REPO_KEY).select("owner", "name", "url", "stars")


@query(f"{with_views('repo')} SELECT {_SUMMARY_SQL}, url FROM repo")
def repo_list(b: Bound) -> DataFrame:
    return catalog.list_repos(b.repo())


@query(
    f"""{with_views('repo')} SELECT {_SUMMARY_SQL}, url, description, stars, license, has_open_license,
    CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS TIMESTAMP) AS "createdAt" FROM repo"""
)
def repo_list_expanded(b: Bound) -> DataFrame:
    return _local_times(catalog.list_repos(b.repo(), expand="full"))


@query(f"{with_views('contact')} SELECT login, hash FROM contact")
def contact_list(b: Bound) -> DataFrame:
    return catalog.list_contacts(b.contact())


@query(f"{with_views('repo')} SELECT {_SUMMARY_SQL} FROM repo WHERE language = 'Brand#17'")
def repo_search_language(b: Bound) -> DataFrame:
    return catalog.search_repos(b.repo(), language="Brand#17")


@query(f"{with_views('repo')} SELECT {_SUMMARY_SQL} FROM repo WHERE stars >= 910")
def repo_search_min_stars(b: Bound) -> DataFrame:
    return catalog.search_repos(b.repo(), min_stars=910)


_TICKETS = ", ".join(TICKET)


@query(f"{with_views('issue')} SELECT {_TICKETS} FROM issue WHERE repo_id = 'Customer#000000007/part-7'")
def repo_issues(b: Bound) -> DataFrame:
    return catalog.repo_issues(b.issue("Customer#000000007/part-7"), "Customer#000000007/part-7")


@query(f"{with_views('pr')} SELECT {_TICKETS} FROM pr WHERE repo_id = 'Customer#000000007/part-7'")
def repo_prs(b: Bound) -> DataFrame:
    return catalog.repo_pull_requests(b.pr("Customer#000000007/part-7"), "Customer#000000007/part-7")


@query(
    f"""{with_views('repo', 'ticket_keys')}, k AS (SELECT part_key, COUNT(*) AS n FROM ticket_keys WHERE NOT is_pr GROUP BY part_key)
    SELECT {_SUMMARY_SQL}, url, CAST(COALESCE(k.n, 0) AS BIGINT) AS issues_count FROM repo LEFT JOIN k ON k.part_key = repo.part_key"""
)
def repos_with_issue_counts(b: Bound) -> DataFrame:
    return catalog.list_repos(b.repo(), include_issues="count", issues=b.issue())


def _tables(b: Bound) -> dict[str, DataFrame]:
    return {"contacts": b.contact(), "repositories": b.repo()}


# Issues and pull requests come out of one scan of the lines.
_TICKET_TABLES = ("issues", "pull_requests")


@query(
    f"""{with_views('contact', 'repo', 'ticket_keys')} SELECT 'contacts' AS entity, COUNT(*) AS n FROM contact
    UNION ALL SELECT 'repositories', COUNT(*) FROM repo
    UNION ALL SELECT 'issues', COUNT(*) FROM ticket_keys WHERE NOT is_pr
    UNION ALL SELECT 'pull_requests', COUNT(*) FROM ticket_keys WHERE is_pr"""
)
def table_counts(b: Bound) -> DataFrame:
    return catalog.table_counts(_tables(b), b.ticket_kinds(), _TICKET_TABLES)


@query(
    f"""{with_views('contact', 'repo', 'ticket_keys')} SELECT (SELECT COUNT(*) FROM contact) AS contacts,
    (SELECT COUNT(*) FROM ticket_keys WHERE NOT is_pr) AS issues,
    (SELECT COUNT(*) FROM ticket_keys WHERE is_pr) AS pull_requests, (SELECT COUNT(*) FROM repo) AS repositories"""
)
def table_summary(b: Bound) -> DataFrame:
    return catalog.table_summary(_tables(b), b.ticket_kinds(), _TICKET_TABLES)


@query(f"{with_views('issue')} SELECT COUNT(*) AS n FROM issue")
def count_by_prefix(b: Bound) -> DataFrame:
    keyed = {
        CONTACT_PREFIX: (b.contact(), contact_key()),
        REPO_PREFIX: (b.repo(), repo_key()),
        ISSUE_PREFIX: (b.issue(), issue_key()),
        PULL_REQUEST_PREFIX: (b.pr(), pull_request_key()),
    }
    return catalog.count_keys(keyed, ISSUE_PREFIX)


@query(
    f"""{with_views('issue')} SELECT {_TICKETS}, 'issue:' || repo_id || '/' || id AS key FROM issue
    ORDER BY key LIMIT 100 OFFSET 200"""
)
def issue_page(b: Bound) -> DataFrame:
    return catalog.issue_page(b.issue(), 3, 100)


@query(
    f"""{with_views('contributor')} SELECT dst AS login, COUNT(DISTINCT src) AS followers FROM contributor
    GROUP BY dst HAVING COUNT(DISTINCT src) > 10 ORDER BY followers DESC, login LIMIT 30"""
)
def top_contributors(b: Bound) -> DataFrame:
    # Distinct pairs first, then a plain count: both combine before their shuffle.
    pairs = b.contributor().select("src", "dst").distinct()
    return catalog.top_users(pairs.groupBy(F.col("dst").alias("login")).agg(F.count("*").alias("followers")))


# Pages -------------------------------------------------------------------------------------------

# Where the driver's pages keep their links.
_PAGE_SELECTORS = (
    pages.Selector(blocks=(pages.Element("nav"), pages.Element("li"))),
    pages.Selector(blocks=(pages.Element("ul"),)),
)
_NOISE_SQL = "regexp_replace(html, '<!--.*?-->|<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', ' ', 'gis')"
_LINKS_SQL = f"""
    clean AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS org, page_id AS page, {_NOISE_SQL} AS h FROM pages),
    navs AS (SELECT org, page, UNNEST(regexp_extract_all(h, '<nav\\b[^>]*>(.*?)</nav>', 1, 'is')) AS block FROM clean),
    hrefs AS (SELECT org, page, regexp_extract_all(block, '<a\\b[^>]*\\shref="([^"]*)"', 1, 'is') AS l FROM navs),
    links AS (SELECT org, page, UNNEST(range(len(l))) AS pos, UNNEST(l) AS href FROM hrefs)"""


def _page_rows(b: Bound) -> DataFrame:
    return b.table("pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("org"), F.col("page_id").alias("page"), "html"
    )


def _organisation_links(b: Bound) -> DataFrame:
    return pages.organisation_repos(
        _page_rows(b), base_url=HUB, selectors=_PAGE_SELECTORS, id_parts=(1,), now=now()
    )


_ORG_SQL = f"""WITH {_LINKS_SQL}, firsts AS (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY org, split_part(href, '/', 2) ORDER BY page, pos) AS rn
      FROM links WHERE starts_with(href, '/'))"""


@query(
    f"""{_ORG_SQL} SELECT org, split_part(href, '/', 2) AS id, 'https://hub.example' || href AS url, page,
    1 AS selector_rank, CAST(pos AS INTEGER) AS pos FROM firsts WHERE rn = 1"""
)
def org_links(b: Bound) -> DataFrame:
    return _organisation_links(b).select("org", "id", "url", "page", "selector_rank", "pos")


@query(
    f"""{_ORG_SQL}, orgs AS (SELECT org, MIN(page) AS org_pos FROM clean GROUP BY org)
    SELECT org, split_part(href, '/', 2) AS id, page, CAST(pos AS INTEGER) AS pos FROM firsts JOIN orgs USING (org)
    WHERE rn = 1 ORDER BY org_pos, page, pos LIMIT 150"""
)
def org_sweep_budget(b: Bound) -> DataFrame:
    orgs = _page_rows(b).groupBy("org").agg(F.min("page").alias("org_pos"))
    return pages.organisation_sweep(_organisation_links(b), orgs, 150).select("org", "id", "page", "pos")


@query(
    f"""WITH {_LINKS_SQL}, logins AS (SELECT substr(href, 2) AS login, page, pos FROM links WHERE starts_with(href, '/')),
    firsts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY login ORDER BY page, pos) AS rn FROM logins WHERE login <> '')
    SELECT login, page, CAST(pos AS INTEGER) AS pos FROM firsts WHERE rn = 1"""
)
def trending_links(b: Bound) -> DataFrame:
    found = pages.trending_logins(b.table("pages"), selectors=_PAGE_SELECTORS[:1], page="page_id")
    return found.select("login", F.col("page_id").alias("page"), "pos")


def _text_sql(column: str) -> str:
    out = f"regexp_replace({column}, '<[^>]*>', '', 'g')"
    for name, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"),
        ("&copy;", "©"), ("&amp;", "&"),
    ):
        out = f"replace({out}, '{name}', '{char}')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query(
    f"""WITH a AS (SELECT page_id, regexp_extract({_NOISE_SQL}, '<article\\b[^>]*>(.*?)</article>', 1, 'is') AS t FROM pages)
    SELECT page_id, {_text_sql("regexp_extract(t, '<h1\\b[^>]*>(.*?)</h1>', 1, 'is')")} AS title,
    {_text_sql("regexp_extract(t, '<p\\b[^>]*>(.*?)(?:</p>|<p\\b|</article>|$)', 1, 'is')")} AS description FROM a"""
)
def page_cards(b: Bound) -> DataFrame:
    return pages.first_elements(b.table("pages"), ["page_id"], scope="article", names={"title": "h1", "description": "p"})


@query(
    f"""{with_views('repo')} SELECT owner AS login, id, owner, name, url, description, language, CAST(0 AS BIGINT) AS stars
    FROM repo"""
)
def profile_page_repos(b: Bound) -> DataFrame:
    cards = pages.profile_cards(b.profile_pages(), ["login", "page"], base_url=HUB)
    return cards.select("login", "id", "owner", "name", "url", "description", "language", "stars")


@query(ORACLES["profile_page_repos"])
def nested_card_repos(b: Bound) -> DataFrame:
    """Cards that hold another article, or stand in one: the closest article describes a link."""
    cards = pages.profile_cards(b.nested_profile_pages(), ["login", "page"], base_url=HUB)
    return cards.select("login", "id", "owner", "name", "url", "description", "language", "stars")


@query(
    f"""{with_views('repo')} SELECT owner AS org, id, owner, name, CAST(part_key % 3 + 1 AS INTEGER) AS selector_rank,
    url || CASE part_key % 3 WHEN 0 THEN '' WHEN 1 THEN '/tree' ELSE '/stars' END AS url FROM repo"""
)
def listing_selector_repos(b: Bound) -> DataFrame:
    """Each repository is linked in one of the three ways only."""
    found = pages.organisation_repos(b.mixed_listing_pages(), base_url=HUB, now=now())
    return found.select("org", "id", "owner", "name", "selector_rank", "url")


@query(
    """SELECT c_name AS login, c_nationkey AS page FROM customer"""
)
def trending_articles(b: Bound) -> DataFrame:
    """Users linked from the headings of articles, among links that do not count."""
    return pages.trending_logins(b.trending_pages()).select("login", "page")


@query(f"{with_views('repo')} SELECT owner AS org, id, owner, name, url, 1 AS selector_rank FROM repo")
def listing_page_repos(b: Bound) -> DataFrame:
    found = pages.organisation_repos(b.listing_pages(), base_url=HUB, now=now())
    return found.select("org", "id", "owner", "name", "url", "selector_rank")


@query(
    f"""{with_views('repo')} SELECT owner AS from_state, id AS to_state FROM repo
    JOIN customer ON c_name = owner ORDER BY c_custkey, part_key LIMIT 500"""
)
def one_hop_budget(b: Bound) -> DataFrame:
    cards = pages.profile_cards(b.profile_pages(), ["login", "page"], base_url=HUB)
    cards = cards.withColumn("pos", F.struct("page", "pos"))
    users = b.table("customer").select(F.col("c_name").alias("login"), F.col("c_custkey").alias("place"))
    return frontier.crawl_transitions(frontier.one_hop(users, cards, 500)).select("from_state", "to_state")


@query(
    """SELECT p_partkey, CAST(p_size * POW(10, length(CAST(p_partkey AS VARCHAR))) + p_partkey AS BIGINT) AS grouped,
    CASE WHEN regexp_matches(CAST(p_size AS VARCHAR), '^[0-9]+$') THEN CAST(p_size AS BIGINT) ELSE 0 END AS signed,
    CAST(0 AS BIGINT) AS word, CAST(0 AS BIGINT) AS fraction FROM part"""
)
def parse_stars(b: Bound) -> DataFrame:
    size, number = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    return b.table("part").select(
        "p_partkey",
        text.parse_stars(F.concat(F.lit(" "), size, F.lit(","), number, F.lit(" "))).alias("grouped"),
        text.parse_stars(F.concat(F.lit("+"), size)).alias("signed"),
        text.parse_stars("p_name").alias("word"),
        text.parse_stars(F.concat(size, F.lit(".5"))).alias("fraction"),
    )


# Graph -------------------------------------------------------------------------------------------

VISITS = 100


def _reach_sql(levels: int) -> str:
    """Users by the level they are first met on. There are fewer levels than that."""
    parts = ["r0 AS (SELECT seed_id, login, 0 AS depth FROM seeds)"]
    for i in range(1, levels + 1):
        parts.append(
            f"""n{i} AS MATERIALIZED (SELECT DISTINCT v.seed_id, e.dst AS login FROM r{i - 1} v JOIN contributor e ON e.src = v.login
                WHERE v.depth = {i - 1}),
            r{i} AS MATERIALIZED (SELECT * FROM r{i - 1} UNION ALL SELECT n.seed_id, n.login, {i} FROM n{i} n
              WHERE NOT EXISTS (SELECT 1 FROM r{i - 1} s WHERE s.seed_id = n.seed_id AND s.login = n.login))"""
        )
    return ",\n".join(parts)


@query(f"{with_views('contributor', 'seeds')},\n{_reach_sql(8)} SELECT seed_id, login, depth FROM r8")
def bfs_reach(b: Bound) -> DataFrame:
    return frontier.reach(b.contributor(), b.seeds())


def _levels_sql(count: int) -> str:
    """The first levels of the expansion in visit order. The budget is spent within them."""
    parts = ["v0 AS (SELECT seed_id, login, 0 AS depth, CAST(1 AS BIGINT) AS visit_rank FROM seeds)"]
    for i in range(1, count + 1):
        parts.append(
            f"""m{i} AS (SELECT v.seed_id, e.dst AS login, v.visit_rank AS via, e.repo_pos, e.contrib_pos,
                ROW_NUMBER() OVER (PARTITION BY v.seed_id, e.dst ORDER BY v.visit_rank, e.repo_pos, e.contrib_pos) AS rn
              FROM v{i - 1} v JOIN contributor e ON e.src = v.login WHERE v.depth = {i - 1}
                AND NOT EXISTS (SELECT 1 FROM v{i - 1} s WHERE s.seed_id = v.seed_id AND s.login = e.dst)),
            v{i} AS (SELECT * FROM v{i - 1} UNION ALL
              SELECT m.seed_id, login, {i}, n + ROW_NUMBER() OVER (PARTITION BY m.seed_id ORDER BY via, repo_pos, contrib_pos)
              FROM m{i} m JOIN (SELECT seed_id, COUNT(*) AS n FROM v{i - 1} GROUP BY seed_id) k ON k.seed_id = m.seed_id
              WHERE rn = 1)"""
        )
    return ",\n".join(parts)


_BUDGET_SQL = f"{with_views('contributor', 'seeds')},\n{_levels_sql(3)}, visits AS (SELECT * FROM v3 WHERE visit_rank <= {VISITS})"


def _budget_visits(b: Bound) -> DataFrame:
    return frontier.expand(b.contributor(), b.seeds(), max_visits=VISITS)


@query(f"{_BUDGET_SQL} SELECT seed_id, login, depth, visit_rank FROM visits")
def bfs_budget(b: Bound) -> DataFrame:
    return _budget_visits(b)


@query(
    f"""{with_views('contributor', 'seeds', 'contact', 'repo', 'ticket_keys', recursive=True)},
    reach AS (SELECT seed_id, login FROM seeds UNION
              SELECT r.seed_id, e.dst FROM reach r JOIN contributor e ON e.src = r.login),
    logins AS (SELECT DISTINCT c.login FROM reach v JOIN contact c ON c.id = CAST(v.login AS VARCHAR)),
    owned AS (SELECT r.part_key, r.id FROM repo r JOIN logins l ON l.login = r.owner)
    SELECT 'contacts' AS entity, login AS key FROM logins
    UNION ALL SELECT 'repositories', id FROM owned
    UNION ALL SELECT CASE WHEN t.is_pr THEN 'pull_requests' ELSE 'issues' END, o.id || '/' || CAST(t.number AS VARCHAR)
    FROM ticket_keys t JOIN owned o ON o.part_key = t.part_key"""
)
def bfs_entities(b: Bound) -> DataFrame:
    """All that belongs to the users an expansion without a budget visits, of all four tables."""
    users = b.contact().select(F.col("id").cast("bigint").alias("_id"), F.col("login").alias("name"))
    reached = frontier.reach(b.contributor(), b.seeds()).select(F.col("login").alias("_id")).distinct()
    visits = reached.join(users, "_id").select(F.col("name").alias("login"))
    found = frontier.visited_content(
        visits,
        {"contacts": (b.contact(), "login"), "repositories": (b.repo(), "owner")},
        {"issues": b.issue(), "pull_requests": b.pr()},
    )
    ticket = F.concat_ws("/", "repo_id", "id")
    keys = {"contacts": F.col("login"), "repositories": F.col("id"), "issues": ticket, "pull_requests": ticket}
    return reduce(DataFrame.unionByName, [found[n].select(F.lit(n).alias("entity"), k.alias("key")) for n, k in keys.items()])


def _landing(b: Bound) -> DataFrame:
    """All endpoints in one landing table."""
    # Both endpoints of tickets read them; written once, their lines meet orders and parts once.
    tickets = materialize(b.raw_issues(), "tickets")
    pulls = tickets.filter(F.col("pull_request").isNotNull())
    landed = [
        b.landed_users(), b.landed_repos(), b.landed_contributors(), b.landed_tickets("issues", tickets), b.landed_tickets("pulls", pulls)
    ]
    return reduce(DataFrame.unionByName, landed)


# One crawl from the first user: level by level to the end, then what each visit saves.
@query(
    f"""{with_views('contributor', 'contact', 'repo', 'ticket_keys')},
    seeds AS (SELECT 0 AS seed_id, MIN(c_custkey) AS login FROM customer),
    {_levels_sql(8)}, visits AS (SELECT CAST(login AS VARCHAR) AS id, visit_rank FROM v8),
    seen AS (SELECT CAST(e.dst AS VARCHAR) AS id, MAX(v.visit_rank) AS last_seen
             FROM contributor e JOIN visits v ON v.id = CAST(e.src AS VARCHAR) GROUP BY e.dst),
    saved AS (SELECT COALESCE(v.id, s.id) AS id, v.visit_rank, s.last_seen FROM visits v FULL JOIN seen s ON s.id = v.id),
    owned AS (SELECT r.* FROM repo r JOIN contact c ON c.login = r.owner JOIN visits v ON v.id = c.id)
    SELECT 'contacts' AS entity, c.login AS key, c.hash,
      CASE WHEN s.visit_rank IS NOT NULL AND (s.last_seen IS NULL OR s.visit_rank > s.last_seen) THEN c.company ELSE '' END AS detail
    FROM saved s JOIN contact c ON c.id = s.id
    UNION ALL SELECT 'repositories', id, sha256(owner || name || url), CAST(stars AS VARCHAR) FROM owned
    UNION ALL SELECT CASE WHEN t.is_pr THEN 'pull_requests' ELSE 'issues' END, o.id || '/' || CAST(t.number AS VARCHAR),
      sha256(o.id || CAST(t.number AS VARCHAR) || o.url || '/issues/' || CAST(t.number AS VARCHAR)), o.description
    FROM ticket_keys t JOIN owned o ON o.part_key = t.part_key"""
)
def crawl_tables(b: Bound) -> DataFrame:
    """Landed responses of all endpoints to the four stored tables, in the order of the visits."""
    start = b.table("customer").select(F.min_by("c_name", "c_custkey").alias("login")).withColumn("seed_id", F.lit(0))
    tables = crawl(_landing(b), start, now=F.lit(NOW).cast("timestamp"))
    ticket = F.concat_ws("/", "repo_id", "id")
    shown = {
        "contacts": (F.col("login"), F.col("company")),
        "repositories": (F.col("id"), F.col("stars").cast("string")),
        "issues": (ticket, F.col("title")),
        "pull_requests": (ticket, F.col("title")),
    }
    rows = [
        tables[name].select(F.lit(name).alias("entity"), key.alias("key"), "hash", detail.alias("detail"))
        for name, (key, detail) in shown.items()
    ]
    return reduce(DataFrame.unionByName, rows)


# Chain -------------------------------------------------------------------------------------------


@query(f"{with_views('transition')} SELECT seq, from_state, to_state FROM transition")
def markov_transitions(b: Bound) -> DataFrame:
    return b.transition()


@query(
    f"""{with_views('transition')}, p AS (SELECT from_state, to_state, COUNT(*) AS n FROM transition GROUP BY ALL)
    SELECT from_state, to_state, n, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY from_state) AS weight FROM p"""
)
def markov_weights(b: Bound) -> DataFrame:
    return markov.weights(b.transition())


@query(
    f"""{with_views('transition')} SELECT COUNT(DISTINCT from_state) AS state_count, COUNT(*) AS transition_count
    FROM transition"""
)
def markov_counts(b: Bound) -> DataFrame:
    return markov.chain_counts(b.transition())


@query(
    f"""{with_views('transition')},
    i AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY from_state ORDER BY seq) - 1) // 1000 AS part FROM transition)
    SELECT from_state, CAST(part AS BIGINT) AS part, string_agg(to_state, ',' ORDER BY seq) AS targets
    FROM i GROUP BY from_state, part"""
)
def markov_lists(b: Bound) -> DataFrame:
    lists = markov.target_lists(b.transition())
    return lists.select("from_state", "part", F.array_join("targets", ",").alias("targets"))


@query(f"{with_views('transition')} SELECT seq, to_state FROM transition WHERE from_state = 'click'")
def markov_state(b: Bound) -> DataFrame:
    return markov.state_targets(b.transition(), "click")


@query(
    f"""{with_views('transition')}, i AS (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY from_state, to_state ORDER BY seq) AS rn FROM transition)
    SELECT seq, from_state, to_state FROM i WHERE NOT (rn = 1 AND from_state <> to_state)"""
)
def markov_remove(b: Bound) -> DataFrame:
    chain = b.transition()
    removals = chain.filter(F.col("from_state") != F.col("to_state")).select("from_state", "to_state")
    return markov.remove_first(chain, removals)


STEPS, SEED = 4, 7


def _walk_sql() -> str:
    parts = [
        f"""{with_views('transition')}, p AS (SELECT from_state, to_state, COUNT(*) AS n FROM transition GROUP BY ALL),
        r AS (SELECT *, SUM(n) OVER w - n AS lo, SUM(n) OVER w AS hi, SUM(n) OVER (PARTITION BY from_state) AS total
              FROM p WINDOW w AS (PARTITION BY from_state ORDER BY to_state ROWS UNBOUNDED PRECEDING)),
        s0 AS (SELECT event_id AS walker, 0 AS step, event_type AS state FROM events)"""
    ]
    for i in range(1, STEPS + 1):
        number = f"('0x' || substr(sha256('{SEED}|' || CAST(walker AS VARCHAR) || '|{i}'), 1, 15))::BIGINT"
        parts.append(
            f"""d{i} AS (SELECT s.walker, s.state, {number} % t.total AS draw FROM s{i - 1} s
                  LEFT JOIN (SELECT DISTINCT from_state, total FROM r) t ON t.from_state = s.state),
            s{i} AS (SELECT d.walker, {i} AS step, r.to_state AS state FROM d{i} d
                  LEFT JOIN r ON r.from_state = d.state AND d.draw >= r.lo AND d.draw < r.hi)"""
        )
    union = " UNION ALL ".join(f"SELECT walker, step, state FROM s{i}" for i in range(STEPS + 1))
    return ",\n".join(parts) + f" {union}"


def _walkers(b: Bound) -> DataFrame:
    """Each event starts a walker in its own state."""
    return b.table("events").select(F.col("event_id").alias("walker"), F.col("event_type").alias("state"))


@query(_walk_sql())
def markov_walk(b: Bound) -> DataFrame:
    return markov.walk(b.transition(), _walkers(b), STEPS, SEED)


# Streams -----------------------------------------------------------------------------------------

# Files the landed pages of a stream come in, half of them at a time.
LANDED_FILES = 8


def _stream(b: Bound, name: str) -> DataFrame:
    """A driver table as a stream of files."""
    reader = b.spark.readStream.schema(b.table(name).schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(b.folder)


@query(ORACLES["repo_upsert"])
def stream_upsert(b: Bound) -> DataFrame:
    """The first half of the lines lands and is taken up, then the rest: two runs, one checkpoint."""
    lines = b.table("lineitem")
    landing, root = scratch_path(b.spark, "landing"), scratch_path(b.spark, "stream")
    schema = b.repo_obs().schema.add("hash", "string").add("updated_at", "timestamp_ntz")
    log = WriteLog(b.spark, f"{root}/table", schema, upsert.REPO_KEY, b.ARRIVAL)
    middle = lines.agg(F.percentile_approx("l_shipdate", 0.5)).first()[0]
    half = F.coalesce(F.col("l_shipdate") < middle, F.lit(False))
    for part in (lines.filter(half), lines.filter(~half)):
        part.write.option("compression", "zstd").mode("append").parquet(landing)
        source = b.repo_obs(b.spark.readStream.schema(lines.schema).parquet(landing))
        upsert_stream(source, log, f"{root}/checkpoint", REPO_IDENTITY, stamp=now).awaitTermination()
    return log.state().select("owner", "name", "url", "stars", "hash", "updated_at")


@query(ORACLES["contact_upsert"])
def stream_contacts(b: Bound) -> DataFrame:
    """Sightings of contacts in two runs: the last one wins, even a sparser one."""
    sightings = b.contact_obs()
    landing, root = scratch_path(b.spark, "landing"), scratch_path(b.spark, "stream")
    schema = sightings.schema.add("hash", "string").add("updated_at", "timestamp_ntz")
    log = WriteLog(b.spark, f"{root}/table", schema, ["login"], b.CONTACT_ARRIVAL)
    first = F.col(b.CONTACT_ARRIVAL[0])
    middle = sightings.agg(F.percentile_approx(first, 0.5)).first()[0]
    half = F.coalesce(first < middle, F.lit(False))
    for part in (sightings.filter(half), sightings.filter(~half)):
        part.write.mode("append").parquet(landing)
        source = b.spark.readStream.schema(sightings.schema).parquet(landing)
        upsert_stream(source, log, f"{root}/checkpoint", CONTACT_IDENTITY, stamp=now, last_wins=True).awaitTermination()
    return log.state().select("login", "url", "company", "hash", "updated_at")


@query(ORACLES["ingest_issues_json"])
def stream_landed_issues(b: Bound) -> DataFrame:
    """Pages land in no order, in files that come in one after another."""
    folder, root = scratch_path(b.spark, "landing"), scratch_path(b.spark, "stream")
    landed = b.with_ends(b.landed_tickets("issues", b.raw_issues()), responses.STATES)
    landed.repartition(LANDED_FILES, F.xxhash64(F.map_values("params"), "page")).write.parquet(folder)
    source = b.spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", LANDED_FILES // 2).parquet(folder)
    found = stream_tickets(source, "issues").select(*TICKET)
    sink = found.writeStream.format("parquet").option("compression", "zstd").option("path", f"{root}/issues").option("checkpointLocation", f"{root}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return _local_times(b.spark.read.schema(found.schema).parquet(f"{root}/issues"))


@query(
    """SELECT 'repositories' AS entity, COUNT(*) AS n FROM part UNION ALL SELECT 'contacts', COUNT(*) FROM customer
    UNION ALL SELECT 'issues', COUNT(*) FROM lineitem WHERE l_returnflag <> 'R'
    UNION ALL SELECT 'pull_requests', COUNT(*) FROM lineitem WHERE l_returnflag = 'R'"""
)
def stream_counts(b: Bound) -> DataFrame:
    lines = _stream(b, "lineitem")
    counts = live_counts(
        {
            "repositories": _stream(b, "part"),
            "contacts": _stream(b, "customer"),
            "issues": lines.filter(F.col("l_returnflag") != "R"),
            "pull_requests": lines.filter(F.col("l_returnflag") == "R"),
        }
    )
    root = scratch_path(b.spark, "counts")

    def save(batch: DataFrame, batch_id: int) -> None:
        # A folder per batch: readers of an earlier one are not disturbed.
        batch.write.mode("overwrite").parquet(f"{root}/counts/batch_id={batch_id}")

    sink = counts.writeStream.outputMode("complete").foreachBatch(save)
    sink.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return newest_counts(b.spark, f"{root}/counts", ["repositories", "contacts", "issues", "pull_requests"])

