"""The driver's tables in the shape of repositories, users, issues and events.

Customers are users and contacts, parts are repositories owned by a customer, the lines of an order
are issues its customer opened (or pull requests), and who ordered a part contributes to it. Every
binding covers its whole tables. ``VIEWS`` holds the same definitions in SQL for the comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelake.functions.identity import CONTACT_IDENTITY, with_fingerprint
from forgelake.operators.markov import transitions
from forgelake.operators.ordering import with_index
from forgelake.session import configure, materialize

HUB = "https://hub.example"
PER_PAGE = 100
CARDS_PER_PAGE = 30


class Bound:
    """Bindings over the parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Stored entities -----------------------------------------------------------------------

    def contact(self) -> DataFrame:
        region = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        nation = self.table("nation").join(region, "n_regionkey")
        rows = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return with_fingerprint(
            rows.select(
                F.col("c_custkey").cast("string").alias("id"),
                F.col("c_name").alias("login"),
                _url("c_name").alias("url"),
                F.col("n_name").alias("company"),
                F.col("r_name").alias("location"),
            ),
            CONTACT_IDENTITY,
        )

    def _owner_key(self, part: str) -> Column:
        return F.col(part) % self.table("customer").agg(F.count("*")).scalar()

    def repo(self) -> DataFrame:
        part = self.table("part").withColumn("owner_key", self._owner_key("p_partkey"))
        owner = self.table("customer").select(F.col("c_custkey").alias("owner_key"), F.col("c_name").alias("owner"))
        name = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
        return part.join(owner, "owner_key").select(
            F.col("p_partkey").alias("part_key"),
            F.concat_ws("/", "owner", name).alias("id"),
            name.alias("name"),
            "owner",
            _url("owner", name).alias("url"),
            F.col("p_name").alias("description"),
            F.floor("p_retailprice").alias("stars"),
            F.col("p_brand").alias("language"),
            F.col("p_type").alias("license"),
            F.lit(False).alias("has_open_license"),
        )

    def _lines(self, lines: DataFrame | None = None) -> DataFrame:
        """Order lines marked as issue or pull request; repositories of size 1 take only the latter."""
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
        lines = (self.table("lineitem") if lines is None else lines).join(part, "l_partkey")
        return lines.withColumn("is_pr", (F.col("l_returnflag") == "R") | (F.col("p_size") == 1))

    def _with_repo(self, lines: DataFrame) -> DataFrame:
        repo = self.repo().select(F.col("part_key").alias("l_partkey"), F.col("id").alias("repo_id"), "url", "description")
        return lines.join(repo, "l_partkey")

    def _with_author(self, lines: DataFrame) -> DataFrame:
        """Lines with the customer and date of their order: joined while the lines are narrow, after orders met customers."""
        customer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"))
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
        return lines.join(orders.join(customer, "o_custkey").drop("o_custkey"), "l_orderkey")

    def _ticket(self, lines: DataFrame, *more: str) -> DataFrame:
        """Tickets of lines that have their author and repository."""
        number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
        return lines.select(
            number.alias("id"),
            "repo_id",
            F.col("description").alias("title"),
            F.concat("url", F.lit("/issues/"), number).alias("url"),
            F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("state"),
            "author",
            F.col("o_orderdate").alias("created_at"),
            F.col("l_shipdate").alias("updated_at"),
            *more,
        )

    def raw_issues(self) -> DataFrame:
        """Issue listing rows with the pull requests mixed in."""
        # Narrow lines go by order first, then by part, where they get their kind and their repository.
        lines = self._with_author(self.table("lineitem"))
        lines = self._with_repo(self._lines(lines)).withColumn("pull_request", F.when(F.col("is_pr"), F.col("url")))
        return self._ticket(lines, "pull_request", F.col("l_suppkey").alias("tie"))

    def _stored(self, pulls: bool, repo_id: str | None) -> DataFrame:
        # One line per key is chosen on narrow columns, before the wide ones are joined.
        lines = self._lines().filter(F.col("is_pr") == pulls)
        if repo_id is not None:
            # The lines of one repository are found before anything is grouped; its id is one row.
            wanted = self.repo().filter(F.col("id") == repo_id).select(F.col("part_key").alias("l_partkey"))
            lines = lines.join(F.broadcast(wanted), "l_partkey", "left_semi")
        keys = ["l_partkey", "l_orderkey", "l_linenumber"]
        first = lines.groupBy(*keys).agg(F.min(F.struct("l_suppkey", "l_shipdate", "l_linestatus")).alias("f"))
        return self._ticket(self._with_repo(self._with_author(first.select(*keys, "f.*"))))

    def ticket_kinds(self) -> DataFrame:
        """The entity of each stored issue and pull request: narrow columns of one scan, one exchange."""
        keys = ["l_partkey", "l_orderkey", "l_linenumber"]
        return self._lines().select(*keys, "is_pr").distinct().select(
            F.when(F.col("is_pr"), "pull_requests").otherwise("issues").alias("entity")
        )

    def issue(self, repo_id: str | None = None) -> DataFrame:
        """Stored issues, of all repositories or of one."""
        return self._stored(False, repo_id)

    def pr(self, repo_id: str | None = None) -> DataFrame:
        return self._stored(True, repo_id)

    # Sightings in order of arrival -----------------------------------------------------------

    ARRIVAL = ("l_shipdate", "l_partkey", "l_suppkey")

    def repo_obs(self, lines: DataFrame | None = None) -> DataFrame:
        rows = self.table("lineitem") if lines is None else lines
        return rows.select(
            _join("owner-", "l_orderkey").alias("owner"),
            _join("repo-", "l_linenumber").alias("name"),
            _url("l_linestatus").alias("url"),
            F.col("l_quantity").cast("bigint").alias("stars"),
            *self.ARRIVAL,
        )

    def _ticket_obs(self, rows: DataFrame) -> DataFrame:
        return rows.select(
            _join("owner/repo-", "l_orderkey").alias("repo_id"),
            F.col("l_linenumber").cast("string").alias("id"),
            _url("l_linestatus").alias("url"),
            F.when(F.col("l_quantity") >= 25, F.col("l_shipdate")).alias("updated_at"),
            *self.ARRIVAL,
        )

    def issue_obs(self) -> DataFrame:
        return self._ticket_obs(self.table("lineitem").filter(F.col("l_returnflag") != "R"))

    def pr_obs(self) -> DataFrame:
        return self._ticket_obs(self.table("lineitem").filter(F.col("l_returnflag") == "R"))

    CONTACT_ARRIVAL = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    def contact_obs(self) -> DataFrame:
        """Full and sparse sightings of a login."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        customer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("login"))
        return self.table("lineitem").join(orders, "l_orderkey").join(customer, "o_custkey").select(
            "login",
            _url("login").alias("url"),
            F.when(F.col("l_returnflag") == "N", F.concat(F.lit("Company "), "l_linestatus")).otherwise("").alias("company"),
            *self.CONTACT_ARRIVAL,
        )

    def raw_issue_pages(self) -> DataFrame:
        returned = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
        return self.table("lineitem").groupBy(
            F.col("l_partkey").alias("endpoint"), F.col("l_linenumber").alias("page")
        ).agg(returned.alias("n"))

    # Graph and chain -------------------------------------------------------------------------

    def contributor(self) -> DataFrame:
        """Edges owner -> contributor of each repository."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("dst"))
        rows = self.table("lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey")
        found = rows.groupBy("l_partkey", "dst").agg(F.min("l_orderkey").alias("contrib_pos"))
        return found.select(
            self._owner_key("l_partkey").alias("src"), "dst", F.col("l_partkey").alias("repo_pos"), "contrib_pos"
        )

    def seeds(self) -> DataFrame:
        """One start user per nation."""
        return self.table("customer").groupBy(F.col("c_nationkey").alias("seed_id")).agg(
            F.min("c_custkey").alias("login")
        )

    def transition(self) -> DataFrame:
        return transitions(self.table("events"), "user_id", ["ts", "event_id"], "event_type", "event_id")

    # Landed responses and pages made from the entities ---------------------------------------

    def pack(
        self,
        rows: DataFrame,
        endpoint: str,
        params: dict[str, str],
        order: Sequence[str],
        item: Column,
        wrap: str | None = None,
    ) -> DataFrame:
        """Rows as response pages of at most ``PER_PAGE`` items in a landing table."""
        columns = list(params.values())
        rows = materialize(rows.select(*dict.fromkeys([*columns, *order]), item.alias("_item")), "pack")
        placed = with_index(rows, columns, order, "_i")
        page = (F.floor((F.col("_i") - 1) / PER_PAGE) + 1).cast("int")
        items = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_item"))), lambda x: x["_item"])
        pages = placed.groupBy(*columns, page.alias("page")).agg(items.alias("_items"))
        body = F.col("_items") if wrap is None else F.struct(F.col("_items").alias(wrap))
        names = [F.lit(n) for n in params]
        landing = pages.select(
            F.lit(endpoint).alias("endpoint"),
            F.map_from_arrays(F.array(*names), F.array(*[F.col(c) for c in columns])).alias("params"),
            "page",
            F.lit(200).alias("status"),
            F.to_json(body).alias("body"),
        )
        return materialize(landing, "landing")

    def _repo_parts(self, rows: DataFrame) -> DataFrame:
        parts = F.split("repo_id", "/")
        return rows.withColumn("_owner", parts[0]).withColumn("_repo", parts[1])

    def landed_tickets(self, endpoint: str, rows: DataFrame) -> DataFrame:
        moment = "yyyy-MM-dd'T'HH:mm:ss'Z'"
        fields = [
            F.col("id").cast("bigint").alias("id"),
            "title",
            F.col("url").alias("html_url"),
            "state",
            F.struct(F.col("author").alias("login")).alias("user"),
            F.date_format("created_at", moment).alias("created_at"),
            F.date_format("updated_at", moment).alias("updated_at"),
        ]
        if endpoint == "issues":
            marker = F.when(F.col("pull_request").isNotNull(), F.struct(F.col("pull_request").alias("url")))
            fields.append(marker.alias("pull_request"))
        return self.pack(
            self._repo_parts(rows),
            endpoint,
            {"owner": "_owner", "repo": "_repo", "state": "state"},
            ["id", "tie", "updated_at"],
            F.struct(*fields),
        )

    def with_ends(self, landing: DataFrame, states: Sequence[str]) -> DataFrame:
        """Landed tickets with the page without items that ends the sequence of each repository and state."""
        params = F.col("params")
        lengths = landing.groupBy("endpoint", params["owner"].alias("owner"), params["repo"].alias("repo")).agg(
            *[F.max(F.when(params["state"] == state, F.col("page"))).alias(state) for state in states]
        )
        ends = F.array(*[F.struct(F.lit(s).alias("state"), (F.coalesce(s, F.lit(0)) + 1).alias("page")) for s in states])
        names = F.array(*[F.lit(n) for n in ("owner", "repo", "state")])
        rows = lengths.select("endpoint", "owner", "repo", F.explode(ends).alias("e")).select(
            "endpoint",
            F.map_from_arrays(names, F.array("owner", "repo", "e.state")).alias("params"),
            F.col("e.page").cast("int").alias("page"),
            F.lit(200).alias("status"),
            F.lit("[]").alias("body"),
        )
        return landing.unionByName(rows)

    def landed_users(self) -> DataFrame:
        body = F.struct(
            F.col("id").cast("bigint").alias("id"), "login", F.col("url").alias("html_url"), "company", "location"
        )
        return self.contact().select(
            F.lit("user").alias("endpoint"),
            F.create_map(F.lit("user"), F.col("login")).alias("params"),
            F.lit(1).alias("page"),
            F.lit(200).alias("status"),
            F.to_json(body).alias("body"),
        )

    def landed_repos(self, endpoint: str = "repos") -> DataFrame:
        item = F.struct(
            "name",
            F.struct(F.col("owner").alias("login")).alias("owner"),
            F.col("url").alias("html_url"),
            "description",
            F.col("stars").alias("stargazers_count"),
            "language",
            F.struct(F.col("license").alias("key")).alias("license"),
        )
        return self.pack(self.repo(), endpoint, {"user": "owner"}, ["part_key"], item)

    def landed_contributors(self) -> DataFrame:
        user = self.contact().select(F.col("id").cast("bigint").alias("dst"), "login", "url")
        repo = self.repo().select(F.col("part_key").alias("repo_pos"), F.col("id").alias("repo_id"))
        rows = self.contributor().join(user, "dst").join(repo, "repo_pos")
        item = F.struct("login", F.col("dst").alias("id"), F.col("url").alias("html_url"))
        return self.pack(
            self._repo_parts(rows), "contributors", {"owner": "_owner", "repo": "_repo"}, ["contrib_pos", "dst"], item
        )

    def landed_searches(self) -> DataFrame:
        users = self.table("customer").withColumn("_rank", -F.col("c_acctbal"))
        item = F.struct(F.col("c_name").alias("login"))
        return self.pack(users, "search_users", {"language": "c_mktsegment"}, ["_rank", "c_custkey"], item, wrap="items")

    def profile_pages(self) -> DataFrame:
        """Web pages of an owner's repositories: one article with heading and text per repository."""
        path = F.concat_ws("/", F.lit(""), "owner", "name")
        card = F.concat(
            F.lit('<article class="card"><h3><a href="'), path, F.lit('">'), F.col("name"), F.lit("</a></h3><p> "),
            F.col("description"), F.lit(' </p><span itemprop="programmingLanguage">'), F.col("language"),
            F.lit("</span></article>"),
        )
        return self._html_pages(card, "login")

    def nested_profile_pages(self) -> DataFrame:
        """As ``profile_pages``, with an article before the heading, or the card inside an article with a text of its own."""
        path = F.concat_ws("/", F.lit(""), "owner", "name")
        heading = F.concat(F.lit('<h3><a href="'), path, F.lit('">'), F.col("name"), F.lit("</a></h3>"))
        text = F.concat(F.lit("<p>"), "description", F.lit('<div><b itemprop="programmingLanguage">'), "language", F.lit("</b></div>"))
        holding = F.concat(F.lit("<article><article>note</article>"), heading, text, F.lit("</article>"))
        held = F.concat(F.lit("<article><p>around</p><article>"), heading, text, F.lit("</article></article>"))
        return self._html_pages(F.when(F.col("part_key") % 2 == 0, holding).otherwise(held), "login")

    def mixed_listing_pages(self) -> DataFrame:
        """Organisation listing pages that link each repository in one of three ways, and each in a way that does not count."""
        path = F.concat_ws("/", F.lit(""), "owner", "name")
        hover = F.concat(F.lit('<a data-hovercard-type="repository" href="'), path, F.lit('">r</a>'))
        heading = F.concat(F.lit('<h3 class="t"><span><a href="'), path, F.lit('/tree">r</a></span></h3>'))
        row = F.concat(F.lit('<ul><li class="a Box-row"><div><a href="'), path, F.lit('/stars">r</a></div><li>x</ul>'))
        none = F.concat(F.lit('<h4><a href="'), path, F.lit('/none">r</a></h4>'))
        way = F.col("part_key") % 3
        return self._html_pages(F.concat(none, F.when(way == 0, hover).when(way == 1, heading).otherwise(row)), "org")

    def trending_pages(self) -> DataFrame:
        """A page per nation with an article for each of its users."""
        name = F.col("c_name")
        article = F.concat(
            F.lit('<article class="b"><h1 class="h3"><a href="/'), name, F.lit('">u</a><a href="https://x/'), name,
            F.lit('">x</a></h1><h2><a href="/not-'), name, F.lit('">r</a></h2></article><h1><a href="/no-'), name, F.lit('">n</a></h1>'),
        )
        users = materialize(self.table("customer").select("c_nationkey", "c_custkey", article.alias("_html")), "snippets")
        placed = with_index(users, ["c_nationkey"], ["c_custkey"], "_i")
        part = F.floor((F.col("_i") - 1) / CARDS_PER_PAGE)
        texts = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_html"))), lambda x: x["_html"])
        pages = placed.groupBy(F.col("c_nationkey").alias("page"), part.alias("_part")).agg(F.array_join(texts, "").alias("html"))
        return pages.select("page", "html")

    def listing_pages(self) -> DataFrame:
        """Organisation listing pages that link each repository in three ways."""
        path = F.concat_ws("/", F.lit(""), "owner", "name")
        row = F.concat(
            F.lit('<li class="Box-row wide"><a href="'), path, F.lit('/stars">stars</a></li><h3><a href="'), path,
            F.lit('/tree">tree</a></h3><a data-hovercard-type="repository" href="'), path, F.lit('">'), F.col("name"),
            F.lit("</a><!-- <a data-hovercard-type='repository' href='/no/where'> -->"),
        )
        return self._html_pages(row, "org")

    def _html_pages(self, snippet: Column, user: str) -> DataFrame:
        rows = materialize(self.repo().select("owner", "part_key", snippet.alias("_html")), "snippets")
        placed = with_index(rows, ["owner"], ["part_key"], "_i")
        page = (F.floor((F.col("_i") - 1) / CARDS_PER_PAGE) + 1).cast("int")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_html"))), lambda x: x["_html"])
        pages = placed.groupBy(F.col("owner").alias(user), page.alias("page")).agg(texts.alias("_t"))
        html = F.concat(F.lit('<html><script>var t="</h3>";</script><body>'), F.array_join("_t", "\n"), F.lit("</body></html>"))
        return pages.select(user, "page", html.alias("html"))


def _url(*parts: str | Column) -> Column:
    return F.concat_ws("/", F.lit(HUB), *parts)


def _join(prefix: str, number: str) -> Column:
    return F.concat(F.lit(prefix), F.col(number).cast("string"))


# SQL of the same bindings, in order of dependence.
VIEWS = {
    "contact": """
        SELECT CAST(c.c_custkey AS VARCHAR) AS id, c.c_name AS login, 'https://hub.example/' || c.c_name AS url,
               n.n_name AS company, r.r_name AS location,
               sha256(c.c_name || 'https://hub.example/' || c.c_name) AS hash
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "repo": """
        SELECT p.p_partkey AS part_key, c.c_name || '/part-' || CAST(p.p_partkey AS VARCHAR) AS id,
               'part-' || CAST(p.p_partkey AS VARCHAR) AS name, c.c_name AS owner,
               'https://hub.example/' || c.c_name || '/part-' || CAST(p.p_partkey AS VARCHAR) AS url,
               p.p_name AS description, CAST(FLOOR(p.p_retailprice) AS BIGINT) AS stars, p.p_brand AS language,
               p.p_type AS license, FALSE AS has_open_license, p.p_size AS size
        FROM part p JOIN customer c ON c.c_custkey = p.p_partkey % (SELECT COUNT(*) FROM customer)""",
    "raw_issues": """
        SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS VARCHAR) AS id, r.id AS repo_id, r.description AS title,
               r.url || '/issues/' || CAST(l.l_orderkey * 10 + l.l_linenumber AS VARCHAR) AS url,
               CASE WHEN l.l_linestatus = 'O' THEN 'open' ELSE 'closed' END AS state, c.c_name AS author,
               o.o_orderdate AS created_at, l.l_shipdate AS updated_at,
               CASE WHEN l.l_returnflag = 'R' OR r.size = 1 THEN r.url END AS pull_request, l.l_suppkey AS tie
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN repo r ON r.part_key = l.l_partkey""",
    "issue": """
        SELECT id, repo_id, title, url, state, author, created_at, updated_at FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY repo_id, id ORDER BY tie, updated_at) AS rn
          FROM raw_issues WHERE pull_request IS NULL) WHERE rn = 1""",
    "pr": """
        SELECT id, repo_id, title, url, state, author, created_at, updated_at FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY repo_id, id ORDER BY tie, updated_at) AS rn
          FROM raw_issues WHERE pull_request IS NOT NULL) WHERE rn = 1""",
    # One row per stored issue or pull request, on the narrow columns of its key.
    "ticket_keys": """
        SELECT DISTINCT l.l_partkey AS part_key, l.l_orderkey * 10 + l.l_linenumber AS number,
               l.l_returnflag = 'R' OR p.p_size = 1 AS is_pr
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "repo_obs": """
        SELECT 'owner-' || CAST(l_orderkey AS VARCHAR) AS owner, 'repo-' || CAST(l_linenumber AS VARCHAR) AS name,
               'https://hub.example/' || l_linestatus AS url, CAST(l_quantity AS BIGINT) AS stars,
               ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS seq
        FROM lineitem""",
    "issue_obs": """
        SELECT 'owner/repo-' || CAST(l_orderkey AS VARCHAR) AS repo_id, CAST(l_linenumber AS VARCHAR) AS id,
               'https://hub.example/' || l_linestatus AS url, CASE WHEN l_quantity >= 25 THEN l_shipdate END AS updated_at,
               ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS seq
        FROM lineitem WHERE l_returnflag <> 'R'""",
    "pr_obs": """
        SELECT 'owner/repo-' || CAST(l_orderkey AS VARCHAR) AS repo_id, CAST(l_linenumber AS VARCHAR) AS id,
               'https://hub.example/' || l_linestatus AS url, CASE WHEN l_quantity >= 25 THEN l_shipdate END AS updated_at,
               ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS seq
        FROM lineitem WHERE l_returnflag = 'R'""",
    "contact_obs": """
        SELECT c.c_name AS login, 'https://hub.example/' || c.c_name AS url,
               CASE WHEN l.l_returnflag = 'N' THEN 'Company ' || l.l_linestatus ELSE '' END AS company,
               ROW_NUMBER() OVER (PARTITION BY c.c_custkey
                 ORDER BY l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS seq
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey""",
    "raw_issue_pages": """
        SELECT l_partkey AS endpoint, l_linenumber AS page,
               CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n
        FROM lineitem GROUP BY l_partkey, l_linenumber""",
    "contributor": """
        SELECT l.l_partkey % (SELECT COUNT(*) FROM customer) AS src, o.o_custkey AS dst, l.l_partkey AS repo_pos,
               MIN(l.l_orderkey) AS contrib_pos
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_partkey, o.o_custkey""",
    "seeds": "SELECT c_nationkey AS seed_id, MIN(c_custkey) AS login FROM customer GROUP BY c_nationkey",
    "transition": """
        SELECT event_id AS seq, from_state, to_state FROM (
          SELECT event_id, event_type AS from_state,
                 LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_state FROM events)
        WHERE to_state IS NOT NULL""",
}
NEEDS = {"raw_issues": ("repo",), "issue": ("repo", "raw_issues"), "pr": ("repo", "raw_issues")}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named views and what they build on."""
    wanted = [v for v in VIEWS if v in names or any(v in NEEDS.get(n, ()) for n in names)]
    head = "WITH RECURSIVE" if recursive else "WITH"
    # Views that several others read are computed once.
    kept = "" if recursive else "MATERIALIZED "
    return f"{head} " + ",\n".join(f"{v} AS {kept}({VIEWS[v]})" for v in wanted)
