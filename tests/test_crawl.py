"""Landed responses to stored tables, against a plain-Python crawl."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from forgelake import schemas
from forgelake.operators.crawl import crawl
from forgelake.plans import registry
from forgelake.plans.bindings import Bound


def forge(seed):
    """Users with repositories, contributors and tickets; some profiles never landed."""
    rng = random.Random(seed)
    users = [f"u{i}" for i in range(14)]
    repos = {u: [f"{u}r{i}" for i in range(rng.randrange(4))] for u in users}
    help_ = {(u, r): rng.sample(users, rng.randrange(5)) for u in users for r in repos[u]}
    tickets = {(u, r): [rng.randrange(6) for _ in range(rng.randrange(5))] for u in users for r in repos[u]}
    return users, repos, help_, tickets


def landing(spark, forge_, missing):
    users, repos, help_, tickets = forge_
    pages = []

    def land(endpoint, params, items, per_page=2):
        parts = [items[i : i + per_page] for i in range(0, len(items), per_page)]
        pages.extend((endpoint, params, n, 200, json.dumps(part)) for n, part in enumerate([*parts, []], 1))

    for number, u in enumerate(users):
        body = {"id": number, "login": u, "html_url": f"h/{u}", "company": f"c{u}"}
        pages.append(("user", {"user": u}, 1, 404 if u in missing else 200, json.dumps(body)))
        land("repos", {"user": u}, [{"name": r, "owner": {"login": u}, "html_url": f"h/{u}/{r}", "stargazers_count": 5} for r in repos[u]])
        for r in repos[u]:
            who = {"owner": u, "repo": r}
            land("contributors", who, [{"id": users.index(c), "login": c, "html_url": f"h/{c}"} for c in help_[u, r]])
            for endpoint in ("issues", "pulls"):
                for state in ("open", "closed"):
                    items = [{"id": t, "title": f"{state}{i}", "html_url": f"{endpoint}/{t}", "state": state, "user": {"login": u}}
                             for i, t in enumerate(tickets[u, r]) if (t % 2 == 0) == (state == "open")]
                    land(endpoint, {**who, "state": state}, items)
    return spark.createDataFrame(pages, schemas.LANDING)


def plain_crawl(forge_, missing, starts, budget, tables=None):
    users, repos, help_, tickets = forge_
    contacts, stored_repos, issues, pulls = tables or ({}, {}, {}, {})
    for start in starts:
        visited, queue = [], [start]
        while queue and len(visited) < budget:
            user = queue.pop(0)
            if user in visited:
                continue
            visited.append(user)
            if user in users and user not in missing:
                contacts[user] = f"c{user}"
            for r in repos.get(user, []):
                stored_repos.setdefault(f"{user}/{r}", 5)
                for table in (issues, pulls):
                    for state in ("open", "closed"):
                        for i, t in enumerate(tickets[user, r]):
                            if (t % 2 == 0) == (state == "open"):
                                table.setdefault((f"{user}/{r}", str(t)), f"{state}{i}")
                for c in help_[user, r]:
                    contacts[c] = ""
                    queue.append(c)
    return contacts, stored_repos, issues, pulls


def stored_as_plain(tables):
    return (
        {r.login: r.company for r in tables["contacts"].collect()},
        {r.id: r.stars for r in tables["repositories"].collect()},
        {(r.repo_id, r.id): r.title for r in tables["issues"].collect()},
        {(r.repo_id, r.id): r.title for r in tables["pull_requests"].collect()},
    )


@pytest.mark.parametrize(("seed", "starts", "budget"), [(1, ["u0"], 100), (2, ["u3", "u0", "nobody"], 100), (3, ["u1", "u2"], 3)])
def test_crawl_equals_the_queue(spark, seed, starts, budget):
    world, missing = forge(seed), {"u5", "u9"}
    seeds = spark.createDataFrame(list(enumerate(starts)), "seed_id int, login string")
    now = F.lit("2024-01-01").cast("timestamp")
    tables = crawl(landing(spark, world, missing), seeds, max_visits=budget if budget < 100 else None, now=now)
    want = plain_crawl(world, missing, starts, budget)
    assert stored_as_plain(tables) == want and all(want)
    contact = tables["contacts"].filter("login = 'u0'").first()
    assert contact.hash == hashlib.sha256(b"u0h/u0").hexdigest() and "arrival" not in tables["contacts"].columns


def test_a_second_crawl_on_top_of_the_first(spark):
    world = forge(4)
    pages = landing(spark, world, set())
    seeds = lambda login: spark.createDataFrame([(0, login)], "seed_id int, login string")
    now = F.lit("2024-01-01").cast("timestamp")
    first = crawl(pages, seeds("u0"), max_visits=2, now=now)
    second = crawl(pages, seeds("u1"), max_visits=4, stored=first, now=now)
    want = plain_crawl(world, set(), ["u1"], 4, plain_crawl(world, set(), ["u0"], 2))
    assert stored_as_plain(second) == want


def test_tickets_are_joined_once_for_both_endpoints(spark, tmp_path, monkeypatch):
    def table(name, columns, *rows):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")

    table("region", "r_regionkey int, r_name string", (0, "R"))
    table("nation", "n_nationkey int, n_name string, n_regionkey int", (0, "N", 0))
    table("customer", "c_custkey long, c_name string, c_nationkey int", (0, "u0", 0), (1, "u1", 0))
    table("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", (3, "n", "b", "t", 5, 9.5))
    table("orders", "o_orderkey long, o_custkey long, o_orderdate date", (7, 0, datetime.date(2020, 1, 2)))
    day = datetime.date(2020, 1, 3)
    lines = [(7, n, 3, 1, flag, "O", day) for n, flag in enumerate("NRN", 1)]
    table("lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate date", *lines)
    written, write = [], registry.materialize
    monkeypatch.setattr(registry, "materialize", lambda df, label: written.append(label) or write(df, label))
    pages = registry._landing(Bound(spark, str(tmp_path)))
    assert written == ["tickets"]
    items = {r["endpoint"]: [i["id"] for i in json.loads(r["body"])] for r in pages.filter("endpoint IN ('issues', 'pulls')").collect()}
    assert items == {"issues": [71, 72, 73], "pulls": [72]}
