import hashlib

from pyspark.sql import functions as F

from forgelake.functions import identity as ids
from forgelake.functions.text import element_text, parse_stars


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_equal_arguments_give_equal_hashes(spark):
    a, b = (one(spark, ids.fingerprint(F.lit("test"), F.lit("data"))) for _ in range(2))
    assert a == b == sha("testdata")
    assert a != one(spark, ids.fingerprint(F.lit("different"), F.lit("data")))


def test_hash_length(spark):
    assert len(one(spark, ids.fingerprint(F.lit("test")))) == 64


def test_no_separator_and_null_is_empty(spark):
    assert one(spark, ids.fingerprint(F.lit("ab"), F.lit("c"))) == one(spark, ids.fingerprint(F.lit("a"), F.lit("bc")))
    assert one(spark, ids.fingerprint(F.lit("ab"), F.lit(None).cast("string"))) == sha("ab")


def test_present_hash_is_trusted(spark):
    df = spark.createDataFrame([("a", "u", "mine"), ("b", "u", ""), ("c", "u", None)], "login string, url string, hash string")
    got = {r.login: r.hash for r in ids.with_fingerprint(df, ids.CONTACT_IDENTITY).collect()}
    assert got == {"a": "mine", "b": sha("bu"), "c": sha("cu")}


def test_fallback_differs_from_fingerprint(spark):
    df = spark.createDataFrame([("o", "n", "u", ""), ("o", "n", "u", "kept")], "owner string, name string, url string, hash string")
    got = [tuple(r) for r in df.select(ids.shown_hash("owner", "name", "hash"), ids.fingerprint(*ids.REPO_IDENTITY)).collect()]
    assert got == [(sha("o/n"), sha("onu")), ("kept", sha("onu"))]


def test_key_texts(spark):
    df = spark.createDataFrame([("a", "b-c", "1")], "owner string, name string, id string")
    row = df.select(
        ids.contact_key("owner"), ids.repo_key(), ids.issue_key(ids.repo_id(), "id"), ids.pull_request_key(ids.repo_id(), "id")
    ).first()
    assert tuple(row) == ("contact:a", "repo:a/b-c", "issue:a/b-c/1", "pr:a/b-c/1")


def test_key_order_is_byte_order(spark):
    keys = [("a/b", "10"), ("a/b", "9"), ("a/b-c", "1"), ("é/b", "1"), ("z/b", "1")]
    df = spark.createDataFrame(keys, "repo_id string, id string").select(ids.issue_key().alias("k"))
    got = [r.k for r in df.orderBy("k").collect()]
    assert got == sorted(got, key=lambda t: t.encode()) and got[0] == "issue:a/b-c/1" and got[1] == "issue:a/b/10"


def test_parse_stars(spark):
    cases = {
        " 1,234 ": 1234, "1.2k": 0, "+7": 7, "-3": -3, "": 0, "1.5": 0, "1e3": 0, "12 3": 0, ",": 0,
        "\t42\n": 42, "99999999999999999999": 0, "1,2,3": 123, "7L": 0, "+": 0,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r[0]: r[1] for r in df.select("t", parse_stars("t")).collect()}
    assert got == {**cases, None: 0}


def test_element_text(spark):
    assert one(spark, element_text(F.lit(" \n<b>a</b> &amp;lt; &lt;b&gt;<br/>c "))) == "a &lt; <b>c"


def test_time_defaults(spark):
    df = spark.sql("SELECT TIMESTAMP '2020-01-01' t UNION ALL SELECT NULL")
    now = F.lit("2024-05-05").cast("timestamp")
    assert sorted(str(r[0])[:10] for r in df.select(ids.or_now("t", now)).collect()) == ["2020-01-01", "2024-05-05"]
    assert df.select(ids.or_now("t")).filter("coalesce(t, current_timestamp()) IS NULL").count() == 0
    assert one(spark, ids.id_text(F.lit(None).cast("bigint"))) == "0" and one(spark, ids.id_text(F.lit(12))) == "12"


def test_short_hash_is_reversible(spark):
    digest = "0f" * 32
    texts = [digest, digest.upper(), digest + "\n", digest[:-1], "", "h", "äß", "\x01" + digest, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    short = rows.withColumn("s", ids.short_hash("t"))
    got = {r.i: (r.back, len(r.s or b"")) for r in short.withColumn("back", ids.long_hash("s")).collect()}
    assert [got[i][0] for i in range(len(texts))] == texts
    assert got[0][1] == 33
