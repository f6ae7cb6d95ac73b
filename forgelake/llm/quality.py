"""Quality rules with robust multivariate outliers (operator 6), in DataFrame functions only.

Each document becomes a vector of transformed statistics (see ``FEATURES``). Per language and source, the
centre and covariance are estimated by minimum covariance determinant: from a start by medians,
concentration steps take the ``CORE`` share of rows that lie closest to the present estimate and estimate
anew from these. The covariance of that core is then scaled so that the median squared distance is that of
the chi-square distribution. Documents beyond ``CUTOFF`` of that distribution are rejected.

A group needs ``MIN_ROWS`` documents that passed the base rules. Smaller ones are joined per language,
and what is still too small over all languages; if even that is too small, nothing is rejected by
distance. Every step is an aggregate per group with one row per group as its result; medians and core
radii come from mergeable quantile sketches, so a source with a third of all rows is no burden. Most
documents have no symbols or repeats at all, so each feature's variance gets a floor (``FLOORS``), without
which the least deviation from zero would be infinitely far.

Base rules: at least ``MIN_WORDS`` words, and at most 30 of 100 words inside repeated 8-word windows.

Defined results: a NULL or empty text has no words, all counts 0, and fails the base rules. NULL language
or source is a group like any other. Rows that repeat are judged one by one. An empty table gives an
empty result. Texts are used whole.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelake.llm.common import prepare, text_or_empty
from forgelake.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
FEATURES = ("x_length", "x_word", "x_symbol", "x_line", "x_repeat")
# Least standard deviation of each feature.
FLOORS = (0.5, 0.05, 0.1, 0.1, 0.1)
CORE = 0.75
STEPS = 4
CUTOFF = 0.999999
MIN_ROWS = 200
_ACCURACY = 2000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _covered(sorted_windows: Column) -> Column:
    """Words inside windows that occur twice, from (hash, start) structs in order of hash."""
    n = F.size(sorted_windows)
    same = lambda i, j: F.get(sorted_windows, i)["h"] == F.get(sorted_windows, j)["h"]
    starts = F.array_sort(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.coalesce(F.when(i > 0, same(i, i - 1)), F.lit(False))
                | F.coalesce(F.when(i < n - 1, same(i, i + 1)), F.lit(False)),
            ),
            lambda i: F.get(sorted_windows, i)["i"],
        )
    )
    state = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        starts,
        state,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n")),
    )["n"]


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long), n_lines."""
    text = F.col("_text")
    split = docs.select(*keep, text_or_empty(text_col).alias("_text")).select(
        *keep, "_text", words_of(text).alias("_words"), F.filter(F.split(text, "\n"), lambda x: without(x, BLANKS) != "").alias("_lines")
    )
    counted = split.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(without(text, BLANKS)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")))
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get("_hashes", i + j) for j in range(WINDOW))))
    seen = counted.withColumn("_windows", windows).drop("_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sorted_windows = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Sorting is for the few texts that repeat a window at all.
    chosen = seen.withColumn("_sorted", F.when(repeats, sorted_windows)).drop("_windows")
    return chosen.withColumn(
        "n_repeat_words", F.coalesce(F.when(F.col("_sorted").isNotNull(), _covered(F.col("_sorted"))), F.lit(0).cast("bigint"))
    ).drop("_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "x_length": F.log(words),
        "x_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x_symbol": F.sqrt(F.col("n_symbols") / words),
        "x_line": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x_repeat": F.sqrt(F.col("n_repeat_words") / words),
    }


def chi_square(quantile: float, degrees: int) -> float:
    """Quantile of the chi-square distribution by Wilson and Hilferty's approximation."""
    z = NormalDist().inv_cdf(quantile)
    return degrees * (1 - 2 / (9 * degrees) + z * (2 / (9 * degrees)) ** 0.5) ** 3


def _lower(i: int, j: int) -> str:
    return f"l{i}{j}"


def with_cholesky(estimates: DataFrame) -> DataFrame:
    """Add the lower Cholesky factor of the covariance (columns ``c{i}{j}``, ``j <= i``)."""
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(_lower(i, k)) * F.col(_lower(j, k))
            value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(_lower(j, j))
            estimates = estimates.withColumn(_lower(i, j), value)
    return estimates


def with_distance(rows: DataFrame) -> DataFrame:
    """Add the squared Mahalanobis distance, by forward substitution with the Cholesky factor."""
    total, solved = F.lit(0.0), []
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(_lower(i, k)) * F.col(f"_z{k}")
        rows = rows.withColumn(f"_z{i}", rest / F.col(_lower(i, i)))
        solved.append(f"_z{i}")
        total = total + F.col(f"_z{i}") * F.col(f"_z{i}")
    return rows.withColumn("distance", total).drop(*solved)


def _moments(rows: DataFrame) -> DataFrame:
    """Centre and covariance per group, one row each; ``count`` of rows as ``n``."""
    wanted = [F.count("*").alias("n")]
    for i, x in enumerate(FEATURES):
        wanted.append(F.avg(x).alias(f"m{i}"))
        for j in range(i + 1):
            value = F.covar_pop(x, FEATURES[j]) if i != j else F.var_pop(x)
            wanted.append((value + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}"))
    return rows.groupBy("group").agg(*wanted)


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and the squared deviations to the quartiles on the diagonal."""
    quartiles = rows.groupBy("group").agg(
        *(F.percentile_approx(x, [0.25, 0.5, 0.75], _ACCURACY).alias(f"q{i}") for i, x in enumerate(FEATURES))
    )
    columns = ["group"]
    for i in range(len(FEATURES)):
        columns.append(F.col(f"q{i}")[1].alias(f"m{i}"))
        for j in range(i + 1):
            spread = (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
            columns.append((spread * spread + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}"))
    return quartiles.select(*columns)


def estimate(rows: DataFrame, *, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """Minimum covariance determinant per ``group``: centre ``m{i}``, covariance, Cholesky factor and
    ``radius``, the squared distance of the cutoff; one row per group, written to the shared folder."""
    found = _start(rows)
    for step in range(steps):
        placed = with_distance(rows.join(materialize(with_cholesky(found), f"mcd-{step}"), "group"))
        placed = placed.select("group", *FEATURES, "distance")
        radii = placed.groupBy("group").agg(F.percentile_approx("distance", core, _ACCURACY).alias("limit"))
        inner = placed.join(materialize(radii, f"radius-{step}"), "group").filter("distance <= limit")
        found = _moments(inner)
    final = materialize(with_cholesky(found), "mcd")
    middle = with_distance(rows.join(final, "group")).groupBy("group").agg(
        F.percentile_approx("distance", 0.5, _ACCURACY).alias("middle")
    )
    p = len(FEATURES)
    scale = F.greatest(F.col("middle") / chi_square(0.5, p), F.lit(1.0))
    return materialize(final.join(middle, "group").withColumn("radius", scale * chi_square(CUTOFF, p)), "mcd-final")


def grouped(stats: DataFrame, min_rows: int, lang_col: str, source_col: str) -> DataFrame:
    """Add ``group``: language and source, or the language's rest, or the rest of all."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("\x00"))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00"))
    keyed = stats.withColumn("_l", lang).withColumn("_s", source)
    counts = materialize(keyed.filter(~F.col("base_failed")).groupBy("_l", "_s").agg(F.count("*").alias("_n")), "group-sizes")
    rest = counts.filter(F.col("_n") < min_rows).groupBy("_l").agg(F.sum("_n").alias("_rest"))
    named = counts.join(rest, "_l", "left").select(
        "_l",
        "_s",
        F.when(F.col("_n") >= min_rows, F.concat_ws("\x01", F.lit("s"), "_l", "_s"))
        .when(F.col("_rest") >= min_rows, F.concat_ws("\x01", F.lit("l"), "_l"))
        .otherwise("r")
        .alias("group"),
    )
    # One row per language and source; groups that no document passed into are the rest of all.
    return keyed.join(named, ["_l", "_s"], "left").withColumn("group", F.coalesce("group", F.lit("r"))).drop("_l", "_s")


def judge(
    docs: DataFrame,
    *,
    keep: list[str] | None = None,
    min_rows: int = MIN_ROWS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``keep`` (default doc_id) of every document with its statistics, features, base_failed, distance
    (squared, NULL where no group was large enough) and kept."""
    prepare(docs.sparkSession)
    keep = keep or ["doc_id"]
    named = docs.select(*keep, F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_whole"))
    stats = statistics(named, [*keep, "_lang", "_source"], "_whole")
    stats = materialize(stats.withColumn("base_failed", base_failed()).withColumns(features()), "statistics")
    rows = materialize(grouped(stats, min_rows, "_lang", "_source"), "grouped")
    passed = rows.filter(~F.col("base_failed")).select("group", *FEATURES)
    estimates = estimate(passed).filter(F.col("group").startswith("s\x01") | F.col("group").startswith("l\x01") | (F.col("n") >= min_rows * CORE))
    placed = with_distance(rows.join(estimates.drop("n"), "group", "left"))
    verdict = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= F.col("radius")))
    return placed.withColumn("kept", verdict).select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "distance",
        "radius",
        *FEATURES,
    )
