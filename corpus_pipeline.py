"""From raw documents to packed sequences in five stages.

``STAGES`` lists (name, function); a function takes the session, the documents and the folder of the other
tables. All but the last return the columns of ``documents``. ``run`` writes each stage's result to the
shared folder and reads it back for the next one.

Defined results: what a stage's operator defines for NULLs, empty and long texts, ties, repeated rows and
empty tables. Further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelake.llm import decontaminate, language, line_dedup, near_dedup, packing
from forgelake.llm.common import free_name, prepare, table
from forgelake.session import materialize


# A text is in a language if that covers this share of what it covers of the median held-out text, less
# SLACK standard deviations of a share, since short texts vary; n-grams that start at one letter go together.
COVERED = 0.75
SLACK = 2
# Words whose ids a worker remembers while it packs: beside what the stages before have left, a fourth of the default.
PACKED_WORDS = 300_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no known language is found: no letter, or too few n-grams of the likeliest
    language for a text of that language, as those in other languages and random letters have.

    The filter learns from the documents' own labels, except for a fixed quarter of the ids, which shows what
    share of a text's n-grams each language covers; without rows there, the least share of the other languages,
    or else that of the rows learned from. All rows are learned from, and all labelled ones of that quarter set the
    shares: each text is judged once, and what was found is written. A very short text has so much slack that it can
    stay in any language. A NULL language is filled in. If no document is labelled, nothing can be learned and only
    documents without a letter go.
    """
    prepare(spark)
    held_out = language.fold("doc_id", 4) == 2
    model = language.train(docs.filter(~held_out))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    names = tuple(free_name(n, docs.columns) for n in ("_found", "_share", "_covered", "_ngrams"))
    lang_found, _, covered, ngrams = (F.col(n) for n in names)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = materialize(language.predict(docs, model, columns, names=names), "languages")
    labelled = found.filter(F.col("lang").isNotNull() & (covered > 0))
    # One row per language.
    for rows in (labelled.filter(held_out), labelled):
        lang = F.col("lang").cast("string").alias("lang")
        middle = rows.groupBy(lang).agg(F.percentile_approx(covered, 0.5).alias("share")).collect()
        if middle:
            break
    shares = {r["lang"]: r["share"] for r in middle}
    other = min(shares.values(), default=0.0)
    typical = F.create_map(*(F.lit(x) for lang in model.languages for x in (lang, float(shares.get(lang, other)))))
    slack = SLACK * F.sqrt(F.lit(0.25 * len(model.sizes)) / ngrams)
    known = (covered > 0) & (covered >= COVERED * typical[lang_found] - slack)
    kept = found.filter((lang_found != language.UNKNOWN) & known)
    return kept.withColumn("lang", F.coalesce(F.col("lang").cast("string"), lang_found)).select(*columns)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; a document that consisted of nothing else goes."""
    found = line_dedup.deduplicate(docs)
    deleted = F.col(free_name("_deleted", docs.columns))
    emptied = deleted.isNotNull() & (F.trim(F.translate("text", "\t\n\r", "")) == "")
    kept = found.filter(~emptied)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(deleted.isNull(), F.col("n_chars")).otherwise(length))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return near_dedup.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item, whole or edited."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece, with the crc32 of its ids."""
    return packing.digests(packing.pack(docs, max_words=PACKED_WORDS))


STAGES = [
    ("language", identify_language),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", deduplicate_documents),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

# SQL expresses neither the learned filter nor sampling, alignment or tokenization.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
