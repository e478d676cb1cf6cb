"""Corpus pipeline: five stages over ``documents``, each one operator.

Language ID (texts that it rejects go), exact dedup (one row of equal texts
stays), near dedup (one document of each group stays), mixing of sources to
target weights (the text in which a leaf's token prefix ends is cut there),
packing into token sequences. All stages but the last return the columns of
``documents``, further columns too; each works on whole texts of all rows that
its predecessor kept.

Defined results: null and blank texts are rejected by the first stage; rows
without an id are judged each by its text; of rows with one id the texts are
judged each, but near duplicates take an id's texts as one document; an empty
table gives no rows. A column ``domain`` of the documents is kept and not used:
the mix takes the domain from the source.

No SQL expresses the first stage, so ``ORACLE_SQL`` is None
and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import exact_dedup, language_id, mixing, near_dedup, packing, queries
from runlens.llm.common import materialise, release

#: Share of all tokens that the mix takes.
MIX_SHARE = 0.9
#: Similarity, in hundredths, from which near duplicates are one group.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(language_id.fold() != 1))
    return language_id.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT, rows=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    levels = ["domain", "lang", "source"]
    out = mixing.keep_mixed(docs, queries.with_domain(docs), levels, queries.mix_weights(spark), MIX_SHARE, seed=17)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written before the next reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage")
            release(before)
    return docs
