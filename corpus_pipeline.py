"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns that they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendweave.llm import decontaminate, language_mix, line_chunks, near_copies, packing, simhash
from mendweave.llm.common import read, saved, shared_dir, sheltered
from mendweave.llm.components import components

#: A document stays if its main language makes up this much of it; a text without letters has no language.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in. Null texts and texts without letters go."""
    inner, back = sheltered(docs, "text", "lang")
    judged = language_mix.identify(inner, inner, inner.columns)
    return back(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of lines that stand in an earlier one; n_chars follows the text."""
    inner, back = sheltered(docs, "doc_id", "text", "n_chars")
    cut = line_chunks.dedup_lines(inner)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(cut)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, one without an id only if none has one. Which row stays
    does not depend on ids being there or being distinct.

    Texts link whose SimHash fingerprints lie within two bits, as in op9. What that leaves out, texts alike in at least 0.8 of their
    five-word shingles with fingerprints further apart, is linked by an exact join; groups are what both reach together."""
    inner, back = sheltered(docs, "doc_id", "text")
    # a row is told by two hashes, 128 bits, of what it is chosen by
    keyed = inner.withColumns({"__row": F.xxhash64("text", F.col("doc_id").isNull(), "doc_id"), "__row2": F.xxhash64(F.lit(1), "doc_id", "text")})
    prints = simhash.group(keyed, ["__row", "__row2"]).select("doc_id", "__row", "__row2", F.xxhash64(F.lit(0), "group_id").alias("u")).distinct()
    sets = near_copies.group(keyed, ["__row", "__row2"]).select("__row", "__row2", F.xxhash64(F.lit(1), "group_id").alias("v")).distinct()
    met = saved(prints.join(sets, ["__row", "__row2"]))
    # only groups of either kind that hold several of the other merge anything
    pairs = met.select("u", "v").distinct()
    several = [pairs.join(pairs.groupBy(x).agg(F.count("*").alias("n")).where("n > 1").select(x), x, "left_semi").select("u", "v") for x in "uv"]
    roots = components(several[0].union(several[1])).withColumnRenamed("node", "u")
    found = met.join(roots, "u", "left").withColumn("group_id", F.coalesce("root", "u"))
    first = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row", "__row2")).alias("x")).select("x.__row", "x.__row2")
    # both by the same key, so that the texts are shuffled once
    return back(keyed.join(first, ["__row", "__row2"], "left_semi").dropDuplicates(["__row", "__row2"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in a benchmark passage."""
    inner, back = sheltered(docs, "text")
    found = decontaminate.judged(decontaminate.find_items(inner, read(spark, sf_dir, "benchmark"), inner.columns))
    return back(found.where(~F.col("contaminated")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place there."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The language models, hashes and token ids have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared checkpoint folder."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
