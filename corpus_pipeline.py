"""From raw documents to packed training sequences: five stages, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reprise.llm import mixing, packing, parity_join, secrets, toxicity
from reprise.llm.common import named, stage, table, unstage, whole_row
from reprise.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the ordinal model doesn't find toxic, every row and column as it is.

    Null and empty texts stay, and so do repeated rows; without labels, or without a toxic one, everything stays.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.judged("text", model)["toxic"])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Of rows with the same id and text one stays, the smallest by a hash of all columns; rows with the same id and
    another text stay as well, as do rows without an id and texts without words, which are duplicates of nothing.
    """
    kept = parity_join.jaccard_components(docs).where("component_id = doc_id").select(F.col("doc_id").alias("id")).distinct()
    field = lambda f: F.col("row").getField(f.name)
    row = [F.to_json(field(f)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else field(f) for f in docs.schema]
    told = docs.select(whole_row(docs)).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("t"), F.xxhash64(*row).alias("h"))
    # the choice is made on hashes; texts are shuffled once, to meet it
    chosen = stage(told.select("id", "t", "h").join(kept, "id", "left_semi").groupBy("id", "t").agg(F.min("h").alias("h"), F.count("*").alias("rows")))
    out = told.join(chosen.where("rows = 1"), ["id", "t", "h"], "left_semi").select("row")
    if not (repeated := chosen.where("rows > 1")).isEmpty():
        out = out.unionByName(told.join(repeated, ["id", "t", "h"], "left_semi").groupBy("id", "t").agg(F.min_by("row", "h").alias("row")).select("row"))
    return docs.where("doc_id is null").unionByName(out.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced by a mark and n_chars made right; null texts stay null."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, those of small sources up to twice; a null source is a source of its own.

    Rows come as their blocks were made; nothing is sorted, as packing places sequences by length.
    """
    return mixing.mixed(docs, most_repeats=2.0).select(*named(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece with its place; a row that comes twice is packed twice, a null text is the lone end id."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]
#: SQL can express neither the fitted models nor the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir))
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
