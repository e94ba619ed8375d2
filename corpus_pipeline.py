"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import bpe, decontamination, jaccard_join, suffix_dedup, toxicity
from panelyard.llm.common import NULL_ID, checked_broadcast, new_folder, row_key, stored, stored_alone
from panelyard.llm.queries import tokenizer

NEAR_WORDS, NEAR_PERCENT = 5, 80
REPEATED_BYTES = 100
CACHED_MATCHES = 100_000  # of a worker, which lives on beside the other stages' work


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejection line. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct("*").alias("row"), "text")
    graded = toxicity.score(rows, toxicity.train(docs, labels), out="severity")
    return graded.where(F.col("severity") < toxicity.REJECT_FROM).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id. Rows that repeat that
    id and differ stay; of equal rows all stay, as they are one document. Null ids stay only
    where they are the smallest of their group, as they are."""

    def linked() -> DataFrame:
        found = jaccard_join.similar_groups(docs, NEAR_WORDS, NEAR_PERCENT)
        ends = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_i"), F.coalesce("component_id", F.lit(NULL_ID)).alias("_c"))
        return ends.where("_i <> _c").select("_i").distinct()

    gone = stored_alone(spark, "near-duplicates", linked)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_i"))
    return rows.join(checked_broadcast(gone), "_i", "left_anti").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters that repeat earlier strings; n_chars is counted anew. A
    document of which nothing is left stays as an empty text; a null text stays null."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    cut = suffix_dedup.remove_repeats(rows, REPEATED_BYTES, keep=["row"], by_character=True)
    text = F.when(F.col("row.text").isNotNull(), F.decode("kept", "UTF-8"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        counted = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size("spans") > 0, counted).otherwise(F.col("row.n_chars"))
    return cut.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of any benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # the operator's rows carry the row's key, so equal rows go together
    keyed = docs.select(F.struct("*").alias("row"), *row_key("doc_id", "text"))

    def hit() -> DataFrame:
        found = decontamination.decontaminate(docs, benchmark, width=10, with_key=True)
        return found.where("contaminated").select("_i", "_h").distinct()

    gone = stored_alone(spark, "contaminated", hit)
    return keyed.join(checked_broadcast(gone), ["_i", "_h"], "left_anti").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids (binary, unsigned 32-bit little-endian) of each text;
    round_trip tells whether decoding gives the text back."""
    path, pattern = tokenizer()
    # stored in between: encoding and decoding in one task would take two Python workers a core
    encoded = stored(bpe.encode(docs, path, pattern, carry_text=True, cached=CACHED_MATCHES), "encoded")
    decoded = bpe.decode(encoded, path)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.encode("text", "UTF-8")).alias("round_trip")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

ORACLE_SQL = None  # a fitted model and byte-level work; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = new_folder(spark, f"stage-{n}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
