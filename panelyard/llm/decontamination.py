"""Benchmark decontamination over a distributed positional inverted index.

1. Every window of consecutive benchmark words gets its rarest words (counted over all
   training texts); these words are the index terms.
2. The index stores, per term and document, the list of positions.
3. The offset-adjusted lists of the two rarest words of a window are intersected: both must
   agree on where the window starts, exactly or within ``slop`` words.
4. What is left is compared with the words of the document: the same sequence is an exact
   match; all words within the window's length plus ``slop`` on each side a proximity match.

Only DataFrame functions are used. A term's list is never gathered in one place: its rows are
spread by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.llm.common import ascii_lower, checked_broadcast, is_small, row_key, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z: runs of digits, a-z and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, window_words, items): each distinct window with the sorted ids of its items. An
    item of fewer than ``width`` words is one window, an item without words is none."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    windows = items.where(F.size("w") > 0).select("item", "w", F.explode(starts).alias("s")).select(
        "item", F.slice("w", F.col("s") + 1, F.least(F.lit(width), F.size("w"))).alias("window_words")
    )
    return windows.groupBy("window_words").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.sha2(F.array_join("window_words", " "), 256).alias("window"), "window_words", "items"
    )


def rarest_terms(windows: DataFrame, documents: DataFrame, text: str, terms: int = 2) -> DataFrame:
    """(window, rank, term, offset): the ``terms`` words of each window that are the rarest in
    all documents; ties by offset."""
    placed = windows.select("window", F.posexplode("window_words").alias("offset", "term"))
    vocabulary = stored(placed.select("term").distinct(), "vocabulary")
    counts = (
        documents.select(F.explode(words_of(F.col(text))).alias("term"))
        .join(checked_broadcast(vocabulary), "term")
        .groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("window").orderBy("n", "offset")
    return (
        placed.join(vocabulary.join(counts, "term", "left").na.fill(0, ["n"]), "term")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= terms)
        .select("window", "rank", "term", "offset")
    )


def positional_index(documents: DataFrame, terms: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, _i, _h, positions): the stored postings of the given terms, one row per term and
    document."""
    return (
        documents.select(*row_key(doc_id, text), F.posexplode(words_of(F.col(text))).alias("position", "term"))
        .join(checked_broadcast(terms), "term")
        .groupBy("term", "_i", "_h").agg(F.array_sort(F.collect_set("position")).alias("positions"))
    )


def intersect_lists(index: DataFrame, rarest: DataFrame, slop: int) -> DataFrame:
    """(_i, _h, window, start): where the offset-adjusted lists of a window's rarest words
    agree within ``slop``. A window of one word has one list."""
    starts = index.join(checked_broadcast(rarest), "term").select(
        "_i", "_h", "window", "rank", "lists", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start")
    )
    first = starts.where("rank = 1")
    near = first.where("lists > 1").select(
        "_i", "_h", "window", F.col("start").alias("at"), F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)).alias("start")
    )
    second = starts.where("rank = 2").select("_i", "_h", "window", "start").distinct()
    met = near.join(second, ["_i", "_h", "window", "start"]).select("_i", "_h", "window", F.col("at").alias("start"))
    return met.union(first.where("lists = 1").select("_i", "_h", "window", "start")).distinct()


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 1,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    with_key: bool = False,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_hit (words inside an exact match of
    any window), n_items and items (ids of the items matched exactly, sorted as strings),
    n_near (proximity matches that are not exact) and contaminated.

    Null and empty texts have no words and no hits. An empty benchmark hits nothing. A null
    item id is written ``null``. Repeated rows get equal results each; an id that repeats with
    another text is a document of its own. Other columns are ignored, whatever their names.
    ``with_key`` adds the row's key (common.row_key).
    """
    windows = stored(benchmark_windows(benchmark, width, item_id, item_text), "windows")
    rarest = stored(rarest_terms(windows, documents, text), "rarest")
    rarest = stored(rarest.join(rarest.groupBy("window").agg(F.count(F.lit(1)).alias("lists")), "window"), "anchors")
    index = stored(positional_index(documents, stored(rarest.select("term").distinct(), "terms"), doc_id, text), "index")
    candidates = stored(intersect_lists(index, rarest, slop).join(windows, "window"), "candidates")
    by_document = candidates.groupBy("_i", "_h").agg(F.collect_list(F.struct("start", "window_words", "items")).alias("found"))
    if is_small(candidates):
        by_document = F.broadcast(by_document)

    rows = documents.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), words_of(F.col(text)).alias("w"))
    matched = rows.join(by_document, ["_i", "_h"], "left")

    def here(c: Column) -> Column:
        return (c["start"] >= 0) & (F.slice("w", F.greatest(c["start"], F.lit(0)) + 1, F.size(c["window_words"])) == c["window_words"])

    def about(c: Column) -> Column:
        low = F.greatest(c["start"] - slop, F.lit(0))
        span = F.slice("w", low + 1, c["start"] + F.size(c["window_words"]) + slop - low)
        return F.size(F.array_except(c["window_words"], span)) == 0

    found = F.coalesce(F.col("found"), F.array())
    exact = F.array_sort(F.transform(F.filter(found, here), lambda c: F.struct(c["start"].alias("s"), (c["start"] + F.size(c["window_words"])).alias("e"))))
    covered = F.aggregate(
        F.col("exact"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, c: F.struct(
            F.greatest(a["end"], c["e"]).alias("end"),
            (a["n"] + F.greatest(c["e"] - F.greatest(c["s"], a["end"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(found, here), lambda c: c["items"]))))
    near = F.size(F.filter(found, lambda c: ~here(c) & about(c)))
    plain = F.col("found").isNull()  # most documents: no array work at all
    key = ["_i", "_h"] if with_key else []
    out = matched.select(
        "doc_id", *key, F.size("w").cast("long").alias("n_words"),
        F.when(~plain, exact).alias("exact"), F.when(plain, F.array().cast("array<string>")).otherwise(items).alias("items"),
        F.when(plain, 0).otherwise(near).cast("long").alias("n_near"),
    )
    return out.select(
        "doc_id", *key, "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", "n_near",
    ).withColumn("contaminated", F.col("n_hit") > 0)
