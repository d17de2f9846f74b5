"""Benchmark decontamination by winnowing.

A window is ``length`` consecutive words of a benchmark item (the whole item if it is shorter). For
each window length L that occurs, k-grams with k = (L+1)//2 are hashed, and of every run of
w = L-k+1 neighbouring hashes the smallest is kept. A shared window of L words has the same w hashes
on both sides, so both keep the same one: k + w - 1 = L guarantees that every shared window meets.
Meeting fingerprints are then extended to the windows around them, which are compared as text.
Built-in functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import NOT_ALNUM, free_name, lower_ascii, small_side, text_tie, words_of
from tidewatch.session import cut_lineage

LENGTH = 10


def words(text: Column) -> Column:
    return words_of(lower_ascii(text), NOT_ALNUM)


def _sizes(length: int) -> tuple[int, int]:
    k = (length + 1) // 2
    return k, length - k + 1


def _grams(w: Column, k: int) -> Column:
    """Hashes of all k-grams; ``w`` must hold at least k words."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def _joined(w: Column, start: Column | int, n: int) -> Column:
    return F.array_join(F.slice(w, start, n), " ")


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(item, len, window): the distinct windows of each item. Null and wordless items have none."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    sized = items.withColumn("len", F.least(F.size("w"), F.lit(length)))
    at = sized.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"))
    return at.select("item", "len", F.array_join(F.slice("w", F.col("s"), F.col("len")), " ").alias("window")).distinct()


def _window_marks(windows: DataFrame, length: int) -> DataFrame:
    """(h): the smallest k-gram hash of each window of this length."""
    k, _ = _sizes(length)
    w = F.split("window", " ")
    return windows.where(F.col("len") == length).select(F.array_min(_grams(w, k)).alias("h")).distinct()


def _document_marks(texts: DataFrame, length: int) -> DataFrame:
    """(_id, _tie, h, first, around): winnowed hashes with the words that the windows over them can reach.

    ``around`` holds at most 2 length - k words, beginning at word number ``first`` (from 0).
    """
    k, w = _sizes(length)
    g, least = F.col("_g"), F.col("_least")
    long_enough = texts.where(F.size("_w") >= length).withColumn("_g", _grams(F.col("_w"), k))
    # Beyond the ends get() is null and least() and greatest() skip it.
    lows = F.transform(g, lambda h, i: F.least(h, *[F.get(g, i + j) for j in range(1, w)])) if w > 1 else g

    def kept(i: Column) -> Column:
        top = F.greatest(*[F.get(least, i - j) for j in range(w)]) if w > 1 else F.get(least, i)
        return F.get(g, i) == top

    def mark(i: Column) -> Column:
        first = F.greatest(i - (w - 1), F.lit(0))
        return F.struct(F.get(g, i).alias("h"), first.alias("first"), F.slice("_w", first + 1, i - first + length).alias("around"))

    picked = F.transform(F.filter(F.sequence(F.lit(0), F.size(g) - 1), kept), mark)
    marks = long_enough.withColumn("_least", lows).select("_id", "_tie", F.explode(picked).alias("_m"))
    return marks.select("_id", "_tie", "_m.h", "_m.first", "_m.around")


def _hits(texts: DataFrame, windows: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """(_id, _tie, s, len, window): where windows of this length occur, s counted from 0."""
    marks = small_side(_window_marks(windows, length))
    near = _document_marks(texts, length).join(marks, "h")
    at = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.size("around") - length),
            lambda o: F.struct((F.col("first") + o).alias("s"), _joined(F.col("around"), o + 1, length).alias("window")),
        )
    )
    found = near.where(F.size("around") >= length).select("_id", "_tie", at.alias("_x")).select("_id", "_tie", "_x.s", F.lit(length).alias("len"), "_x.window")
    return found.join(known, ["len", "window"], "left_semi")


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", length: int = LENGTH
) -> DataFrame:
    """One row per row of ``documents``: id, the row's text tie, n_words, n_hit, spans and items.

    ``n_hit`` counts the words inside any occurrence of a window; ``spans`` lists (s, len) of the
    occurrences; ``items`` the distinct ids (as strings, sorted) of items with occurring windows. Ids
    that are null name no item, but their windows count as hits. Null texts have no words. Repeated rows
    get equal results. Other columns are not carried.
    """
    texts = documents.select(F.col(id_col).alias("_id"), text_tie(F.col(text)).alias("_tie"), words(F.col(text)).alias("_w"))
    windows = item_windows(benchmark, item_id, text, length)
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most ``length`` values
    known = small_side(windows.select("len", "window").distinct())
    found = None
    for n in lengths:
        hits = _hits(texts, windows, known, n)
        found = hits if found is None else found.union(hits)
    base = texts.select("_id", "_tie", F.size("_w").cast("long").alias("n_words"))
    if found is None:
        none = base.withColumn("spans", F.array().cast("array<struct<s:int,len:int>>")).withColumn("items", F.array().cast("array<string>"))
        return none.select(F.col("_id").alias(id_col), "_tie", "n_words", F.lit(0).cast("long").alias("n_hit"), "spans", "items")
    # The few hits are kept, since finding them reads all words and three results build on them.
    found = cut_lineage(found)
    # A span or an item is listed once per document, so lists are bounded by its words and by the benchmark.
    spans = found.groupBy("_id", "_tie").agg(F.collect_set(F.struct("s", "len")).alias("spans"))
    of_item = small_side(windows.where("item is not null"))
    items = found.select("_id", "_tie", "len", "window").distinct().join(of_item, ["len", "window"]).groupBy("_id", "_tie").agg(F.collect_set("item").alias("items"))
    per_doc = spans.alias("x").join(items.alias("y"), F.col("x._id").eqNullSafe(F.col("y._id")) & (F.col("x._tie") == F.col("y._tie")), "left")
    per_doc = per_doc.select(F.col("x._id").alias("_hit_id"), F.col("x._tie").alias("_hit_tie"), "spans", "items")
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["len"] - 1)))))
    joined = base.join(per_doc, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_tie") == F.col("_hit_tie")), "left")
    return joined.select(
        F.col("_id").alias(id_col), "_tie", "n_words",
        F.when(F.col("spans").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,len:int>>")).alias("spans"),
        F.coalesce(F.array_sort("items"), F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no benchmark window, with all their columns."""
    tie, bad_id, bad_tie = (free_name(documents, n) for n in ("_doc_tie", "_bad_id", "_bad_tie"))
    hit = contamination(documents, benchmark, id_col, text).where("n_hit > 0").select(F.col(id_col).alias(bad_id), F.col("_tie").alias(bad_tie)).distinct()
    keyed = documents.withColumn(tie, text_tie(F.col(text)))
    clean = keyed.join(hit, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.col(tie) == F.col(bad_tie)), "left_anti")
    return clean.select(*documents.columns)
