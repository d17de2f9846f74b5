"""Substring dedup on sliding sentence spans.

A text is cut into sentences, and long sentences at words that the words around choose (winnowing), so that
equal passages are cut alike wherever they stand: of any window of twelve words in a long sentence the last
one with the least checksum ends a piece. No piece is longer than that, and two texts that share fifty words
lose at most twelve of them at each end to pieces that differ, so at least three equal pieces and fifteen words
are left, which is a run. Every run of at least three consecutive pieces and fifteen
words is hashed, the hashes are joined over all texts, and the pieces that any run other than the
first of its hash covers are removed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import bitmap, free_name, release_memory, text_tie
from tidewatch.session import cut_lineage, scratch_path

RUN_PIECES = 3
RUN_WORDS = 15
# Sentences above this many words are cut after the last least word of each window of as many words.
LONG_SENTENCE = 12

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")


def cuts_of(words: list[str]) -> list[int]:
    """Indexes of the words that have the least checksum of a window, of equal ones the last, in order.

    At most LONG_SENTENCE apart, and settled by the words of the window alone.
    """
    marks, out, best = [zlib.crc32(w.encode()) for w in words], [], -1
    for end in range(LONG_SENTENCE, len(marks) + 1):
        start = end - LONG_SENTENCE
        if best < start:
            best = min(range(start, end), key=lambda i: (marks[i], -i))
        elif marks[end - 1] <= marks[best]:
            best = end - 1
        else:
            continue
        out.append(best)
    return out


def pieces_of(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, normalised text, words) of all pieces; together they are the whole text.

    White space belongs to the piece before it; a piece without words counts none.
    """
    out, at = [], 0
    for end in [*(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]:
        if end == at:
            continue
        words = text[at:end].split()
        if len(words) <= LONG_SENTENCE:
            out.append((at, end, " ".join(words).lower(), len(words)))
        else:
            first, done = at, 0
            found = list(_WORD.finditer(text, at, end))
            own = [m.group().rstrip().lower() for m in found]
            last = len(found) - 1
            for i in [*(c for c in cuts_of(own) if c < last), last]:
                stop = end if i == last else found[i].end()
                out.append((first, stop, " ".join(own[done : i + 1]), i + 1 - done))
                first, done = stop, i + 1
        at = end
    return out


def runs_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first piece and end (exclusive) of the shortest sufficient run from each piece with words.

    Pieces without words are stepped over: they are in no hash, and lie inside the runs around them.
    """
    pieces = pieces_of(text)
    own = np.array([i for i, p in enumerate(pieces) if p[3]], dtype=np.int64)
    if len(own) < RUN_PIECES:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    words = np.concatenate(([0], np.cumsum([pieces[i][3] for i in own])))
    start = np.arange(len(own))
    end = np.maximum(np.searchsorted(words, words[:-1] + RUN_WORDS), start + RUN_PIECES)
    fit = end <= len(own)
    start, end = start[fit], end[fit]
    marks = b"".join(xxhash.xxh64_digest(pieces[i][2].encode()) for i in own)
    hashes = np.fromiter((xxhash.xxh64_intdigest(marks[8 * a : 8 * b], b - a) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    return hashes.view(np.int64), own[start], own[end - 1] + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with the hashes, first pieces and ends of its runs."""
    for batch in batches:
        texts, rows, at, held = batch.column("_text"), [], 0, 0
        for i in range(batch.num_rows):
            rows.append(runs_of(texts[i].as_py() or ""))
            held += len(rows[-1][0])
            if held >= 50_000 or i == batch.num_rows - 1:
                edges = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]).astype(np.int32))
                flat = [np.concatenate(x) for x in zip(*rows)]
                columns = [pa.ListArray.from_arrays(edges, pa.array(x.astype(t))) for x, t in zip(flat, (np.int64, np.int32, np.int32))]
                part = batch.slice(at, i + 1 - at)
                yield pa.record_batch([part.column("_id"), part.column("_tie"), *columns], ["_id", "_tie", "_hashes", "_starts", "_ends"])
                rows, at, held = [], i + 1, 0
        release_memory()


def cut_out(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[str, int]:
    """The text without the pieces from ``starts`` up to ``ends``, and how many words went."""
    pieces = pieces_of(text)
    drop = np.zeros(len(pieces) + 1, np.int64)
    np.add.at(drop, starts, 1)
    np.add.at(drop, ends, -1)
    gone = np.cumsum(drop)[:-1] > 0
    return "".join(text[p[0] : p[1]] for p, g in zip(pieces, gone) if not g), sum(p[3] for p, g in zip(pieces, gone) if g)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _tie, spans, first_ids): per document the piece ranges to remove, and whose they were first.

    First is the occurrence with the smallest id, then text hash, then place; null ids come before
    all. Rows that repeat id and text are one document: what they share with each other is kept.

    Texts are cut into runs once. Hashes alone are counted first; only runs whose hash may occur again, as a bitmap
    of bounded size says, are looked at further.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("_id"), text_tie(F.col(text)).alias("_tie"), F.col(text).alias("_text"))
    path = scratch_path(spark, "runs")
    source.mapInArrow(_runs, f"_id {kind}, _tie long, _hashes array<long>, _starts array<int>, _ends array<int>").write.parquet(path)
    stored = spark.read.parquet(path)
    again = stored.select(F.explode("_hashes").alias("_hash")).groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1")
    marked = bitmap(again, "_hash")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_hashes")
            hashes, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.flatnonzero(marked.value.holds(hashes))
            take = pa.array(row[at])
            starts, ends = (batch.column(c).flatten().to_numpy()[at] for c in ("_starts", "_ends"))
            yield pa.record_batch({"_id": batch.column("_id").take(take), "_tie": batch.column("_tie").take(take), "_hash": pa.array(hashes[at]), "_from": pa.array(starts), "_to": pa.array(ends)})
            release_memory()

    runs = stored.mapInArrow(repeated, f"_id {kind}, _tie long, _hash long, _from int, _to int")
    place = F.struct("_id", "_tie", "_from")
    # Aggregate and join instead of a window: combined before its shuffle, and splittable where one passage is everywhere.
    # The join is on the complement of the hash: by the hash itself it would have to take the aggregate's partitions as
    # they are, and adaptive execution could not split a hot one.
    key = F.bitwise_not("_hash").alias("_key")
    firsts = runs.groupBy("_hash").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").select(key, "_first")
    others = runs.select("_id", "_tie", "_from", "_to", key).join(firsts, "_key").where(~place.eqNullSafe(F.col("_first")))
    return others.groupBy("_id", "_tie").agg(F.collect_set(F.struct("_from", "_to")).alias("spans"), F.collect_set("_first._id").alias("first_ids"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", removed: str = "n_removed_words", first_ids: str = "first_ids") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and two more columns (replaced if present).

    ``removed`` counts the words cut (zero for texts left as they are), ``first_ids`` lists the ids of the
    documents that keep the passages. Null and empty texts stay. All rows stay, if need be with an empty text; other
    columns stay, whatever their names. Texts of any length are cut whole. An empty table gives an empty one.

    Only texts from which something may be cut are shuffled.
    """
    tie, cut, of_id, of_tie, spans_of, firsts, flag = (free_name(docs, n) for n in ("_own_tie", "_cut", "_of_id", "_of_tie", "_spans", "_first_ids", "_touched"))
    spans = cut_lineage(repeated_spans(docs, id_col, text)).select(
        F.col("_id").alias(of_id), F.col("_tie").alias(of_tie), F.col("spans").alias(spans_of), F.array_sort("first_ids").alias(firsts)
    )
    marked = bitmap(spans.select(F.xxhash64(of_id, of_tie).alias("k")), "k")

    @F.pandas_udf("boolean")
    def touched(keys: pd.Series) -> pd.Series:
        return pd.Series(marked.value.holds(keys.to_numpy()))

    # Ranges stay in Arrow: as Python objects those of a batch would be many times the texts.
    @F.arrow_udf("text string, words long")
    def shortened(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        found, words = [], []
        for i in range(len(texts)):
            if texts[i].is_valid and starts[i].is_valid:
                text, n = cut_out(texts[i].as_py(), starts[i].values.to_numpy(), ends[i].values.to_numpy())
            else:
                text, n = None, 0
            found.append(text)
            words.append(n)
        out = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(words, pa.int64())], ["text", "words"])
        del found
        release_memory()
        return out

    tied = docs.withColumn(tie, text_tie(F.col(text)))
    flagged = tied.withColumn(flag, touched(F.xxhash64(id_col, tie)))
    kept = [c for c in docs.columns if c not in (removed, first_ids)]
    none = F.array().cast(dict(spans.dtypes)[firsts])
    rest = flagged.where(~F.col(flag)).select(*kept, F.lit(0).cast("long").alias(removed), none.alias(first_ids))
    joined = flagged.where(flag).drop(flag).join(spans, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(tie) == F.col(of_tie)), "left")
    done = joined.withColumn(cut, shortened(F.when(F.col(spans_of).isNotNull(), F.col(text)), F.col(f"{spans_of}._from"), F.col(f"{spans_of}._to")))
    columns = [F.coalesce(F.col(f"{cut}.text"), F.col(text)).alias(c) if c == text else F.col(c) for c in kept]
    return rest.union(done.select(*columns, F.col(f"{cut}.words").alias(removed), F.coalesce(firsts, none).alias(first_ids)))
