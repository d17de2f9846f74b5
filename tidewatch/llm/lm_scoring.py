"""Language-model scoring of whole texts: word counts of all training texts and self-attention on subword ids.

Words are counted over the whole corpus through the global distinct-word shuffle, in which each distinct
word is also turned into subword ids once. The attention model is trained by tasks on all training texts, with
corpus-wide counts of the subwords, and scores every subword once, in overlapping windows.

Scores are over the same events as the base: the known words, the end, and one class for all unknown
words. A known word has the model's probability of its first subword (given that a word begins) times its
share of the training words that begin so; every word has besides a small part of the product of its
subwords' probabilities; the unknown class keeps what the base gives it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import attention_lm
from tidewatch.llm.byte_bpe import Vocabulary
from tidewatch.llm.common import UPPER, free_name, release_memory
from tidewatch.llm.word_blocks import Lists, pack, schema_of, text_sequences, unpack, word_pages, words_in
from tidewatch.session import cut_lineage

# Words of a stretch, as training texts are cut to be learned from.
SPAN_WORDS = 48
# Stretches of the first fit, which is the common start, and of each task's fit after it; tokens of a page of sums.
FIRST_SPANS = 10_000
GROUP_SPANS = 10_000
PAGE_TOKENS = 2048
# Characters of text that are cut into stretches together, and words whose ids a task keeps.
SPAN_CHARS = 2_000_000
KNOWN_WORDS = 300_000
SMOOTHING = 0.1
# Parts of the probability that go to spelling words out, and, of first subwords, to their plain shares.
SPELLED = 0.05
PLAIN = 0.05
# Bytes of packed sequences that are scored together.
CHUNK = 60_000

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def split_words(text: str | None) -> list[str]:
    """Words between the six ASCII separators, A to Z lower-cased."""
    return [w.decode() for w in (text or "").encode().translate(_LOWER).split()]


def cut_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    is_word = pc.not_equal(parts.values, "").to_numpy(zero_copy_only=False)
    coded = parts.values.filter(pa.array(is_word)).dictionary_encode()
    lengths = np.diff(np.concatenate(([0], np.cumsum(is_word)))[np.asarray(parts.offsets)])
    return np.asarray(coded.indices, dtype=np.int64), lengths, coded.dictionary.to_pylist()


def _count_words(rows: DataFrame, vocabulary, text: str, counted: str) -> DataFrame:
    """Per page and block the total counts and subword ids of its words; per page also its sums (_block null)."""

    def task(pages: pa.Table) -> pa.Table:
        encoder, total = vocabulary.value.encoding, {}
        listed = [words_in(s, w) for s, w in zip(pages.column("_sizes").to_pylist(), pages.column("_words").to_pylist())]
        for words, counts in zip(listed, pages.column("_counts").to_pylist()):
            for w, c in zip(words, unpack(counts).tolist()):
                total[w] = total.get(w, 0) + c
        ids = {w: encoder.encode_ordinary(" " + w.decode()) for w in total}
        flat = np.array([i for w in total for i in ids[w]], dtype=np.int64)
        times = np.array([c for w, c in total.items() for _ in ids[w]], dtype=np.int64)
        own, at = np.unique(flat, return_inverse=True)
        sums = np.bincount(at, times, len(own)).astype(np.int64)
        starts, at = np.unique(np.array([ids[w][0] for w in total], dtype=np.int64), return_inverse=True)
        start_sums = np.bincount(at, np.array(list(total.values()), dtype=np.int64), len(starts)).astype(np.int64)
        seen = [pack(np.array([total[w] for w in words], dtype=np.int64)) for words in listed]
        sizes = [pack(np.array([len(ids[w]) for w in words], dtype=np.int64)) for words in listed]
        subwords = [pack(np.array([i for w in words for i in ids[w]], dtype=np.int64)) for words in listed]
        n = len(listed)
        return pa.table({
            "_block": pa.chunked_array([*pages.column("_block").chunks, pa.array([None], pa.int64())]),
            "_ranks": pa.array([*pages.column("_ranks").to_pylist(), None], pa.binary()),
            "_seen": pa.array([*seen, None], pa.binary()), "_sizes": pa.array([*sizes, None], pa.binary()), "_ids": pa.array([*subwords, None], pa.binary()),
            "_total": pa.array([None] * n + [sum(total.values())], pa.int64()),
            "_distinct": pa.array([None] * n + [sum(c > 0 for c in total.values())], pa.int64()),
            "_tokens": pa.array([None] * n + [own.tolist()], pa.list_(pa.int64())), "_times": pa.array([None] * n + [sums.tolist()], pa.list_(pa.int64())),
            "_starts": pa.array([None] * n + [starts.tolist()], pa.list_(pa.int64())), "_start_times": pa.array([None] * n + [start_sums.tolist()], pa.list_(pa.int64())),
        })

    schema = "_block long, _ranks binary, _seen binary, _sizes binary, _ids binary, _total long, _distinct long, _tokens array<long>, _times array<long>, _starts array<long>, _start_times array<long>"
    return word_pages(rows, text, cut_words, counted).groupBy("_page").applyInArrow(task, schema)


def spans_of(text: str | None, share: int) -> Iterator[tuple[list[bytes], bool, bool]]:
    """The stretches of SPAN_WORDS words of a text that are learned from, and whether they begin and end it.

    A stretch is chosen by a checksum of its words, one in ``share``, wherever it stands.
    """
    words = (text or "").encode().translate(_LOWER).split()
    for s in range(0, len(words), SPAN_WORDS):
        part = words[s : s + SPAN_WORDS]
        if zlib.crc32(b" ".join(part)) % share == 0:
            yield part, s == 0, s + SPAN_WORDS >= len(words)


def packed_spans(texts: pa.Array, ids_of: Callable[[list[str]], list[list[int]]], end: int, share: int, kind: str) -> pa.Array:
    """The stretches of ``spans_of`` each text, as the subword ids of their words in one binary of numbers of ``kind``."""
    numbers, lengths, words = cut_words(texts)
    # Two more words stand for the mark of the end, before and after each text's own.
    listed = [*ids_of(words), [end]]
    size = np.fromiter(map(len, listed), np.int64, len(listed))
    flat = np.fromiter(chain.from_iterable(listed), np.int64, int(size.sum()))
    start = np.cumsum(size) - size
    stops = np.cumsum(lengths)
    bounds = np.stack((stops - lengths, stops), axis=1).ravel()
    numbers = np.insert(numbers, bounds, len(words))
    n = size[numbers]
    ids = flat[np.repeat(start[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(kind)
    # First word of each stretch, in the words with marks; marks belong to the stretch they touch.
    per_text = -(-lengths // SPAN_WORDS)
    own = np.repeat(np.arange(len(lengths)), per_text)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    before = stops - lengths + 2 * np.arange(len(lengths))
    first = before[own] + (nth > 0) + SPAN_WORDS * nth
    last = np.where(nth + 1 == per_text[own], before[own] + lengths[own] + 2, before[own] + 1 + SPAN_WORDS * (nth + 1))
    if share > 1:
        named = [w.encode() for w in words] + [b""]
        marks = [zlib.crc32(b" ".join(named[i] for i in numbers[a:b].tolist() if i < len(words))) for a, b in zip(first.tolist(), last.tolist())]
        chosen = np.array(marks, dtype=np.int64) % share == 0
        first, last = first[chosen], last[chosen]
    ends = np.concatenate(([0], np.cumsum(n))) * ids.itemsize
    data = ids.tobytes()
    return pa.array([data[a:b] for a, b in zip(ends[first].tolist(), ends[last].tolist())], pa.binary())


def _spans(rows: DataFrame, vocabulary, text: str, counted: str, share: int) -> DataFrame:
    """(packed, ids): subword ids of the chosen stretches of all training texts, equal ones once.

    They are shuffled and stored packed, in two bytes an id where the vocabulary allows; ``ids`` is made of that where it is read.
    """
    end = len(vocabulary.value.ranks)
    kind = _kind(end)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = vocabulary.value.encoding.encode_ordinary, {}

        def ids_of(words: list[str]) -> list[list[int]]:
            if len(known) > KNOWN_WORDS:
                known.clear()
            return [known.get(w) or known.setdefault(w, encode(" " + w)) for w in words]

        for batch in batches:
            texts, at = batch.column("t").fill_null(""), 0
            ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPAN_CHARS)))
                yield pa.record_batch({"packed": packed_spans(texts.slice(at, stop - at), ids_of, end, share, kind)})
                at = stop
            release_memory()

    texts = rows.where(F.col(counted)).select(F.col(text).alias("t"))
    # In an order that no run changes and no content favours.
    stretches = texts.mapInArrow(task, "packed binary").distinct().sortWithinPartitions(F.xxhash64("packed"), "packed")
    width = np.dtype(kind).itemsize
    number = F.expr(f"transform(sequence(1, octet_length(packed), {width}), i -> cast(conv(hex(substring(packed, i, {width})), 16, 10) as int))")
    return cut_lineage(stretches).select("packed", number.alias("ids"))


def _kind(end: int) -> str:
    """Big-endian numbers that hold all ids up to ``end``."""
    return ">u2" if end < 1 << 16 else ">u4"


def _packed_rows(learned: attention_lm.Learned) -> pa.RecordBatch:
    """Weighted sums by page of tokens, and a page for what belongs to the whole."""
    page = learned.tokens // PAGE_TOKENS
    width = learned.rows.shape[1]
    pages, data = [], []
    for p in np.unique(page).tolist():
        own = page == p
        table = np.zeros((PAGE_TOKENS, width + 1), np.float32)
        table[learned.tokens[own] - p * PAGE_TOKENS, :width] = learned.rows[own] * learned.weight[own, None]
        table[learned.tokens[own] - p * PAGE_TOKENS, width] = learned.weight[own]
        pages.append(p)
        data.append(table.tobytes())
    total = learned.weight.sum()
    whole = np.concatenate((learned.near * total, learned.usual * total, [total])).astype(np.float32)
    return pa.record_batch({"page": pa.array([*pages, -1], pa.int64()), "data": pa.array([*data, whole.tobytes()], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tables of each page; rows come sorted by page, so one sum is held at a time."""
    now, total = None, None
    for batch in batches:
        for page, data in zip(batch.column("page").to_pylist(), batch.column("data").to_pylist()):
            table = np.frombuffer(data, np.float32).astype(np.float64)
            if page == now:
                total += table
                continue
            if now is not None:
                yield pa.record_batch({"page": pa.array([now], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})
            now, total = page, table
    if now is not None:
        yield pa.record_batch({"page": pa.array([now], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})


def learned_model(rows: DataFrame, vocabulary, text: str, counted: str, counts: np.ndarray) -> attention_lm.Attention:
    """The attention model of all training texts.

    Every stretch of them is learned from, equal ones once. A first fit on at most
    FIRST_SPANS of them sets the weights that all tasks go on from; each task then learns from its GROUP_SPANS, and
    the weights are joined as means by how often their tokens stood there. What comes back to the driver is
    bounded by the vocabulary.
    """
    n_tokens = len(vocabulary.value.ranks) + 1
    spans, kind = _spans(rows, vocabulary, text, counted, 1), _kind(n_tokens - 1)
    unpacked = lambda column: [np.frombuffer(s, kind).astype(np.int64) for s in column.to_pylist()]
    first = spans.orderBy(F.xxhash64("packed"), "packed").limit(FIRST_SPANS).select("packed").toArrow().column("packed")
    start = attention_lm.learn(unpacked(first), n_tokens, counts)
    if spans.count() <= GROUP_SPANS:
        return attention_lm.finished(start, n_tokens, counts)
    held = spans.sparkSession.sparkContext.broadcast((start, counts))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fits on GROUP_SPANS stretches at a time, whose sums leave the task as one."""
        before, counts = held.value
        own, n, fits = [], 0, attention_lm.Sums(n_tokens)
        for b in batches:
            own.append(b.column("packed"))
            n += b.num_rows
            while n >= GROUP_SPANS:
                rest = pa.chunked_array(own, pa.binary())
                fits.add(attention_lm.learn(unpacked(rest[:GROUP_SPANS]), n_tokens, counts, epochs=1, start=before))
                own, n = rest[GROUP_SPANS:].chunks, n - GROUP_SPANS
        if n:
            fits.add(attention_lm.learn(unpacked(pa.chunked_array(own, pa.binary())), n_tokens, counts, epochs=1, start=before))
        if fits.any:
            yield _packed_rows(fits.joined())
            release_memory()

    # The stretches lie by their content since equal ones met, so no further shuffle deals them.
    sums = spans.select("packed").mapInArrow(task, "page long, data binary").repartition("page").sortWithinPartitions("page").mapInArrow(_added, "page long, data binary")
    width = start.rows.shape[1]
    tokens, weight, table, near, usual = [], [], [], start.near, start.usual
    for r in sums.collect():
        data = np.frombuffer(r["data"], np.float64)
        if r["page"] < 0:
            near, usual = (x / data[-1] for x in (data[: len(near)], data[len(near) : -1]))
            continue
        page = data.reshape(PAGE_TOKENS, width + 1)
        at = np.flatnonzero(page[:, width])
        tokens.append(at + r["page"] * PAGE_TOKENS)
        weight.append(page[at, width])
        table.append(page[at, :width] / page[at, width:])
    # Tokens of the first fit alone keep what it found.
    joined = attention_lm.Learned(*(np.concatenate(x) for x in (tokens, weight, table)), near.astype(np.float32), usual)
    alone = ~np.isin(start.tokens, joined.tokens)
    joined = attention_lm.Learned(
        np.concatenate((joined.tokens, start.tokens[alone])), np.concatenate((joined.weight, start.weight[alone])), np.concatenate((joined.rows, start.rows[alone])).astype(np.float32), joined.near, usual
    )
    return attention_lm.finished(joined, n_tokens, counts)


def score(docs: DataFrame, vocabulary: Vocabulary, trains: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` of each row with n_tokens, n_known, train_tokens, base_score and score.

    The rows whose boolean column ``trains`` is true are learned from; all are scored. Tokens are
    the words and one end per text. Both scores are log10 probabilities: ``base_score`` of smoothed
    counts, ``score`` of the model. Null and empty texts have the end alone. Without training rows
    all words are unknown. ``docs`` is read twice and should come from stored files.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    if set(made) & set(keep):
        raise ValueError(f"columns {sorted(set(made) & set(keep))} are kept and made")
    body, counted = free_name(docs, "_body"), free_name(docs, "_counted")
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias(body), F.coalesce(F.col(trains), F.lit(False)).alias(counted))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    counted_words = cut_lineage(_count_words(source.select(body, counted), shared, body, counted))
    sums = counted_words.where("_block is null")
    totals = sums.agg(F.sum("_total").alias("n"), F.sum("_distinct").alias("v")).first()
    ends = source.where(F.col(counted)).count()
    n_train, n_distinct = (totals["n"] or 0) + ends, (totals["v"] or 0) + (ends > 0)
    end = len(vocabulary.ranks)

    def summed(tokens: str, times: str) -> np.ndarray:
        """Corpus-wide counts by subword: at most one row for each of the vocabulary comes back."""
        out = np.zeros(end + 1)
        pairs = sums.select(F.explode(F.arrays_zip(F.col(tokens).alias("t"), F.col(times).alias("n"))).alias("x"))
        for r in pairs.groupBy("x.t").agg(F.sum("x.n").alias("n")).collect():
            out[r["t"]] = r["n"]
        out[end] = ends
        return out

    counts, start_counts = summed("_tokens", "_times"), summed("_starts", "_start_times")
    begins = np.zeros(end + 1, bool)
    begins[[i for b, i in vocabulary.ranks.items() if b[:1] == b" "] + [end]] = True
    model = learned_model(source.select(body, counted), shared, body, counted, counts)
    held = docs.sparkSession.sparkContext.broadcast(model)
    whole = n_train + SMOOTHING * (n_distinct + 1)
    unknown = SMOOTHING / whole

    def task(texts: pa.Table, pages: pa.Table) -> pa.Table:
        lists = Lists.of(pages, "_sizes", "_ids", "_seen")
        sequences = texts.column("_sequence").to_pylist()
        columns = {c: [] for c in made}
        for ranks, lengths in lists.chunks(sequences, CHUNK):
            ends_at = np.cumsum(lengths)
            part = np.split(ranks, ends_at[:-1])
            subwords = [np.concatenate(([end], lists.joined(r), [end])) for r in part]
            logs_of, begin_logs = attention_lm.token_log_probs(held.value, subwords, begins)
            for own, ids, logs, begin in zip(part, subwords, logs_of, begin_logs):
                seen = np.append(lists.also[own], ends)
                at = np.concatenate(([0], np.cumsum(lists.size[own])))
                of_start = start_counts[ids[1:][at]]
                spelled = np.exp(np.add.reduceat(logs.astype(np.float64), at))
                start = (1 - PLAIN) * np.exp((logs - begin)[at].astype(np.float64)) + PLAIN * of_start / max(n_train, 1)
                word = max(0.0, 1 - SPELLED - unknown) * start * seen / np.maximum(of_start, 1)
                p = SPELLED * spelled + np.where(seen > 0, word, unknown)
                columns["n_tokens"].append(len(seen))
                columns["n_known"].append(int((seen > 0).sum()))
                columns["base_score"].append(float(np.log10(seen + SMOOTHING).sum() - len(seen) * math.log10(whole)))
                columns["score"].append(float(np.log10(np.minimum(p, 1)).sum()))
        columns["train_tokens"] = [n_train] * len(sequences)
        out = texts.select(keep)
        for c in made:
            out = out.append_column(c, pa.array(columns[c], pa.float64() if "score" in c else pa.int64()))
        return out

    placed = text_sequences(source.select(*keep, body), body, keep, cut_words)
    pages = counted_words.where("_block is not null").select("_block", "_ranks", "_seen", "_sizes", "_ids")
    schema = f"{schema_of(source, keep)}n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return placed.groupBy("_block").cogroup(pages.groupBy("_block")).applyInArrow(task, schema)
