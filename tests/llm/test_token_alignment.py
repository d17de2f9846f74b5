"""Alignment of two tokenizers against whole texts encoded by the libraries and counted in Python."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm import token_alignment

ODD = [
    "a  b", " a", "a ", "  ", " ", "\n", "a \n b", "a\n b", "a \nb", "a  \n  b", "tabs\t\tand \t x", "x\r\n\r\ny z", "don't I'LL we've", "▁ piece ▁▁ space", "x▁ y", "<s> </s> <unk> <|endoftext|> <0x41>",
    "Über Straße ça 中文 字\x85 　 x \x1c y \x1d  z", "é ﬁ ① ​ ﻿ \x00 q", "😀😀 👩‍👩‍👧 ok", "a" * 5000, "1234567890 " * 30, "if (x) {\r\n    return;\r\n}", "   indented\n        more", " nbsp  two  ",
]


@pytest.fixture(scope="module")
def pair():
    return token_alignment.load_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def brute(texts):
    """The measures of each text, every one encoded whole."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = token_alignment.byte_letters()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    done = []
    for t in texts:
        if not t:
            done.append(None)
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        parts_a, parts_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + t).encode():
            done.append(None)
            continue
        i = j = end_a = end_b = 0
        links, groups, own = [], [], ([], [])
        # Walk over both: the tokens under the cursor overlap; the one that ends first moves on.
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            to_a, to_b = end_a + len(parts_a[i]), end_b + len(parts_b[j])
            if to_a <= to_b:
                own[0].append(ids_a[i])
                i, end_a = i + 1, to_a
            if to_b <= to_a:
                own[1].append(ids_b[j])
                j, end_b = j + 1, to_b
            if to_a == to_b:
                groups.append("|".join(",".join(map(str, side)) for side in own))
                own = ([], [])
        done.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count, highest = Counter(), defaultdict(int)
    for d in done:
        count.update(set(d[3]) if d else ())
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    nothing = (0, 0, 0, 0, 0, 0, "")
    return [nothing if d is None else (*d[:3], len(d[3]), sum(count[p] == highest[p[0]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in done]


def answers(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df]


def test_measures_equal_brute_force(spark, sf_dir, edge_docs, pair):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD * 2)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(edge_docs.select("doc_id", "text")).union(odd)
    rows = token_alignment.align_documents(docs, pair).collect()
    assert len(rows) == docs.count()
    want = brute([r.text for r in rows])
    for r, got, w in zip(rows, answers(rows), want):
        assert got == w, (r.doc_id, r.text[:80])
    assert sum(w[0] > 0 for w in want) > 200 and any(w[0] == 0 and r.text for r, w in zip(rows, want))


def test_small_blocks_change_nothing(spark, sf_dir, pair, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").distinct().limit(40).collect()
    texts = [r.text for r in rows if r.text] + ODD
    rows = pa.table({"_body": pa.array(texts), "_copies": pa.array([1 + i % 3 for i in range(len(texts))]), "_key": pa.array([str(i).encode() for i in range(len(texts))])})
    whole = [b.to_pydict() for b in token_alignment._align_block(0, rows, pair)]
    monkeypatch.setattr(token_alignment, "UNITS", 7)
    assert [b.to_pydict() for b in token_alignment._align_block(0, rows, pair)] == whole


def test_clashing_columns_and_empty_tables(edge_docs, no_docs, pair):
    docs = edge_docs.withColumnsRenamed({"n_words": "n_a", "kept": "_body", "rule": "_copies", "slot": "_text_key", "shard": "_pair"})
    out = token_alignment.align_documents(docs, pair)
    assert len(out.columns) == len(set(out.columns)) and dict(out.dtypes)["n_a"] == "bigint"
    rows = out.collect()
    assert len(rows) == docs.count() and {r["_body"] for r in rows} == {"own kept"} and {r["_text_key"] for r in rows} == {"own slot"}
    assert token_alignment.align_documents(no_docs, pair).count() == 0


def test_only_suitable_tokenizers_are_taken():
    with pytest.raises((ValueError, TypeError, KeyError)):
        token_alignment.load_pair(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model"))
