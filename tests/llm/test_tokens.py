"""Operators 1, 3 and 10 against the tokenizer library on whole texts."""

import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import packing, queries, token_counts, token_files
from ledgerloom.llm.common import scratch
from ledgerloom.llm.tokens import Pieces
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def library(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_pieces_equal_the_library():
    p = Pieces(PATH)
    texts = [t for _, t in ODD]
    for text, raw in zip(texts * 2, p.encode(texts) + p.encode(texts)):
        assert list(struct.unpack(f"<{len(raw) // 2}H", raw)) == library(text)
        assert "".join(p.pre_tokens(text or "")) == (text or "")


def test_pieces_of_other_tokenizers_take_whole_texts():
    import sentencepiece
    words, pieces = Pieces(public_tokenizers.path("word_bpe_49k.json")), Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    w = Tokenizer.from_file(words.path)
    s = sentencepiece.SentencePieceProcessor(model_file=pieces.path)
    text = "Hello  World, naïve <|endoftext|> test"
    assert words.counts([text]) == [len(w.encode(text, add_special_tokens=False).ids)]
    assert pieces.counts([text]) == [len(s.encode(text))]


@pytest.mark.parametrize("frequent", [None, {}])
def test_counts_brute_force(spark, small, monkeypatch, frequent):
    """With and without a broadcast dictionary."""
    if frequent is not None:
        monkeypatch.setattr(token_counts, "frequent_counts", lambda *_: frequent)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1(spark, SF_SMALL).collect()}
    assert got == {i: (len((t or "").encode()), n := len(library(t)), n > 1024) for i, t in small}


def test_counts_of_odd_rows(odd, nothing):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, PATH).collect())
    assert got == Counter((i, len((t or "").encode()), len(library(t))) for i, t in ODD)
    assert token_counts.token_counts(nothing, PATH).count() == 0


def test_counts_of_texts_with_equal_short_hashes(spark):
    import xxhash
    seen = {}
    for k in range(2_000_000):
        text = "word " * (1 + k % 7) + str(k)
        other = seen.setdefault(xxhash.xxh32_intdigest(text.encode()), text)
        if other != text and len(other) != len(text):
            break
    docs = spark.createDataFrame([(None, text), (None, other), (1, text), (1, other), (1, other)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, PATH).collect())
    assert got == sorted((i, len(t), len(library(t))) for i, t in ((0, text), (0, other), (1, text), (1, other), (1, other)))


def test_token_files_round_trip(spark, small):
    rows = queries.op3(spark, SF_SMALL).orderBy("doc_id").collect()
    start = 0
    for r, (i, text) in zip(rows, sorted(small)):
        ids = library(text) + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == len(small)


def test_token_files_of_odd_rows(spark, odd, nothing):
    path = scratch(spark, "odd")
    token_files.write_tokens(odd.repartition(3), path, PATH, 2)
    back = token_files.read_tokens(spark, path)
    got = sorted(back.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(library(t) + [2])) for i, t in ODD)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    path = scratch(spark, "none")
    token_files.write_tokens(nothing, path, PATH, 2)
    assert token_files.read_crc(spark, path).count() == 0


def test_token_files_encodings_and_metadata_reads(spark):
    import glob

    import pyarrow.parquet as pq
    path = scratch(spark, "encodings")
    token_files.write_tokens(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), path, PATH, 2)
    group = pq.ParquetFile(sorted(glob.glob(f"{path.removeprefix('file:')}/part-*"))[0]).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    plan = token_files.read_tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan


def check_packing(rows, docs, length=2048):
    """Each id in one piece, sequences gapless, ids right; returns the share of padding."""
    want = defaultdict(list)
    for i, text in docs:
        want[i].append(library(text) + [1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, versions in want.items():
        for ids in versions:
            own = by_doc[i, len(ids)]
            places = Counter((r.start, r.length, r.ids_crc32) for r in own)
            copies = sum(len(v) == len(ids) for v in versions)
            assert sum(r.length for r in own) == copies * len(ids)
            for start, n, c in places:
                assert any(crc(v[start:start + n]) == c for v in versions if len(v) == len(ids))
    used = pad = 0
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert 0 < at <= length
        used += at
        pad += 0 if at & (at - 1) == 0 else length - at
    assert sum(map(len, by_doc.values())) == len(rows)
    return pad / (used + pad)


def test_packing_brute_force(spark, small):
    rows = queries.op10(spark, SF_SMALL).collect()
    assert check_packing(rows, small) < 0.02


def test_packing_of_odd_rows(odd, nothing):
    check_packing(packing.piece_digests(packing.pack(odd, PATH, 1, group_bytes=40)).collect(), ODD)
    assert packing.pack(nothing, PATH, 1).count() == 0


def test_first_fit_decreasing_against_a_plain_search():
    import random
    rng = random.Random(3)
    for n in (1, 2, 7, 100):
        sizes = [rng.randint(1, 50) for _ in range(n)]
        free, plain = [], [0] * n
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(50)
            free[k] -= sizes[i]
            plain[i] = k
        assert packing.first_fit_decreasing(sizes, 50) == plain


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "more text here")], "doc_id bigint, text string")
    row = packing.pack(docs, PATH, 1).withColumn("n", F.size("pieces")).first()
    ids = struct.unpack(f"<{row.used}I", row.ids)
    for p in row.pieces:
        text = {1: "hello world", 2: "more text here"}[p.doc_id]
        assert list(ids[p.offset:p.offset + p.length]) == library(text) + [1]
