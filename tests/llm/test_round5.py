"""Exact bound before alignment; language chains taken through together."""

import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm import decontam, language_crf


def test_no_alignment_scores_above_the_words_in_common():
    rng = random.Random(5)
    for _ in range(300):
        kinds = rng.randint(1, 8)
        item = np.array([rng.randrange(kinds) for _ in range(rng.randint(1, 15))])
        passage = np.array([rng.randint(-1, kinds - 1) for _ in range(rng.randint(0, 25))], np.int64)
        assert decontam.alignment(item, passage)[0] <= decontam.reachable(item, kinds, passage)
    same = np.array([0, 1, 0, 2])
    assert decontam.reachable(same, 4, same) == decontam.alignment(same, same)[0] == 8


def test_only_passages_that_can_reach_the_share_are_aligned(spark, tmp_path):
    # the words of a copy, and three seeds in a row among other words
    item = " ".join(f"w{i}" for i in range(20))
    part = " ".join(f"w{i}" for i in range(5))
    # alignment fails where too few words are in common
    kept = decontam.alignment

    def strict(a, b):
        assert np.isin(a, b).sum() >= 10
        return kept(a, b)

    docs = spark.createDataFrame([(1, f"x {item} y"), (2, f"x {part} y"), (3, item.replace("w7 ", "")), (4, None), (5, part + " " + part)],
                                 "doc_id bigint, text string")
    decontam.alignment = strict
    try:
        got = decontam.contaminated(docs, spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()
    finally:
        decontam.alignment = kept
    assert sorted((r.doc_id, r.first_word, r.last_word) for r in got) == [(1, 1, 21), (3, 0, 19)]


def _model():
    return language_crf.fit([("en", "the cat and the dog".split()), ("de", "der hund und die katze".split())] * 4, rounds=10)


def test_short_chains_share_their_steps(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the cat and der hund und katze".split()) for _ in range(300)) for _ in range(256)]
    model, calls, plain = _model(), [], language_crf.messages
    monkeypatch.setattr(language_crf, "messages", lambda e, *a: calls.append(e.shape) or plain(e, *a))
    got = language_crf.shares(texts, model)
    assert len(calls) == 1  # three groups before
    monkeypatch.setattr(language_crf, "CELLS", 0)
    one = language_crf.shares(texts, model, 300)
    assert len(calls) == 257
    assert all(np.allclose(a[0], b[0]) and a[1] == b[1] for a, b in zip(got, one))


def test_slices_hold_few_long_texts_and_every_row(monkeypatch):
    monkeypatch.setattr(language_crf, "CHARS", 100)
    texts = ["a" * 500, None, "", "é" * 30, "b" * 30, "c" * 20, "d" * 200, "e", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = [b.column(1).to_pylist() for b in language_crf.alike([batch, batch.slice(2, 0), batch.slice(3)])]
    assert [t for p in parts for t in p] == texts + texts[3:]
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 100 for p in parts)
    assert parts[0] == texts[:1]
