"""Operators 11 to 13: against enumeration, brute force and held-out labels; their SQL is compared by tests/test_oracle.py."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_crf, lexical_search, queries, resampling
from ledgerloom.llm.plain_words import plain_words
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_plain_words():
    for _, text in ODD:
        assert [w.decode() for w in plain_words((text or "").encode())] == words(text)
    assert plain_words(None) == []


# operator 11

def test_messages_by_enumeration():
    rng = np.random.default_rng(1)
    e, steps, first = rng.random((5, 3)), rng.random((3, 3)), rng.random(3)
    want, pairs, total = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
    for y in itertools.product(range(3), repeat=5):
        p = first[y[0]] * math.prod(e[t, y[t]] for t in range(5)) * math.prod(steps[a, b] for a, b in zip(y, y[1:]))
        total += p
        for t in range(5):
            want[t, y[t]] += p
        for a, b in zip(y, y[1:]):
            pairs[a, b] += p
    p, n = language_crf.expected(e[:, None, :], np.ones(5, int), steps, first)
    assert np.allclose(p[:, 0], want / total) and np.allclose(n, pairs / total)


def test_messages_of_unequal_chains_and_blocks():
    rng = np.random.default_rng(2)
    e, steps, first = rng.random((50, 3)), rng.random((3, 3)) + 0.1, rng.random(3)
    chains = [rng.integers(0, 50, n) for n in (40, 7, 7, 1)]
    alone = [language_crf.expected(e[c][:, None, :], np.ones(len(c), int), steps, first)[0][:, 0] for c in chains]
    together, _ = language_crf.expected(e[language_crf.pad(chains)], language_crf.active_at([40, 7, 7, 1]), steps, first)
    for k, (c, p) in enumerate(zip(chains, alone)):
        assert np.allclose(together[:len(c), k], p)
    for block in (1, 3, 13, 40, 100):
        got = np.zeros((40, 3))
        for at, p in language_crf.long_chain(chains[0], e, steps, first, block):
            got[at:at + len(p)] = p
        assert np.allclose(got, alone[0])


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    lexicon = {"haus": 0}
    at, own = language_crf.grams(["a", "haus", "ñu", "haus"], lexicon)
    one, _ = language_crf.grams(["haus"], lexicon)
    for k in (1, 3):
        assert sorted(at[own == k]) == sorted(one)
    assert language_crf.DIMS in one


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op11(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_switched_text_is_labelled_by_word(spark):
    learn = spark.createDataFrame(
        [(f"{a} {b} {c}", lang) for lang, own in (("x", ["abba", "baab", "abab"]), ("y", ["dood", "oddo", "dodo"]))
         for a, b, c in itertools.product(own, repeat=3)] + [(None, "x"), ("dood", None)], "text string, lang string")
    docs = spark.createDataFrame([(1, "abba baab 12 abab, Dood oddo dodo dodo"), (2, "abba"), (3, "²³ 12 !?"), (4, None), (None, "dodo dood")],
                                 "doc_id bigint, text string")
    got = {r.doc_id: r for r in language_crf.identify(docs, learn).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 3, "x"), (3, 4, "y")] and got[1].lang_pred == "y"
    assert [round(s.share, 1) for s in got[1].shares] == [0.4, 0.6]
    assert got[2].lang_pred == "x" and got[None].lang_pred == "y"
    for i in (3, 4):
        assert (got[i].lang_pred, got[i].score, got[i].runs) == ("und", 0.0, [])
    # blocks of three words give the same
    again = {r.doc_id: r for r in language_crf.identify(docs, learn, steps=3).collect()}
    assert again[1].runs == got[1].runs and again[1].score == pytest.approx(got[1].score)


def test_language_of_odd_rows(odd, nothing, spark):
    learn = spark.createDataFrame([("one two three", "en"), ("mot", "fr")], "text string, lang string")
    got = language_crf.identify(odd, learn).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    assert {r.lang_pred for r in got if r.doc_id in (2, 3)} == {"und"}
    assert [r.runs[0].words for r in got if r.doc_id == 7] == [30_000]
    for none in (learn.where("false"), learn.where("lang = 'x'")):
        assert {r.lang_pred for r in language_crf.identify(odd, none).collect()} == {"und"}
    only = language_crf.identify(odd, learn.where("lang = 'en'")).collect()
    assert {r.lang_pred for r in only} == {"en", "und"} and all(r.score == 1 for r in only if r.runs)
    assert language_crf.identify(nothing, learn).count() == 0


def test_the_sample_is_bounded_and_without_copies(spark):
    rows = [("same text again", "en")] * 500 + [(f"text number {'x' * (k + 1)}", "en") for k in range(50)] + [("un mot", "fr")]
    got = language_crf.sample(spark.createDataFrame(rows, "text string, lang string").repartition(5), texts=32)
    assert 20 < len(got) <= 33 and len({tuple(w) for _, w in got}) == len(got)


# operator 12

def ranking(docs, items, top):
    """(item_id, rank, doc_id, score) by scoring every document; ties by doc_id, null last."""
    own = [(i, Counter(words(t)), k) for k, (i, t) in enumerate(docs)]
    n_docs, length = sum(1 for _, c, _ in own if c), sum(sum(c.values()) for _, c, _ in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c, k in own:
            s = 0
            for w in set(words(text)) & c.keys():
                m = 50 + (50 * sum(c.values()) * n_docs) // length
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return Counter(out)


def rows_of(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("tree_docs, leaf_docs, block_bytes", [(4096, 32, 2 << 20), (37, 2, 700)])
def test_search_brute_force(spark, small, monkeypatch, tree_docs, leaf_docs, block_bytes):
    """One tree a task, and many small ones with several blocks of items."""
    monkeypatch.setattr(lexical_search.Tree.__init__, "__defaults__", (leaf_docs,))
    docs = spark.createDataFrame(small * 2 + ODD, "doc_id bigint, text string").repartition(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()][:20]
    items += [(7, "one three"), (7, "one three"), (None, "Word x tail"), (8, None), (9, "!"), (10, "nowhere9999")]
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id bigint, text string"), top=5,
                                tree_docs=tree_docs, block_bytes=block_bytes)
    assert rows_of(got) == ranking(small * 2 + ODD, items, 5)


def test_bounds_leave_leaves_out_but_no_document():
    rng = np.random.default_rng(3)
    docs = []
    for k in range(3000):
        path = np.unique(rng.zipf(1.5, 12) % 300)
        docs.append((path, rng.integers(1, 5, len(path)), int(50 + rng.integers(0, 100)), (k % 10 == 0, 0 if k % 10 == 0 else k // 2, k)))
    tree = lexical_search.Tree(docs)
    leaves = sum(n[6] is not None for n in tree.nodes)
    assert sorted(o for n in tree.nodes if n[6] for o in n[6][3]) == sorted(d[3] for d in docs)
    looked = 0
    for seed in range(10):
        weights = np.zeros(300, np.int64)
        weights[np.random.default_rng(seed).choice(300, 6, replace=False)] = [900, 2000, 3000, 4000, 5000, 6000]
        best = []
        looked += tree.search(weights, best, 10)
        want = []
        for path, tf, m, order in docs:
            s = int((weights[path] * lexical_search.gain(tf, np.int64(m))).sum())
            if s > 0:
                want.append((s, *(-x for x in order)))
        assert sorted(best) == sorted(want)[-10:]
    assert looked < 0.9 * 10 * leaves


def test_a_thousand_copies_are_ranked_by_doc_id(spark):
    docs = spark.createDataFrame([(k, "same words here") for k in range(3000)] + [(None, "same words here"), (5000, "other")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "words"), (2, "other")], "item_id bigint, text string")
    got = lexical_search.search(docs.repartition(4), items, top=50).collect()
    assert sorted((r["rank"], r.doc_id) for r in got if r.item_id == 1) == []  # a term of nearly all documents weighs nothing
    assert [(r["rank"], r.doc_id) for r in got if r.item_id == 2] == [(1, 5000)]
    more = docs.union(spark.createDataFrame([(10_000 + k, f"z{k}") for k in range(3000)], "doc_id bigint, text string"))
    got = lexical_search.search(more.repartition(4), items, top=50).collect()
    assert sorted((r["rank"], r.doc_id) for r in got if r.item_id == 1) == [(k + 1, k) for k in range(50)]


def test_search_of_empty_tables(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert lexical_search.search(nothing, items).collect() == []
    assert lexical_search.search(odd, items.where("false")).collect() == []
    assert lexical_search.search(odd.where("doc_id <= 3"), items).collect() == []


# operator 13

def drawn(docs, target, percent=25, min_words=20, buckets=10_000):
    def features(text):
        w = words(text)
        return w, [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = s.total(), t.total()
    out, able = [], []
    for k, (i, w, f) in enumerate(own):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in f) // max(len(f), 1)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(w) >= min_words:
            able.append((-score, i is None, i or 0, k))
    for r, (_, _, _, k) in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        out[k][4] = r
    return Counter(map(tuple, out))


def test_draw_brute_force(spark, small):
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert Counter(map(tuple, queries.op13(spark, SF_SMALL).collect())) == drawn(small, target)


def test_draw_of_odd_rows(spark, odd, nothing):
    target = spark.createDataFrame([("one two three",), (None,), ("word word",)], "text string")
    got = resampling.draw(odd, target, percent=60, min_words=2)
    assert Counter(map(tuple, got.collect())) == drawn(ODD, ["one two three", None, "word word"], 60, 2)
    assert resampling.draw(nothing, target).collect() == []
    none = resampling.draw(odd, target.where("false"), percent=100, min_words=0)
    assert Counter(map(tuple, none.collect())) == drawn(ODD, [], 100, 0)
    assert all(r["rank"] is None for r in resampling.draw(odd, target, percent=0).collect())


@pytest.mark.parametrize("finish", [1, 50])
def test_cutoff_with_ties(spark, finish):
    rng = np.random.default_rng(5)
    rows = [(None if k % 7 == 0 else int(rng.integers(0, 40)), k, int(rng.integers(0, 6))) for k in range(2000)]
    keys = resampling.with_key(spark.createDataFrame(rows, "doc_id bigint, row bigint, score bigint").repartition(5))
    want = sorted((-s, int(i is None), i or 0, k) for i, k, s in rows)
    for rank in (1, 2, 499, 1000, 1999, 2000):
        assert resampling.cutoff(keys.select(*resampling.KEY), rank, finish) == want[rank - 1]
    assert resampling.cutoff(keys.select(*resampling.KEY), 2001, finish) is None


def test_a_round_discards_a_quarter():
    rng = np.random.default_rng(6)
    for _ in range(50):
        parts = [np.sort(rng.integers(0, 1000, rng.integers(1, 30))) for _ in range(rng.integers(1, 12))]
        found = [(1, len(p), int(p[(len(p) - 1) // 2]), k) for k, p in enumerate(parts)]
        pivot = resampling.weighted_median(found)[0]
        every = np.concatenate(parts)
        assert (every <= pivot).sum() >= len(every) / 4 and (every >= pivot).sum() >= len(every) / 4


def test_ranks_are_those_of_the_scores(spark):
    rows = resampling.draw(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"),
                           spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"), finish=10)
    win = rows.where(F.col("rank").isNotNull()).orderBy("rank").collect()
    assert [r["rank"] for r in win] == list(range(1, len(win) + 1))
    assert [(r.score, -r.doc_id) for r in win] == sorted(((r.score, -r.doc_id) for r in win), reverse=True)
