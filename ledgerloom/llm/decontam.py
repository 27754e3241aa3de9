"""Benchmark decontamination (operator 6).

Seeds: the word n-grams (``SEED_WORDS``) of the test items. They are broadcast
and met by every n-gram of every training document, in blocks of items with
about ``BROADCAST_SEEDS`` seeds, so a benchmark of any size is covered; each
block is one pass over the documents. Every document with a seed yields, per
place, a *passage*: the words around the seeds of one item that lie on near
diagonals. A task holds one document and hands passages on in small batches.

A passage is a candidate if it holds a rare seed (found in at most
``RARE_SHARE`` of all documents, or in one, counted over the whole corpus) or
at least ``MANY`` different seeds of the item (all, if it has fewer), so a
passage that leaked everywhere, whose seeds are no longer rare, stays a
candidate. Smith-Waterman then aligns item and passage by words (match +2,
mismatch -1, gap -1); a passage whose score reaches ``SHARE`` of the item's own
(2 per word) is a copy, whether exact, edited or paraphrased in part. Passages
with too few words in common for any alignment to reach it are not aligned.

Output: one row per document and item: doc_id, item_id, score (0 to 1), and
the words [first_word, last_word) of the best passage. Several rows that
share a doc_id give one row, the best (ties: the earliest passage). Items are
taken by row: each of several rows with one item_id, or none, gives results of
its own, with that item_id.

Null or empty text or item: no rows. Items with fewer words than a seed use
their whole text as a seed. Null doc_id is kept as null. An empty table on
either side gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import pick, ship, slices, written

ship(__name__)

SEED_WORDS = 3
RARE_SHARE = 0.01
MANY = 2
SHARE = 0.5
BROADCAST_SEEDS = 1_000_000
#: Words beside the seeds that a passage carries, as a share of the item's length.
MARGIN = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1

WORDS = re.compile(r"[^\W_]+")

PASSAGES = "doc_id bigint, row bigint, item bigint, seeds array<bigint>, enough boolean, first int, words array<string>"
PASSAGE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.list_(pa.string()))
PASSAGE_NAMES = ["doc_id", "row", "item", "seeds", "enough", "first", "words"]
#: Items that a task of the alignment remembers in numbers.
ITEMS_MET = 2_000
#: Passages handed on at once.
PASSAGE_ROWS = 2_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def gram_hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest("\0".join(words)) - (1 << 63)


def item_seeds(words: list[str], n: int) -> list[tuple[int, int]]:
    """(hash, place) of each n-gram; a shorter item is one n-gram."""
    if not words:
        return []
    if len(words) < n:
        return [(gram_hash(words), 0)]
    return [(gram_hash(words[i:i + n]), i) for i in range(len(words) - n + 1)]


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score and the passage words [first, last) it covers.

    Rows are computed at once; gaps along a row are a running maximum.
    """
    n = len(passage)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    at = np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        step = np.where(passage == w, MATCH, MISMATCH)
        new, new_start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        diag, up = score[:-1] + step, score[1:] + GAP
        take = np.maximum(diag, up)
        new[1:] = np.maximum(take, 0)
        new_start[1:] = np.where(take > 0, np.where(diag >= up, start[:-1], start[1:]), at[1:])
        # a gap from an earlier column k costs GAP for each step
        lifted = new - GAP * at
        top = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted == top, at, 0))
        gapped = top + GAP * at
        better = gapped > new
        score = np.where(better, gapped, new)
        start = np.where(better, new_start[where], new_start)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k)
    return best


def reachable(item: np.ndarray, n_kinds: int, passage: np.ndarray) -> int:
    """No alignment's score is above this: MATCH for each word that both have, as often as both have it."""
    own = np.bincount(item, minlength=n_kinds)
    return MATCH * int(np.minimum(own, np.bincount(passage[passage >= 0], minlength=n_kinds)).sum())


def seed_counts(items: DataFrame, n: int) -> DataFrame:
    """(item, seeds) of every item row with a word."""
    def run(batches):
        for b in batches:
            kept = [(i, max(1, len(words) - n + 1)) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (words := words_of(text))]
            cols = list(zip(*kept)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "seeds"])

    return items.select("item", "text").mapInArrow(run, "item bigint, seeds bigint")


def gather(n_words: int, hits):
    """Passages of one document from its hits (item, n_words, item place, document place, hash, kinds) by rising document place.

    Hits of an item whose document places lie within one item length of each
    other make one passage, so a passage is at most as long as its run of
    hits plus two margins. Held meanwhile: one open run for each item.
    """
    runs: dict = {}

    def passage(item, run):
        size, first, last, before, seeds, kinds = run
        lo = max(0, first - before - int(MARGIN * size))
        hi = min(n_words, last + size + int(MARGIN * size))
        return item, sorted(seeds), len(seeds) >= min(MANY, kinds), lo, hi

    for item, size, place, at, h, kinds in hits:
        run = runs.get(item)
        if run is not None and at - run[2] > size:
            yield passage(item, run)
            run = None
        if run is None:
            runs[item] = [size, at, at, place, {h}, kinds]
        else:
            run[2] = at
            run[3] = max(run[3], place)
            run[4].add(h)
    for item, run in runs.items():
        yield passage(item, run)


def passages(docs: DataFrame, items: list, n: int) -> DataFrame:
    """Passages of every document (doc_id, row, text, and strings to carry) against the seeds of some items (item, words)."""
    own = docs.columns[3:]
    types, names = PASSAGE_TYPES + (pa.string(),) * len(own), PASSAGE_NAMES + own
    vocabulary = docs.sparkSession.sparkContext.broadcast(_index(items, n))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), types)], names)

    def run(batches):
        table = vocabulary.value
        for b in slices(batches, 256):
            rows = []
            for i, row, text, *key in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(text)
                for k, seeds in table.items():
                    found = [(at, gram) for at, gram in enumerate(zip(*(words[j:] for j in range(k)))) if gram in seeds]
                    if not found:
                        continue
                    hits = ((item, size, place, at, h, kinds) for at, gram in found for item, size, place, h, kinds in seeds[gram])
                    for item, own_seeds, enough, lo, hi in gather(len(words), hits):
                        rows.append((i, row, item, own_seeds, enough, lo, words[lo:hi], *key))
                        if len(rows) >= PASSAGE_ROWS:
                            yield batch(rows)
                            rows = []
            yield batch(rows)

    return docs.mapInArrow(run, ", ".join([PASSAGES, *(f"`{k}` string" for k in own)]))


def _index(items: list, n: int) -> dict:
    """{words in a gram: {gram: [(item, n_words, place, hash, kinds)]}}"""
    out: dict = {}
    for item, words in items:
        if not words:
            continue
        k = min(n, len(words))
        own, seeds = out.setdefault(k, {}), item_seeds(words, n)
        kinds = len({h for h, _ in seeds})
        for h, at in seeds:
            own.setdefault(tuple(words[at:at + k]), []).append((item, len(words), at, h, kinds))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, share: float = SHARE,
                 rare_share: float = RARE_SHARE, broadcast_seeds: int = BROADCAST_SEEDS, carry: str | None = None) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of every copy of an item of ``benchmark`` (item_id, text) in ``docs``.

    With ``carry`` that string column of ``docs`` comes with doc_id and tells rows of one doc_id apart.
    """
    key = [carry] if carry else []
    docs = pick(docs, "doc_id", "text", *key).select("doc_id", F.monotonically_increasing_id().alias("row"), "text", *key)
    items = written(pick(benchmark, "item_id", "text").where("text is not null")
                    .withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = written(seed_counts(items, n), "item-seeds")
    n_seeds, n_items = seeds.agg(F.coalesce(F.sum("seeds"), F.lit(0)), F.count("*")).first()
    blocks = min(n_items, -(-n_seeds // max(1, broadcast_seeds)))
    items = items.join(seeds.select("item"), "item", "left_semi")
    found = None
    for k in range(blocks):
        # about broadcast_seeds seeds: items fall into the blocks by a hash of their row
        block = [(r["item"], words_of(r["text"])) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()]
        own = written(passages(docs, block, n), "passages")
        found = own if found is None else found.union(own)
    if found is None:
        found = written(passages(docs.where("false"), [], n), "passages")
    least = max(1, rare_share * docs.count())
    in_docs = found.select("row", F.explode("seeds").alias("hash")).groupBy("hash").agg(F.count_distinct("row").alias("df"))
    common = in_docs.where(F.col("df") > least).select("hash")
    if blocks <= 1:
        # some of the block's seeds and items: bounded like them
        common, items = F.broadcast(common), F.broadcast(items)
    few = found.where("NOT enough")
    # a passage with fewer seeds needs a rare one
    rare = few.withColumn("seed", F.explode("seeds")).join(common, F.col("seed") == F.col("hash"), "left_anti").drop("seed")
    candidates = found.where("enough").union(rare)
    texts = items.select(F.col("item").alias("i"), "item_id", F.col("text").alias("item_text"))
    pairs = candidates.join(texts, F.col("item") == F.col("i")).select("doc_id", "item", "item_id", "first", "words", "item_text", *key)

    def align(batches):
        # items met of late: (number of each word, the item in numbers)
        met: dict = {}
        for b in batches:
            rows = []
            for i, item_row, item_id, first, words, text, *own in zip(*(c.to_pylist() for c in b.columns)):
                if item_row not in met:
                    if len(met) >= ITEMS_MET:
                        met.clear()
                    item = words_of(text)
                    number = {w: k for k, w in enumerate(item)}
                    met[item_row] = number, np.array([number[w] for w in item])
                number, item = met[item_row]
                passage = np.array([number.get(w, -1) for w in words], np.int64)
                # most passages share too few words to reach the share, however they are aligned
                if reachable(item, len(item), passage) < share * MATCH * len(item):
                    continue
                score, lo, hi = alignment(item, passage)
                if score >= share * MATCH * len(item):
                    rows.append((i, item_row, item_id, score / (MATCH * len(item)), first + lo, first + hi, *own))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), *[pa.string()] * len(key))
            cols = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "item", "item_id", "score", "first_word", "last_word", *key])

    hits = pairs.mapInArrow(align, ", ".join(["doc_id bigint, item bigint, item_id bigint, score double, first_word int, last_word int",
                                              *(f"`{k}` string" for k in key)]))
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"), -F.col("last_word")))
    return hits.groupBy("doc_id", *key, "item", "item_id").agg(best.alias("b")).select("doc_id", *key, "item_id", "b.*")
