"""Target-distribution importance resampling (operator 13).

Features of a text are its runs of 1 to ``longest`` consecutive words, hashed
to ``buckets``. A bucket's gain is the scaled logarithm of how much more often
it occurs in the target texts than in the documents; a document's weight is
the floored mean of its features' gains, scored from an array of all gains.
Gumbel noise drawn from the doc_id turns the weight into a score, and the
``percent`` highest scores of the long enough documents are drawn: sampling
without replacement by importance weight.

The cutoff is found by weighted median-of-medians selection. In each round
every partition gives the median of its remaining keys and their number; the
median of these medians, weighted by the numbers, parts the remaining keys so
that at least a quarter is discarded. Few last keys (``FINISH``) are compared
on the driver. Only the winners are sorted, by range, and ranked from the
sizes of their ranges. Keys (score, doc_id, row) are unique, so exactly the
asked number is drawn, however many scores are equal.

Null text: no words; weight 0, never drawn. Null doc_id: its noise is that of
the empty id, and it comes last among equal scores. Rows repeated in id and
text are documents of their own; which of them comes first is not defined.
An empty target gives every bucket a gain by the documents alone. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import pick, ship, slices, written
from ledgerloom.llm.plain_words import plain_words

ship(__name__)

BUCKETS = 10_000
LONGEST = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Keys whose median one block of a partition gives, and the number left that the driver finishes.
BLOCK_KEYS = 1 << 20
FINISH = 4096
#: Rows handled at once.
SLICE = 128
#: Remaining keys are written anew once they are so many times fewer than those last written.
REWRITE = 8

FOUND = "doc_id bigint, row bigint, n_words bigint, features binary"
SCORED = "doc_id bigint, row bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
KEY = ["low", "no_id", "id", "row"]
MEDIANS = "side int, n bigint, low bigint, no_id bigint, id bigint, row bigint"


def hashed_runs(words: list[bytes], longest: int = LONGEST) -> list[int]:
    """crc32 of every run of 1 to ``longest`` words, joined by a space."""
    spaced = [b" " + w for w in words]
    ends = list(map(crc32, words))
    out = list(ends)
    for k in range(1, longest):
        ends = list(map(crc32, spaced[k:], ends))
        out += ends
    return out


def width(buckets: int) -> type:
    """The smallest number type that holds a bucket."""
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def found_features(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """Rows of ``docs`` with the number of words and the buckets of all features, 16 or 32 bits each."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        kind = width(buckets)
        for b in slices(batches, SLICE):
            n, out = [], []
            for raw in b.column(2).to_pylist():
                words = plain_words(raw)
                n.append(len(words))
                out.append((np.array(hashed_runs(words, longest), np.uint32) % buckets).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                                             ["doc_id", "row", "n_words", "features"])

    return rows.mapInArrow(run, FOUND)


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All features of a batch, and where each row's begin and end."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    own = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return own.view(kind), (at - at[0]) // np.dtype(kind).itemsize


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: counted by partition, summed by bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, SLICE):
            total += np.bincount(flat(b.column(0), width(buckets))[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("features").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled logarithm of target against source frequency, each bucket counted once more."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    held = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        kind = width(len(held.value))
        for b in slices(batches, SLICE):
            features, at = flat(b.column(3), kind)
            total = np.concatenate([[0], np.cumsum(held.value[features])])
            n = np.diff(at).astype(np.int64)
            weight = (total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1)
            own = np.fromiter((noise(i, seed) for i in b.column(0).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n), pa.array(weight), pa.array(weight + own)],
                                             ["doc_id", "row", "n_words", "n_features", "weight", "score"])

    return found.mapInArrow(run, SCORED)


def with_key(rows: DataFrame) -> DataFrame:
    """Rows with the columns of their unique key: the smallest key is drawn first."""
    return rows.withColumns({"low": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("bigint"), "id": F.coalesce("doc_id", F.lit(0))})


def key_struct(values: tuple | None = None) -> Column:
    return F.struct(*(KEY if values is None else [F.lit(v).cast("bigint").alias(c) for c, v in zip(KEY, values)]))


def medians(keys: DataFrame, pivot: tuple | None) -> list:
    """(side, number, median) of the keys on either side of the pivot, by blocks of each partition."""
    def middle(parts, side):
        cols = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort(cols[::-1])
        at = order[(len(order) - 1) // 2]
        return [side, len(order), *(int(c[at]) for c in cols)]

    def run(batches):
        out, held = [], ([], [])
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            above = np.ones(b.num_rows, bool)
            if pivot is not None:
                above[:] = False
                same = np.ones(b.num_rows, bool)
                for c, v in zip(cols, pivot):
                    above |= same & (c > v)
                    same &= c == v
                below = ~(above | same)
            else:
                below = ~above
            for side, mask in enumerate((below, above)):
                if mask.any():
                    held[side].append([c[mask] for c in cols])
                    if sum(len(p[0]) for p in held[side]) >= BLOCK_KEYS:
                        out.append(middle(held[side], side))
                        held[side].clear()
        out += [middle(parts, side) for side, parts in enumerate(held) if parts]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] + [pa.int64()] * 5)],
                                             ["side", "n", *KEY])

    return [tuple(r) for r in keys.select(*KEY).mapInArrow(run, MEDIANS).collect()]


def weighted_median(found: list[tuple]) -> tuple:
    """The key at which half of the numbers is reached."""
    found = sorted(found, key=lambda r: r[2:])
    left = sum(r[1] for r in found) / 2
    for r in found:
        left -= r[1]
        if left <= 0:
            return r[2:]


def cutoff(keys: DataFrame, rank: int, finish: int = FINISH) -> tuple | None:
    """The ``rank``-th smallest key (from 1), or None if there are fewer."""
    found, rounds = medians(keys, None), 0
    left = sum(r[1] for r in found)
    if not 1 <= rank <= left:
        return None
    low, high, held = None, None, left
    while left > finish:
        pivot = weighted_median(found)
        sides = medians(keys, pivot)
        below = sum(r[1] for r in sides if r[0] == 0)
        if rank == below + 1:
            return pivot
        if rank <= below:
            high, left, found = pivot, below, [r for r in sides if r[0] == 0]
            keys = keys.where(key_struct() < key_struct(high))
        else:
            low, rank, found = pivot, rank - below - 1, [r for r in sides if r[0] == 1]
            left = sum(r[1] for r in found)
            keys = keys.where(key_struct() > key_struct(low))
        if left * REWRITE <= held:
            keys, held = written(keys.select(*KEY), "resample-keys"), left
    return sorted(tuple(r) for r in keys.select(*KEY).collect())[rank - 1]


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
         buckets: int = BUCKETS, longest: int = LONGEST, finish: int = FINISH) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs`` (doc_id, text).

    ``target`` (text) holds the texts whose distribution is aimed at.
    """
    found = written(found_features(docs, buckets, longest), "resample-features")
    aim = found_features(pick(target, "text").select(F.lit(None).cast("bigint").alias("doc_id"), "text"), buckets, longest)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets))
    rows = with_key(written(scored(found, gain, seed), "resample-scores"))
    able = rows.where(F.col("n_words") >= min_words)
    last = cutoff(able.select(*KEY), percent * able.count() // 100, finish)
    result = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*result, F.lit(None).cast("bigint").alias("rank"))
    wins = (F.col("n_words") >= min_words) & (key_struct() <= key_struct(last))
    # a winner's rank: the sizes of the ranges before its own, and its place there
    winners = written(rows.where(wins).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
                      .select(*result, F.monotonically_increasing_id().alias("place")), "resample-winners")
    ranges = winners.groupBy(F.shiftright("place", 33).alias("range")).count().collect()
    before, so_far = [], 0
    for r in sorted(ranges, key=lambda r: r["range"]):
        before.append((r["range"], so_far))
        so_far += r["count"]
    # one row a range, so it is as small as the list of the stage's tasks
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "range bigint, before bigint"))
    ranked = winners.withColumn("range", F.shiftright("place", 33)).join(offsets, "range").select(
        *result, (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))
    return ranked.union(rows.where(~wins).select(*result, F.lit(None).cast("bigint").alias("rank")))
