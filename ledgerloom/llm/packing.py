"""Packing into sequences (operator 10).

Documents (their ids and an end id) are cut into pieces of at most
``length`` ids. Pieces are dealt to groups at random (by a hash of the row's
place in the input and the piece's in the document, so long documents and
repeated rows spread over all groups), and every group is packed on its own by
first-fit decreasing: a tournament tree over the free space of the bins finds
the first bin that has room. Groups are as many as the texts' bytes ask for,
``group_bytes`` each, and a text has at most as many ids as bytes, so a group
grows neither with the data nor with the length of documents; a task holds one
group at a time and reads about ``TASK_GROUPS``. Open space remains in the last bins of a group only;
it is padding.

Output: one row per sequence: sequence_id (group and bin), ids (binary,
little-endian unsigned 32 bit, without padding) and its pieces in order
(doc_id, start, length, doc_tokens, offset). ``padded_length`` is the length
after padding: ``length``, or the used one where it is a power of two.

Null text: the end id only. Rows repeated in id and text are packed each on
their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import pick, ship, slices
from ledgerloom.llm.tokens import Pieces, pieces

ship(__name__)

LENGTH = 2048
GROUP_BYTES = 3 << 20
SEED = 20_240
#: Pre-tokens a worker remembers; fewer than for files, as the executor holds the groups too.
REMEMBERED = 200_000
#: Groups that one task packs, one after the other, once there are enough of them for all tasks.
TASK_GROUPS = 32
#: Bins of one group at most; sequence ids are group * GROUP_BINS + bin.
GROUP_BINS = 1 << 28

PIECES = "grp bigint, doc_id bigint, start bigint, length int, doc_tokens bigint, ids binary"
SEQUENCES = ("sequence_id bigint, used int, padded_length int, ids binary, "
             "pieces array<struct<doc_id: bigint, start: bigint, length: int, doc_tokens: bigint, offset: int>>")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size. The tree's leaves are bins, each inner node holds the larger free space below it."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    n = 1
    while n < len(sizes):
        n *= 2
    tree = [capacity] * (2 * n)
    out = [0] * len(sizes)
    for i in order:
        size, k = sizes[i], 1
        while k < n:
            k *= 2
            if tree[k] < size:
                k += 1
        out[i] = k - n
        tree[k] -= size
        k //= 2
        while k:
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
            k //= 2
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Sequences of at most ``length`` ids over ``docs`` (doc_id, text)."""
    docs = pick(docs, "doc_id", "text")
    width = Pieces(tokenizer).width
    # an end id counts like a byte, so empty documents fill groups too
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    docs = docs.withColumn("place", F.monotonically_increasing_id())

    def cut(batches):
        p = pieces(tokenizer, REMEMBERED)
        end = end_id.to_bytes(p.width, "little")
        step = length * p.width
        for b in slices(batches, 256):
            rows = []
            for i, raw, row in zip(b.column(0).to_pylist(), p.encode(b.column(1).to_pylist()), b.column(2).to_pylist()):
                raw += end
                for k in range(0, len(raw), step):
                    part = raw[k:k + step]
                    g = xxhash.xxh64_intdigest(b"%d %d" % (row, k), SEED) % groups
                    rows.append((g, i, k // p.width, len(part) // p.width, len(raw) // p.width, part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                ["grp", "doc_id", "start", "length", "doc_tokens", "ids"])

    def fill(batch: pa.Table) -> pa.Table:
        t = batch.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")]).combine_chunks()
        sizes = t["length"].to_numpy()
        bins = np.array(first_fit_decreasing(sizes.tolist(), length))
        order = np.argsort(bins, kind="stable")
        bins, sizes, t = bins[order], sizes[order], t.take(pa.array(order))
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        total = np.concatenate([[0], np.cumsum(sizes)])
        used = np.add.reduceat(sizes, first)
        offset = total[:-1] - np.repeat(total[first], np.diff([*first, len(sizes)]))
        ids, cuts = t["ids"].to_pylist(), [*first.tolist(), len(sizes)]
        raw = [np.frombuffer(b"".join(ids[i:j]), "<u2" if width == 2 else "<u4").astype("<u4").tobytes() for i, j in zip(cuts, cuts[1:])]
        own = pa.StructArray.from_arrays(
            [t["doc_id"].combine_chunks(), t["start"].combine_chunks(), pa.array(sizes.astype(np.int32)), t["doc_tokens"].combine_chunks(),
             pa.array(offset.astype(np.int32))], ["doc_id", "start", "length", "doc_tokens", "offset"])
        return pa.table({
            "sequence_id": pa.array(t["grp"][0].as_py() * GROUP_BINS + bins[first].astype(np.int64)),
            "used": pa.array(used.astype(np.int32)),
            "padded_length": pa.array(np.where(used & (used - 1) == 0, used, length).astype(np.int32)),
            "ids": pa.array(raw, pa.binary()), "pieces": pa.ListArray.from_arrays(pa.array(np.array(cuts, np.int32)), own)})

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // TASK_GROUPS)
    return docs.mapInArrow(cut, PIECES).repartition(tasks, "grp").groupBy("grp").applyInArrow(fill, SEQUENCES)


def piece_digests(sequences: DataFrame) -> DataFrame:
    """One row per piece, with the crc32 of its ids as they lie in the sequence."""
    def crc(batches):
        for b in batches:
            own = b.column(2)
            cuts = own.offsets.to_numpy()
            flat = own.values.slice(cuts[0], cuts[-1] - cuts[0])
            col = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            offset, size = col["offset"].to_numpy(), col["length"].to_numpy()
            seq = np.repeat(np.arange(b.num_rows), np.diff(cuts))
            raw = b.column(1).to_pylist()
            sums = [zlib.crc32(raw[k][4 * i:4 * (i + n)]) for k, i, n in zip(seq.tolist(), offset.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], col["start"], pa.array(size.astype(np.int64)), pa.array(sums, pa.int64()), col["doc_tokens"],
                 b.column(0).take(pa.array(seq)), pa.array(offset.astype(np.int64))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return sequences.select("sequence_id", "ids", "pieces").mapInArrow(
        crc, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
