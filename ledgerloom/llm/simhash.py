"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 4).

Fingerprint: 64 bits over the hashes of the 3-word shingles of the
lower-cased text. Two fingerprints are linked when at most 3 bits differ;
linked documents, also over several steps, form a component.

Candidate keys. The fingerprint is cut into segments of 22, 21 and 21 bits,
each read as a word of the perfect binary Golay code [23,12,7] (upper bits
zero). ``near`` is the index of the one codeword within distance 3 of a
segment; ``ball`` are the indices that the segment and all its one-bit
neighbours decode to (1 to 6 of them). If two segments differ in at most one
bit, the ``near`` of one lies in the ``ball`` of the other. Three wrong bits
leave, by the pigeonhole principle, either a segment without errors beside
one with at most one, or one error in each segment. So a fingerprint *asks*
with (segment i, near j) for the six ordered pairs and with (near 0, near 1),
7 keys, and *answers* with (segment i, ball j) and (ball 0, ball 1), about
60 keys. Every pair within 3 bits meets in some key; the distance is then
checked. Distances other than 3 need another split, so they are refused.

Copies share a fingerprint and are one node. Keys are counted first, with
partial sums; a key's askers and answerers are then cut into blocks of
``BLOCK`` and each pair of blocks is compared on its own. The counts join the
rows by a shuffle that Spark splits where a key is hot, so no key meets in
one task. A task returns a
spanning forest of the links it found, never all pairs. Components are found
by alternating large-star and small-star rounds over the forests, each round
written to the shared folder.

Null text counts as empty: no words, fingerprint zero, linked like any other.
Repeated rows get a row each. A null doc_id takes part in links but is never
a component's id; a component of null ids only has a null id. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import pick, ship, slices, worker_state, written

ship(__name__)

SHINGLE, BITS, SEED = 3, 3, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BLOCK = 2048
#: Nodes a task's spanning forest remembers.
FOREST = 2_000_000
#: Generator polynomial of the Golay code (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0xC75


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    # bytes.lower() and bytes.split() know A-Z and the six white-space bytes only, as the definition asks
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.array([xxhash.xxh64_intdigest(p, seed) for p in parts], dtype="<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        set_bits += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, carry: str | None = None) -> DataFrame:
    """doc_id, the string column ``carry`` if one is named, and fp (the 64 bits as a signed long)."""
    key = [carry] if carry else []

    def run(batches):
        for b in slices(batches, 256):
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fp.view(np.int64))], ["doc_id", *key, "fp"])

    return pick(docs, "doc_id", "text", *key).mapInArrow(run, ", ".join(["doc_id bigint", *(f"`{k}` string" for k in key), "fp bigint"]))


# ------------------------------------------------------------------ Golay keys

def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r ^= ((r >> bit) & 1) * (GENERATOR << (bit - 11))
    return r


def error_table() -> np.ndarray:
    """The error of weight at most 3 for each of the 2^11 syndromes."""
    one = 1 << np.arange(23)
    errors = [0, *one.tolist()]
    errors += [a | b for i, a in enumerate(one.tolist()) for b in one.tolist()[:i]]
    errors += [a | b | c for i, a in enumerate(one.tolist()) for j, b in enumerate(one.tolist()[:i]) for c in one.tolist()[:j]]
    table = np.full(1 << 11, -1, np.int64)
    table[syndromes(np.array(errors))] = errors
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each word."""
    held = worker_state("golay")
    if "errors" not in held:
        held["errors"] = error_table()
    return (words ^ held["errors"][syndromes(words)]) >> 11


def ball(words: np.ndarray, bits: int) -> np.ndarray:
    """Distinct indices near each word, one row a word, padded with -1."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    idx = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    idx[:, 1:][idx[:, 1:] == idx[:, :-1]] = -1
    out = -np.sort(-idx, axis=1)
    return out[:, :max(1, int((out >= 0).sum(1).max(initial=1)))]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, asks, row) of all fingerprints (unsigned)."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [decode(s) for s in seg]
    balls = [ball(s, n) for s, (_, n) in zip(seg, SEGMENTS)]
    rows = np.arange(len(fps))
    key, asks, row = [], [], []

    def add(values, asking):
        values = values.reshape(len(fps), -1)
        ok = values >= 0
        key.append(values[ok])
        row.append(np.broadcast_to(rows[:, None], values.shape)[ok])
        asks.append(np.full(len(key[-1]), asking))

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add(kind << 40 | seg[i] << 12 | near[j], True)
                add(np.where(balls[j] >= 0, kind << 40 | seg[i][:, None] << 12 | balls[j], -1), False)
                kind += 1
    add(kind << 40 | near[0] << 12 | near[1], True)
    both = np.where((balls[0][:, :, None] >= 0) & (balls[1][:, None, :] >= 0),
                    kind << 40 | balls[0][:, :, None] << 12 | balls[1][:, None, :], -1)
    add(both, False)
    return np.concatenate(key), np.concatenate(asks), np.concatenate(row)


# ----------------------------------------------------------------------- links

class Forest:
    """Union-find over fingerprints; ``join`` tells whether the link was new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links(fps: DataFrame, most: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs within ``most`` bits."""
    if most != BITS:
        raise ValueError("the segments are made for a distance of 3 bits")

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                fp = b.column(0).slice(at, 2048).to_numpy()
                key, asks, row = keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(asks), pa.array(fp[row])], ["key", "asks", "fp"])

    def compare(batches):
        """Rows come sorted by (key, bi, bj, asks): the answerers of a cell, then its askers."""
        forest, held = Forest(), None

        def close(cell):
            ans, out = np.concatenate(cell[1]), []
            group = np.arange(len(ans))  # answerers that links already tie together share a number
            for a in np.concatenate(cell[2]):
                hit = np.flatnonzero(np.bitwise_count(ans ^ a) <= most)
                if len(hit) > 1:
                    tied, first = np.unique(group[hit], return_index=True)
                    if len(tied) > 1:
                        group[np.isin(group, tied)] = tied[0]
                    hit = hit[first]
                a = int(a)
                out += [(a, b) for b in ans[hit].tolist() if b != a and forest.join(a, b)]
            return out

        for b in batches:
            k = np.stack([b.column(i).to_numpy() for i in (0, 1, 2)])
            asks, fp = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
            out = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if lo == hi:
                    continue
                cell = tuple(k[:, lo].tolist())
                mine = asks[lo:hi]
                if held is not None and held[0] != cell:
                    out += close(held)
                    held = None
                if held is None and len(forest.up) > FOREST:
                    forest = Forest()  # what it forgets may be linked once more
                held = held or (cell, [], [])
                held[1].append(fp[lo:hi][~mine])
                held[2].append(fp[lo:hi][mine])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*out)], ["a", "b"])
        if held is not None and (out := close(held)):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*out)], ["a", "b"])

    # a key may be hot: keys are counted with partial sums, and the join on them is one that AQE may split; Spark takes the
    # keys for as small as the fingerprints they are made of, so it is told not to broadcast them
    # a fingerprint is few bytes but becomes some 70 rows, so the tasks are not put together by its size
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp").repartition(tasks).mapInArrow(spread, "key bigint, asks boolean, fp bigint")
    sizes = (rows.groupBy("key").agg(F.count(F.when(F.col("asks"), 1)).alias("n_ask"), F.count(F.when(~F.col("asks"), 1)).alias("n_ans"),
                                     F.min("fp").alias("lo"), F.max("fp").alias("hi"))
             .where("n_ask > 0 and n_ans > 0 and lo < hi").drop("lo", "hi"))
    cut = lambda n: F.ceil(F.col(n) / block)
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("asks"), cut("n_ask")).otherwise(cut("n_ans")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("asks"), cut("n_ans")).otherwise(cut("n_ask")) - 1))
    cells = (rows.hint("merge").join(sizes, "key").select("key", "asks", "fp", own.alias("own"), others.alias("other"))
             .select("key", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("bi"),
                     F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("bj"), "asks", "fp"))
    return (cells.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "asks")
            .mapInArrow(compare, "a bigint, b bigint"))


# ------------------------------------------------------------------ components

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node it reaches.

    Alternating rounds: large-star ties each node's larger neighbours to its
    smallest one, small-star its smaller neighbours and itself. A round costs
    two aggregations and two joins; the number of rounds grows with the
    logarithm of the longest path. Ends when a round changes nothing.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        # large-star
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        # small-star
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = small.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:  # a round changed nothing: every node hangs on its root
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                small.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        edges, before = small, now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = BITS, seed: int = SEED, carry: str | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text).

    With ``carry`` also that string column of the row, and ``root``, which tells
    components apart whose ids are null or repeated.
    """
    prints = written(fingerprints(docs, shingle, seed, carry), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = written(components(links(nodes, most)), "components")
    labelled = nodes.hint("merge").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = labelled.hint("merge").join(least, "root").select("fp", "component_id", "root")
    # a row for every document: as a file they may be far smaller than in the driver's memory
    return prints.hint("merge").join(classes, "fp").select("doc_id", "fp", "component_id", *([carry, "root"] if carry else []))
