"""Token counts without materialised ids (operator 1).

Pieces are counted once per distinct pre-token and joined to the pre-token
frequencies of every document:

* pre-tokens that are frequent in a bounded sample (``SAMPLE_DOCS``) are
  counted once, collected (at most ``FREQUENT`` entries, each of at most
  ``KEY_BYTES`` bytes, longer ones by digest) and broadcast. The sample only
  decides which way a pre-token is joined, never a count;
* all others are shuffled as (pre-token, document, frequency), counted once
  where equal ones meet, and summed by document. Sums combine map-side.

Null text: empty, 0 tokens. Repeated rows: each gets its own result row. Null
doc_id: kept as it is. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import pick, ship
from ledgerloom.llm.tokens import pieces

ship(__name__)

SAMPLE_DOCS = 20_000
FREQUENT = 1 << 18
KEY_BYTES = 64

ROWS = "token string, doc_id bigint, text_hash bigint, text_hash2 bigint, n bigint, n_bytes bigint"


def _key(token: str) -> str | bytes:
    """The pre-token, or the digest of a long one."""
    raw = token.encode()
    return token if len(raw) <= KEY_BYTES else hashlib.blake2b(raw, digest_size=16).digest()


def frequent_counts(docs: DataFrame, path: str) -> dict[str | bytes, int]:
    """Piece counts of the pre-tokens seen twice or more in the sample, the most frequent first."""
    total = docs.count()
    every = max(1, total // SAMPLE_DOCS)
    # by place, so rows that share an id or a text are not taken or left together
    sample = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0).select("text")

    def count(batches):
        p = pieces(path)
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(p.pre_tokens(text or ""))
            if len(seen) > 4 * FREQUENT:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    def label(batches):
        p = pieces(path)
        for b in batches:
            toks = b.column(0).to_pylist()
            keys = list(map(_key, toks))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k if isinstance(k, str) else None for k in keys], pa.string()),
                 pa.array([k if isinstance(k, bytes) else None for k in keys], pa.binary()),
                 pa.array(p.counts(toks), pa.int64())], ["key", "digest", "pieces"])

    seen = sample.mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    seen = seen.cache()
    try:
        left, least = FREQUENT, 2
        for row in seen.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            left -= row["count"]
            if left < 0:
                least = row["n"] + 1
                break
        rows = seen.where(F.col("n") >= least).select("token").mapInArrow(label, "key string, digest binary, pieces bigint").collect()
    finally:
        seen.unpersist()
    return {r.key if r.key is not None else bytes(r.digest): r.pieces for r in rows}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs`` (doc_id, text)."""
    docs = pick(docs, "doc_id", "text")
    known = docs.sparkSession.sparkContext.broadcast(frequent_counts(docs, path))

    def split(batches):
        p, table, place = pieces(path), known.value, 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(ids), 512):
                token, doc, text_hash, text_hash2, n, n_bytes = [], [], [], [], [], []
                for i, text in zip(ids[at:at + 512], texts[at:at + 512]):
                    raw = (text or "").encode()
                    # 128 bits tell rows of one doc_id apart
                    h, h2 = struct.unpack("<qq", xxhash.xxh3_128_digest(raw))
                    total, rare = 0, []
                    for t, f in Counter(p.pre_tokens(text or "")).items():
                        c = table.get(t)
                        if c is None and len(t) > KEY_BYTES // 4:
                            c = table.get(_key(t))
                        if c is None:
                            rare.append((t, f))
                        else:
                            total += c * f
                    # the document's own row ("d") has no pre-token to count, its key only spreads it:
                    # the number of the row in its task, so equal rows don't meet
                    place += 1
                    token += [f"d{h ^ place}", *("t" + t for t, _ in rare)]
                    n += [total, *(f for _, f in rare)]
                    k = 1 + len(rare)
                    doc += [i] * k
                    text_hash += [h] * k
                    text_hash2 += [h2] * k
                    n_bytes += [len(raw), *[None] * len(rare)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token, pa.string()), pa.array(doc, pa.int64()), pa.array(text_hash, pa.int64()), pa.array(text_hash2, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(n_bytes, pa.int64())], ["token", "doc_id", "text_hash", "text_hash2", "n", "n_bytes"])

    def weigh(batches):
        """Pieces of each run of equal pre-tokens, times the frequency; rows come sorted by pre-token."""
        p, last, pieces_of_last = pieces(path), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            runs = b.column(0).dictionary_encode()
            values = runs.dictionary.to_pylist()
            todo = [v for v in values if v[0] == "t" and v != last]
            got = dict(zip(todo, p.counts([v[1:] for v in todo]))) if todo else {}
            got[last] = pieces_of_last
            each = [got.get(v, 1) for v in values]
            last, pieces_of_last = values[-1], each[-1]
            each = pa.array(each, pa.int64()).take(runs.indices)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pc.multiply(b.column(4), each), b.column(5)],
                                             ["doc_id", "text_hash", "text_hash2", "n", "n_bytes"])

    rows = docs.mapInArrow(split, ROWS).repartition("token").sortWithinPartitions("token")
    sums = (rows.mapInArrow(weigh, "doc_id bigint, text_hash bigint, text_hash2 bigint, n bigint, n_bytes bigint")
            .groupBy("doc_id", "text_hash", "text_hash2")
            .agg(F.sum("n").alias("n"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("copies")))
    # rows repeated in id and text were summed together and come out as often as they went in
    return sums.select("doc_id", "n_bytes", F.expr("n div copies").alias("n_tokens"),
                       F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).drop("_copy")
