"""Quality classifier by nearest-neighbour voting (operator 2).

Features of a text (only the text): hashed lower-case words, hashed word
shapes (letter case, digits, punctuation, repeats of the word before), repeats
of a line, and the order of magnitude of the length. Counts are damped by a
logarithm, weighted by inverse document frequency, and words and shapes are
each scaled to length one. A truncated singular value decomposition of the
reference rows gives the latent space.

References: at most ``PER_CLASS`` labelled documents of each class, the first
by hash of doc_id, fitted on the driver and broadcast (at most
2 * PER_CLASS * RANK numbers, and DIMS * RANK for the projection). Every
document is projected, its cosine with *every* reference is computed exactly,
in blocks, and the ``NEIGHBOURS`` nearest vote for their label, weighted by
similarity. The classes are balanced, so a score is not drawn to the larger
one.

Null text: empty. An empty text has its length feature and is scored like any
other. No labelled rows: score 0.5. One class only: that label. Labels that
are null are not used; several labels of a doc_id count by their mean
(1 from a half on). Repeated rows get a row each. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.llm.common import pick, ship, slices, worker_state

ship(__name__)

PER_CLASS = 1500
RANK = 48
NEIGHBOURS = 25
BLOCK = 512
WORD_DIMS, SHAPE_DIMS = 2048, 1024
DIMS = WORD_DIMS + SHAPE_DIMS
WORD_WEIGHT, SHAPE_WEIGHT = 0.3, 1.0
#: Words whose feature numbers a worker remembers.
REMEMBERED = 60_000


def shape(word: str) -> str:
    """A for capitals, a for small letters, 0 for digits, others as they are; runs of one sign once."""
    out, last = [], ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if k != last:
            out.append(k)
        elif out and k in "Aa" and out[-1] != k + "+":
            out[-1] = k + "+"
        last = k
    return "".join(out)


def slot(text: str, dims: int) -> int:
    return zlib.crc32(text.encode()) % dims


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and damped counts: words first, then shapes."""
    state = worker_state("quality")
    known = state.setdefault("words", {})
    words = (text or "").split()
    found: Counter = Counter()
    for w, n in Counter(words).items():
        f = known.get(w)
        if f is None:
            bare = re.sub(r"\W+", "", w.lower())
            f = (slot(bare, WORD_DIMS), WORD_DIMS + slot(shape(w), SHAPE_DIMS))
            if len(w) <= 64:
                if len(known) > REMEMBERED:
                    known.clear()
                known[w] = f
        found[f[0]] += n
        found[f[1]] += n
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    marks = {"repeat": again, "line": len(lines) - len(set(lines)), f"length{len(words).bit_length()}": 1,
             f"kinds{int(10 * len(set(words)) / len(words)) if words else 10}": 1}
    for k, n in marks.items():
        if n:
            found[WORD_DIMS + slot("\0" + k, SHAPE_DIMS)] += n
    at = np.fromiter(found.keys(), np.int64, len(found))
    return at, np.log1p(np.fromiter(found.values(), np.float64, len(found)))


def weighted(at: np.ndarray, value: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Values with idf, words and shapes each scaled to their weight."""
    v = value * idf[at]
    words = at < WORD_DIMS
    for part, w in ((words, WORD_WEIGHT), (~words, SHAPE_WEIGHT)):
        size = np.sqrt((v[part] ** 2).sum())
        if size:
            v[part] *= w / size
    return v


def latent(found: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space."""
    out = np.zeros((len(found), basis.shape[1]), np.float32)
    for i, (at, value) in enumerate(found):
        out[i] = weighted(at, value, idf).astype(np.float32) @ basis[at]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def references(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list:
    """(features, counts, label) of at most ``per_class`` labelled documents a class."""
    votes = (pick(labels, "doc_id", label).where(f"doc_id is not null and {label} is not null")
             .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
             # a label without a document takes no place in the sample
             .join(pick(docs, "doc_id").distinct(), "doc_id", "left_semi"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = votes.where("y = 1").orderBy(*order).limit(per_class).union(votes.where("y = 0").orderBy(*order).limit(per_class))

    def run(batches):
        for b in batches:
            found = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.list_(pa.int64())),
                 pa.array([f[1] for f in found], pa.list_(pa.float64())), b.column(2)], ["doc_id", "at", "value", "y"])

    # at most 2 * per_class ids: bounded, so the large side is not shuffled
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    rows = rows.mapInArrow(run, "doc_id bigint, at array<bigint>, value array<double>, y int")
    # of rows that share an id one stands for all
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("at", "value", "y")).alias("r")).select("doc_id", "r.*")
    return rows.orderBy("doc_id").collect()


def fit(rows: list, rank: int = RANK, seed: int = 7) -> dict:
    """The latent space of the reference rows (a randomised truncated SVD) and their vectors."""
    found = [(np.array(r.at), np.array(r.value)) for r in rows]
    y = np.array([r.y for r in rows], np.float32)
    df = np.zeros(DIMS)
    for at, _ in found:
        df[at] += 1
    idf = np.log((1 + len(found)) / (1 + df)) + 1
    x = np.zeros((len(found), DIMS), np.float32)
    for i, (at, value) in enumerate(found):
        x[i, at] = weighted(at, value, idf)
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((DIMS, min(rank + 8, len(found), DIMS))).astype(np.float32)
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ vt.T)[:, :rank], dtype=np.float32)
    return {"idf": idf, "basis": basis, "vectors": latent(found, idf, basis), "y": y}


def vote(model: dict, found: list, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of a block of documents: all cosines, then the weighted vote of the nearest."""
    cos = latent(found, model["idf"], model["basis"]) @ model["vectors"].T
    k = min(neighbours, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(cos, near, axis=1)
    # similarities are close to each other at the top; the gap to the farthest voter tells them apart
    weight = np.maximum(sim, 0) ** 8 + 1e-9
    return np.clip((weight * model["y"][near]).sum(1) / weight.sum(1), 0, 1)


def score(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, *carry: str, label: str = "quality",
          per_class: int = PER_CLASS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id and score of every row of ``docs``, and the columns named in ``carry``.

    Learns from ``train_docs`` (doc_id, text) and ``labels`` (doc_id, label).
    """
    docs = pick(docs, "text", "doc_id", *carry)
    kept = docs.drop("text")
    rows = references(train_docs, labels, label, per_class)
    classes = {r.y for r in rows}
    if len(classes) < 2:
        return kept.withColumn("score", F.lit(float(classes.pop()) if classes else 0.5))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches):
        for b in slices(batches, BLOCK):
            s = vote(model.value, [features(t) for t in b.column(0).to_pylist()], neighbours)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s.astype(np.float64))], [*b.schema.names[1:], "score"])

    return docs.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))
