"""Ranked lexical search by a document FP-tree (operator 12).

Items (queries) are answered over all documents, in blocks of at most about
``BLOCK_BYTES`` of item text, so a task's memory depends on neither table. For
a block:

1. every document is reduced to its terms that some item asks for (with their
   tf) and its length; N, L and df are exact sums over all documents;
2. terms are ordered by falling df. Each task cuts its restricted vectors into
   trees of at most ``TREE_DOCS`` documents: vectors sorted by that order are
   the paths of a trie in depth-first order, so a subtree is an interval and
   shares its prefix. Intervals of at most ``LEAF_DOCS`` documents are leaves;
   neighbouring small subtrees share one;
3. every node keeps, for each term below it, the largest tf and, over its
   documents, the smallest m. As a term's score rises with tf and falls with m,
   these give an upper bound of any score below the node. An item goes down
   depth first, the best child first, and leaves out each subtree whose bound
   cannot beat its ``top``-th document so far, which is carried on from tree
   to tree;
4. the tasks' best documents are merged in two steps, the first by item and a
   salt of the task, so no task reads more than a share of an item's rows.

The bound is never below a true score, so the result is exact. Documents with
equal vectors lie side by side by ascending doc_id; a subtree that could only
tie with the last place is left out if its smallest doc_id comes later.

Null text: no terms; such a document counts neither in N nor in L. Null
doc_id: last among equal scores. Rows repeated in doc_id and text are
documents of their own. Items are taken by row: a null or repeated item_id
gives each of its rows a ranking of its own. An item without a term that
occurs gives no rows, and so do empty tables.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import pick, ship, slices, written
from ledgerloom.llm.plain_words import plain_words

ship(__name__)

TOP = 50
BLOCK_BYTES = 2 << 20
TREE_DOCS = 4096
TREE_TERMS = 1 << 20
LEAF_DOCS = 32
SALTS = 32

RESTRICTED = "doc_id bigint, row bigint, n bigint, terms binary, tfs binary"
BEST = "item long, doc_id bigint, row bigint, score bigint"


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def restrict(docs: DataFrame, vocabulary) -> DataFrame:
    """Every document with its length and its terms of the vocabulary (a broadcast dict: term to number)."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        known = vocabulary.value
        for b in slices(batches, 256):
            n, terms, tfs = [], [], []
            for raw in b.column(2).to_pylist():
                words = plain_words(raw)
                n.append(len(words))
                own = Counter(words)
                held = own.keys() & known.keys()
                terms.append(np.array([known[w] for w in held], np.uint32).tobytes())
                tfs.append(np.array([own[w] for w in held], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(terms, pa.binary()),
                                              pa.array(tfs, pa.binary())], ["doc_id", "row", "n", "terms", "tfs"])

    return rows.mapInArrow(run, RESTRICTED)


def document_frequencies(restricted: DataFrame, n_terms: int) -> np.ndarray:
    def count(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total[np.frombuffer(raw, np.uint32)] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    # at most one row for each term of the block
    for r in restricted.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


class Tree:
    """A trie over restricted vectors: documents in path order, nodes as intervals of them.

    ``docs`` holds (path, tfs, m, order) per document: terms as places in the
    order by falling df, and (no id, id, row), by which equal scores are ranked.
    """

    def __init__(self, docs: list[tuple], leaf_docs: int = LEAF_DOCS):
        # bytes of big-endian numbers sort like the paths themselves
        named = [(path.astype(">u4").tobytes(), order, i) for i, (path, _, _, order) in enumerate(docs)]
        named.sort()
        self.docs = [docs[i] for _, _, i in named]
        self.shared = [0] + [self._prefix(a[0], b[0]) for a, b in zip(named, named[1:])]
        self.leaf_docs = leaf_docs
        self.nodes: list[tuple] = []
        self.root = self._build() if docs else None

    @staticmethod
    def _prefix(a: bytes, b: bytes) -> int:
        """Terms that two paths share from the root on."""
        n = min(len(a), len(b)) // 4
        differ = np.frombuffer(a, np.uint32, n) != np.frombuffer(b, np.uint32, n)
        at = int(differ.argmax()) if n else 0
        return at if n and differ[at] else n

    def _parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Children of the node over documents a to b: cut where they share least, small neighbours put together."""
        inner = self.shared[a + 1:b]
        depth = min(inner)
        cuts = [a, *(a + 1 + i for i, s in enumerate(inner) if s == depth), b]
        out: list[tuple[int, int]] = []
        for x, y in zip(cuts, cuts[1:]):
            if out and y - out[-1][0] <= self.leaf_docs:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
        return out

    def _leaf(self, a: int, b: int) -> int:
        own = self.docs[a:b]
        sizes = [len(d[0]) for d in own]
        terms = np.concatenate([d[0] for d in own])
        tf = np.concatenate([d[1] for d in own])
        m = np.array([d[2] for d in own], np.int64)
        gains = gain(tf, np.repeat(m, sizes))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(terms, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], terms[order][1:] != terms[order][:-1]])) if len(terms) else np.zeros(0, np.int64)
        best_tf = np.maximum.reduceat(tf[order], cut) if len(terms) else tf
        return self._node(terms[order][cut], best_tf, int(m.min()), min(d[3] for d in own),
                          None, (terms, gains, starts, [d[3] for d in own]))

    def _node(self, terms, tf, m, first, children, documents) -> int:
        self.nodes.append((terms, tf, m, gain(tf, np.int64(m)), first, children, documents))
        return len(self.nodes) - 1

    def _join(self, children: list[int]) -> int:
        """The node above: largest tf of each term and smallest m of its children."""
        own = [self.nodes[c] for c in children]
        terms = np.concatenate([n[0] for n in own])
        tf = np.concatenate([n[1] for n in own])
        order = np.argsort(terms, kind="stable")
        terms, tf = terms[order], tf[order]
        cut = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        return self._node(terms[cut], np.maximum.reduceat(tf, cut) if len(terms) else tf, min(n[2] for n in own),
                          min(n[4] for n in own), children, None)

    def _build(self) -> int:
        """Depth first with a stack of its own: a trie may be as deep as a vector is long."""
        work: list[list] = [[[(0, len(self.docs))], []]]
        while True:
            todo, done = work[-1]
            if todo:
                a, b = todo.pop(0)
                if b - a <= self.leaf_docs:
                    done.append(self._leaf(a, b))
                else:
                    work.append([self._parts(a, b), []])
                continue
            work.pop()
            if not work:
                return done[0]
            work[-1][1].append(self._join(done))

    def search(self, weights: np.ndarray, best: list, top: int) -> int:
        """Put the item's best documents into the heap ``best``; the number of leaves looked into.

        ``weights`` has the item's weight at each of its terms, else 0. The
        heap's entries are (score, -no id, -id, -row): the worst comes first.
        """
        def bound(n):
            terms, _, _, most, first, _, _ = self.nodes[n]
            return (int(weights[terms] @ most), *(-x for x in first), n)

        looked, stack = 0, [bound(self.root)]
        while stack:
            at = stack.pop()
            if at[0] <= 0 or (len(best) >= top and at[:4] < best[0]):
                continue
            _, _, _, _, _, children, documents = self.nodes[at[4]]
            if children is not None:
                stack += sorted(map(bound, children))
                continue
            looked += 1
            terms, gains, starts, orders = documents
            total = np.concatenate([[0], np.cumsum(weights[terms] * gains)])
            scores = total[starts[1:]] - total[starts[:-1]]
            for i in np.flatnonzero(scores >= max(best[0][0] if len(best) >= top else 1, 1)).tolist():
                entry = (int(scores[i]), *(-x for x in orders[i]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return looked


def trees(batches, place: np.ndarray, n_docs: int, length: int, tree_docs: int, tree_terms: int):
    """Trees over a task's restricted documents; ``place`` has a term's place in the order by falling df."""
    held, terms = [], 0
    for b in batches:
        for doc_id, row, n, raw, raw_tf in zip(*(c.to_pylist() for c in b.columns)):
            if not raw:
                continue
            path = place[np.frombuffer(raw, np.uint32)]
            order = np.argsort(path)
            # Python's numbers: n * N may pass 64 bits
            m = 50 + 50 * n * n_docs // length
            held.append((path[order], np.frombuffer(raw_tf, np.uint32)[order].astype(np.int64), m, (doc_id is None, doc_id or 0, row)))
            terms += len(path)
            if len(held) >= tree_docs or terms >= tree_terms:
                yield Tree(held)
                held, terms = [], 0
    if held:
        yield Tree(held)


def block_search(docs: DataFrame, items: list, top: int, tree_docs: int, tree_terms: int) -> DataFrame | None:
    """The best documents of each task for a block of items: (row of the item, set of its terms)."""
    context = docs.sparkSession.sparkContext
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*(words for _, words in items))))}
    restricted = written(restrict(docs, context.broadcast(vocabulary)), "search-vectors")
    totals = restricted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    if not totals.docs:
        return None
    n_docs, length = totals.docs, totals.length
    df = document_frequencies(restricted, len(vocabulary))
    by_df = np.lexsort((np.arange(len(df)), -df))
    place = np.empty(len(df), np.int64)
    place[by_df] = np.arange(len(df))
    weights = np.array([weight(int(df[t]), n_docs) for t in by_df], np.int64)
    asked = [(row, np.sort(place[[vocabulary[w] for w in words if df[vocabulary[w]]]]).astype(np.int64)) for row, words in items]
    model = context.broadcast((place, weights, [(row, t) for row, t in asked if len(t)]))

    def run(batches):
        place, weights, asked = model.value
        best = [[] for _ in asked]
        own = np.zeros(len(weights), np.int64)
        for tree in trees(batches, place, n_docs, length, tree_docs, tree_terms):
            for (_, terms), heap in zip(asked, best):
                own[terms] = weights[terms]
                tree.search(own, heap, top)
                own[terms] = 0
        for (row, _), heap in zip(asked, best):
            if heap:
                score, no_id, i, at = zip(*heap)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(heap), pa.int64()), pa.array([None if x else -k for x, k in zip(no_id, i)], pa.int64()),
                     pa.array([-x for x in at], pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "row", "score"])

    return restricted.mapInArrow(run, BEST)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES,
           tree_docs: int = TREE_DOCS, tree_terms: int = TREE_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    docs = pick(docs, "doc_id", "text")
    items = written(pick(items, "item_id", "text").select("item_id", F.monotonically_increasing_id().alias("item"),
                                                          F.col("text").cast("binary").alias("text")), "search-items")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    best = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "text").collect()
        block = [(r["item"], set(plain_words(r["text"]))) for r in rows]
        found = block_search(docs, block, top, tree_docs, tree_terms) if any(words for _, words in block) else None
        if found is not None:
            found = written(found, "search-best")
            best = found if best is None else best.union(found)
    if best is None:
        best = docs.sparkSession.createDataFrame([], BEST)
    order = [F.desc("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")]
    salted = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
