"""Language identification by a linear-chain conditional random field (operator 11).

The words of a text (runs of letters, lower-cased) form a chain; each has a
language. A word's features are its character n-grams of 1 to ``GRAMS`` signs
with marks at both ends (so prefixes and suffixes are among them), hashed to
``DIMS`` numbers, and its place in a lexicon of words met again in the sample.
Weights of features and transitions between languages are learned together by
maximising the conditional likelihood (Adam, gradients by forward-backward).
As the labels are of whole documents, a share of the training chains is put
together from two languages, which teaches the cost of a switch.

Sample: at most ``TEXTS`` different texts of each label, the first by hash in
each of ``PARTS`` parts, and of each at most ``CHAINS`` chains of ``CHAIN_WORDS`` words spread over the
whole text; at most ``LABELS`` labels, the most frequent. It is fitted on the
driver and the weights, DIMS + LEXICON rows at most, are broadcast.

Prediction covers every word: forward-backward gives each word's probability
of each language; their sums are the languages' shares of the text. The label
is the one with the largest share (ties: the first by name) and the score is
that share. ``runs`` tells where the language changes: each maximal run of
words of one most likely language, as first word, number of words, language.
Texts of any length are covered in blocks of ``STEPS`` words, with memory for
one block and one message a block; short ones together, of about ``CHARS`` bytes.

Null text, or one without a letter: ``und``, score 0, no runs. Null lang: not
learned from. Repeated rows get a row each; repeated texts count once in the
sample. No labelled text: ``und`` for all. One label only: that label. An
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ledgerloom.llm.common import pick, ship, slices

ship(__name__)

TEXTS, CHAINS, CHAIN_WORDS, LABELS = 400, 3, 40, 256
GRAMS, DIMS, LEXICON = 4, 1 << 16, 20_000
ROUNDS, RATE, PENALTY, MIXED = 40, 0.15, 1e-4, 0.3
STEPS = 1 << 15
#: Words times labels of chains that are taken through together; characters of texts read at once.
CELLS, CHARS = 1 << 19, 1 << 21
UNKNOWN = "und"
#: Parts of the hashes that the sample is drawn from alike.
PARTS = 16

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _WORD.findall(text.lower()) if text else []
    if text and not text.isascii():
        # the pattern's classes let some number signs pass
        found = [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]
    return found


def grams(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of a list of words."""
    text = "\x02" + "\x03\x02".join(words) + "\x03"
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    h = np.zeros(len(signs), np.uint64)
    features, owners = [], []
    with np.errstate(over="ignore"):
        for n in range(1, GRAMS + 1):
            h = h[:len(signs) - n + 1] * np.uint64(0x100000001B3) + signs[n - 1:]
            inside = owner[:len(h)] == owner[n - 1:]
            mixed = (h[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            features.append((mixed >> np.uint64(40)).astype(np.int64) % DIMS)
            owners.append(owner[:len(h)][inside])
    known = [(DIMS + lexicon[w], i) for i, w in enumerate(words) if w in lexicon]
    if known:
        at, own = zip(*known)
        features.append(np.array(at))
        owners.append(np.array(own))
    return np.concatenate(features), np.concatenate(owners)


def emissions(words: list[str], model: dict) -> np.ndarray:
    """exp of each word's score for each label, the largest being 1."""
    at, own = grams(words, model["lexicon"])
    w = model["weights"]
    out = np.stack([np.bincount(own, w[k][at], len(words)) for k in range(len(w))], axis=1)
    return np.exp(out - out.max(axis=1, keepdims=True))


def messages(e: np.ndarray, active: np.ndarray, steps: np.ndarray, prior: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of several chains, longest first, each scaled to sum 1.

    ``e`` (places, chains, labels); ``active``: chains that reach each place;
    ``prior``: what comes before the first place; ``after``: the message from
    behind each chain's last place.
    """
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    ones, back, reached = np.ones((e.shape[2], 1)), np.ascontiguousarray(steps.T), active.tolist()
    a = prior * e[0]
    alpha[0] = a / (a @ ones)
    for t in range(1, len(e)):
        k = reached[t]
        a = np.matmul(alpha[t - 1, :k], steps, out=alpha[t, :k])
        a *= e[t, :k]
        a /= a @ ones
    beta[-1, :reached[-1]] = after[:reached[-1]]
    for t in range(len(e) - 2, -1, -1):
        k = reached[t + 1]
        b = np.matmul(beta[t + 1, :k] * e[t + 1, :k], back, out=beta[t, :k])
        b /= b @ ones
        if k < reached[t]:
            beta[t, k:reached[t]] = after[k:reached[t]]
    return alpha, beta


def posterior(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Probabilities of each label at each place."""
    p = alpha * beta
    return p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300)


def active_at(sizes: list[int]) -> np.ndarray:
    """Chains (sizes falling) that reach each place."""
    return np.searchsorted(-np.array(sizes), -np.arange(1, sizes[0] + 1), side="right")


def long_chain(ids: np.ndarray, e: np.ndarray, steps: np.ndarray, prior: np.ndarray, block: int):
    """Probabilities of one chain by blocks, last block first: (start, probabilities)."""
    cuts = list(range(0, len(ids), block))
    before = []
    a = prior
    for at in cuts:
        before.append(a)
        for x in e[ids[at:at + block]]:
            a = (a * x) if at == 0 and a is prior else (a @ steps) * x
            a = a / a.sum()
    message = np.ones_like(prior)
    for at, a in zip(reversed(cuts), reversed(before)):
        own = e[ids[at:at + block]][:, None, :]
        start = prior if at == 0 else a @ steps
        yield at, posterior(*messages(own, np.ones(len(own), int), steps, start[None, :], message[None, :]))[:, 0]
        for x in own[::-1, 0]:
            message = (message * x) @ steps.T
            message = message / message.sum()


def pad(chains: list[np.ndarray]) -> np.ndarray:
    """(places, chains), longest first, filled up with 0."""
    out = np.zeros((len(chains[0]), len(chains)), np.int64)
    for k, c in enumerate(chains):
        out[:len(c), k] = c
    return out


def fit(chains: list[tuple[str, list[str]]], rounds: int = ROUNDS) -> dict | None:
    """A model from (label, words) chains; None without any."""
    labels = sorted({y for y, words in chains if words})
    if not labels:
        return None
    number = {y: k for k, y in enumerate(labels)}
    by_label: dict[int, list] = {k: [] for k in range(len(labels))}
    for y, words in chains:
        if words:
            by_label[number[y]].append(words)
    rows = [([k] * len(w), w) for k, own in by_label.items() for w in own]
    rng = np.random.default_rng(11)
    if len(labels) > 1:
        # text that switches once: the first half of one language, the second of another
        for k, i in zip(rng.integers(0, len(labels), int(MIXED * len(rows))), rng.integers(0, 1 << 30, int(MIXED * len(rows)))):
            other = (k + 1 + i % (len(labels) - 1)) % len(labels)
            a, b = by_label[k][i % len(by_label[k])], by_label[other][i % len(by_label[other])]
            a, b = a[:(len(a) + 1) // 2], b[len(b) // 2:]
            rows.append(([k] * len(a) + [other] * len(b), a + b))
    rows.sort(key=lambda r: -len(r[1]))
    seen = Counter(w for _, words in rows for w in words)
    lexicon = {w: k for k, w in enumerate([w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n > 2][:LEXICON])}
    index = {w: k for k, w in enumerate(sorted(seen))}
    at, own = grams(list(index), lexicon)
    ids = pad([np.array([index[w] for w in words]) for _, words in rows])
    gold = pad([np.array(y) for y, _ in rows])
    active = active_at([len(w) for _, w in rows])
    inside = np.arange(len(rows)) < active[:, None]
    n_labels, size = len(labels), DIMS + len(lexicon)
    goal = np.eye(n_labels)[gold] * inside[..., None]
    both = inside[1:]
    goal_steps = np.zeros((n_labels, n_labels))
    np.add.at(goal_steps, (gold[:-1][both], gold[1:][both]), 1)
    params = {"weights": np.zeros((n_labels, size)), "steps": np.zeros((n_labels, n_labels)), "first": np.zeros(n_labels)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    total = inside.sum()
    for r in range(1, rounds + 1):
        score = np.stack([np.bincount(own, w[at], len(index)) for w in params["weights"]], axis=1)
        e = np.exp(score - score.max(axis=1, keepdims=True))[ids]
        steps = np.exp(params["steps"])
        p, pairs = expected(e, active, steps, np.exp(params["first"]))
        error = (p - goal) * inside[..., None]
        by_word = np.zeros((len(index), n_labels))
        np.add.at(by_word, ids[inside], error[inside])
        grads = {"weights": np.stack([np.bincount(at, by_word[own, k], size) for k in range(n_labels)]) / total,
                 "steps": (pairs - goal_steps) / total, "first": error[0].sum(axis=0) / total}
        for k, g in grads.items():
            g = g + PENALTY * params[k]
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[k] -= RATE * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    return {"labels": labels, "lexicon": lexicon, "weights": params["weights"].astype(np.float32),
            "steps": np.exp(params["steps"]), "first": np.exp(params["first"])}


def expected(e: np.ndarray, active: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities at each place, and the expected number of each transition."""
    alpha, beta = messages(e, active, steps, first, np.ones(e.shape[1:]))
    ahead = beta[1:] * e[1:]
    z = np.einsum("tbi,ij,tbj->tb", alpha[:-1], steps, ahead)
    before = alpha[:-1] / np.where(z > 0, z, 1)[..., None]
    return posterior(alpha, beta), steps * np.einsum("tbi,tbj->ij", before * (z > 0)[..., None], ahead)


def shares(texts: list[str | None], model: dict, steps_at_once: int = STEPS) -> list[tuple[np.ndarray, list]]:
    """Of each text the expected words of each label, and its runs (first word, words, label number)."""
    index: dict[str, int] = {}
    chains = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64) for t in texts]
    n_labels = len(model["labels"])
    # as few labels leave room for, so that a step serves many chains
    at_once = max(steps_at_once, CELLS // n_labels)
    out: list = [(np.zeros(n_labels), [])] * len(texts)
    if not index:
        return out
    e = emissions(list(index), model)
    order = sorted((i for i, c in enumerate(chains) if len(c)), key=lambda i: -len(chains[i]))
    at = 0
    while at < len(order):
        size = len(chains[order[at]])
        if size > steps_at_once:
            i = order[at]
            total, best = np.zeros(n_labels), np.zeros(size, np.int16)
            for start, p in long_chain(chains[i], e, model["steps"], model["first"], steps_at_once):
                total += p.sum(axis=0)
                best[start:start + len(p)] = p.argmax(axis=1)
            out[i] = (total, run_lengths(best))
            at += 1
            continue
        some = order[at:at + max(1, at_once // size)]
        at += len(some)
        own = [chains[i] for i in some]
        p = posterior(*messages(e[pad(own)], active_at([len(c) for c in own]), model["steps"],
                                np.broadcast_to(model["first"], (len(own), n_labels)), np.ones((len(own), n_labels))))
        totals, best = p.sum(axis=0), p.argmax(axis=2)
        for k, i in enumerate(some):
            out[i] = (totals[k], run_lengths(best[:len(own[k]), k]))
    return out


def run_lengths(labels: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
    return [(a, b - a, int(labels[a])) for a, b in zip(cuts, cuts[1:])]


def sample(docs: DataFrame, texts: int = TEXTS) -> list[tuple[str, list[str]]]:
    """(label, words) chains of a bounded sample of ``docs`` (text, lang)."""
    keyed = pick(docs, "text", "lang").where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    kinds = keyed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS).select("lang")
    different = keyed.select("lang", "h").distinct().join(F.broadcast(kinds), "lang")
    # the first of each part of the hashes, so the texts of a frequent label don't meet in one task
    parts = different.withColumn("part", F.pmod("h", F.lit(PARTS)))
    first = (parts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h")))
             .where(F.col("place") <= max(1, texts // PARTS)))

    def run(batches):
        for b in slices(batches, 256):
            label, h, place, chain = [], [], [], []
            for y, key, text in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(text)
                n = -(-len(words) // CHAIN_WORDS)
                for k in sorted({n * j // CHAINS for j in range(CHAINS)}) if n else []:
                    label.append(y)
                    h.append(key)
                    place.append(k)
                    chain.append(" ".join(words[k * CHAIN_WORDS:(k + 1) * CHAIN_WORDS]))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(h, pa.int64()), pa.array(place, pa.int64()),
                                              pa.array(chain, pa.string())], ["lang", "h", "place", "chain"])

    # at most LABELS * texts keys; a text that many documents share comes once
    rows = keyed.join(F.broadcast(first.select("lang", "h")), ["lang", "h"]).select("lang", "h", "text")
    rows = rows.mapInArrow(run, "lang string, h bigint, place bigint, chain string").dropDuplicates(["lang", "h", "place"])
    return [(r.lang, r.chain.split()) for r in rows.orderBy("lang", "h", "place").collect()]


def alike(batches):
    """Slices of about ``CHARS`` bytes of text (second column), one row at least."""
    for b in slices(batches, 1 << 12):
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, side="right")))
            yield b.slice(at, end - at)
            at = end


def identify(docs: DataFrame, learn: DataFrame, texts: int = TEXTS, steps: int = STEPS) -> DataFrame:
    """doc_id, lang_pred, score, shares and runs of every row of ``docs`` (doc_id, text).

    Learns from ``learn`` (text, lang) alone.
    """
    docs = pick(docs, "doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(learn, texts)))
    run_type = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
    share_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        m = model.value
        for b in alike(batches):
            rows = []
            for total, runs in shares(b.column(1).to_pylist(), m, steps) if m else [(None, [])] * b.num_rows:
                if not runs:
                    rows.append((UNKNOWN, 0.0, [], []))
                    continue
                part = total / total.sum()
                k = int(part.argmax())
                rows.append((m["labels"][k], min(1.0, float(part[k])), [{"lang": y, "share": float(x)} for y, x in zip(m["labels"], part)],
                             [{"first_word": a, "words": n, "lang": m["labels"][y]} for a, n, y in runs]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), share_type, run_type)))],
                ["doc_id", "lang_pred", "score", "shares", "runs"])

    found = T.StructType.fromDDL("lang_pred string, score double, shares array<struct<lang: string, share: double>>, "
                                 "runs array<struct<first_word: bigint, words: bigint, lang: string>>")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *found.fields]))
