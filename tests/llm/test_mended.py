"""Hot groups, long inputs and lost rows: cases that operators 1 to 10 once got wrong."""

import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import (chat_format, decontam, html_main, packing, quality_knn, simhash, token_counts, token_files,
                            tokens, url_rules)
from ledgerloom.llm.common import scratch
from tests.llm.conftest import ODD
from tests.llm.test_tokens import PATH, library

SENTENCE = "The quick fox of the wood was in a hole and it was with the bear of that land as it is for all. "


# operators 1, 3, 10: a third of the rows without id and text, and few very long documents

@pytest.fixture(scope="module")
def lopsided(spark):
    rows = [(k, f"document {k} " * (k % 5 + 1)) for k in range(600)] + [(None, None)] * 300
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()


def test_the_librarys_model_gives_the_librarys_ids():
    p = tokens.Pieces(PATH)
    assert p.merge is not None
    odd = [t for _, text in ODD for t in p.pre_tokens(text or "")] + [chr(c) for c in (*range(256), 0x17F, 0x20AC, 0x1F600)] + [" x", " ́"]
    assert p.ids(odd) == [library(t) for t in odd]


def test_files_split_rows_that_share_an_id(spark, lopsided):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    path, before = scratch(spark, "token-files"), spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        token_files.write_tokens(lopsided, path, PATH, end_id=2)
    finally:
        spark.conf.set(key, before)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 2 * 900 / 8
    starts = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.start for r in starts] == np.cumsum([0] + [r.n_tokens for r in starts])[:-1].tolist()
    ids = [r.doc_id for r in starts if r.doc_id is not None]
    assert ids == sorted(ids) and [r.doc_id for r in starts[:300]] == [None] * 300


def test_counts_of_many_rows_without_an_id(lopsided):
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(lopsided, PATH).collect())
    assert got[None, 0] == 300 and sum(got.values()) == 900


def test_groups_of_packing_are_bounded(spark, lopsided):
    long = spark.createDataFrame([(10_000 + k, f"word{k} and another {k * k} " * 4000) for k in range(6)], "doc_id bigint, text string")
    docs = lopsided.union(long)
    limit = 20_000
    out = packing.pack(docs, PATH, end_id=1, length=128, group_bytes=limit).select("sequence_id", "used", "pieces").collect()
    ids, pieces = Counter(), Counter()
    for r in out:
        ids[r.sequence_id // packing.GROUP_BINS] += r.used
        pieces[r.sequence_id // packing.GROUP_BINS] += len(r.pieces)
    assert max(ids.values()) <= limit and len(ids) > 20
    assert max(pieces.values()) < 3 * sum(pieces.values()) / len(pieces)
    assert sum(r.used for r in out) == sum(len(library(r.text)) + 1 for r in docs.collect())


# operator 2

def test_shapes_of_long_words():
    assert quality_knn.shape("a1" * 40) != quality_knn.shape("a1" * 41)
    assert quality_knn.shape("Hello") == "Aa+" and quality_knn.shape("HELLO2") == "A+0"


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id bigint, quality int")
    assert len(quality_knn.references(docs, labels, "quality", 15)) == 30


# operator 4

def test_a_hot_key(spark):
    """All fingerprints share two segments: one key holds them all."""
    rng = np.random.default_rng(4)
    fps = np.unique((np.int64(0x1234567) << 40) | rng.integers(0, 1 << 16, 3000))
    got = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp bigint").repartition(4), block=256)
    roots = {r.node: r.root for r in simhash.components(got).collect()}
    forest = simhash.Forest()
    for x in fps:
        for y in fps[np.bitwise_count(fps ^ x) <= 3]:
            forest.join(int(x), int(y))
    assert all(roots.get(int(x), int(x)) == forest.root(int(x)) for x in fps)


# operator 5

def test_pages_in_other_scripts():
    japanese, russian = "日本語の文章です。これは長い段落であり、いくつかの文を含みます。" * 8, "Это длинный абзац текста, который содержит несколько предложений. " * 4
    for text in (japanese, russian):
        page = f"<body><nav><a href=x>home</a></nav><ul><li><a href=y>link one</a></li></ul><div><p>{text}</p><p>{text}!</p></div><footer>x</footer></body>"
        assert html_main.main_text(page) == f"{text.strip()}\n\n{text.strip()} !".replace(" !", " !" if text is russian else "!")


@pytest.mark.parametrize("tag", ["<p title=it's>", "<p title=\"it's\">", "<p title='a \"b'>", "<p title=a\"b>", "<p \"odd>", "<p title = 'x>y'>"])
def test_quotes_in_tags(tag):
    page = f"<article><p>{SENTENCE}1</p>{tag}{SENTENCE}2</p><p>{SENTENCE}3</p></article>"
    assert html_main.main_text(page) == "\n\n".join(f"{SENTENCE}{k}" for k in (1, 2, 3))


def test_an_unclosed_quote_ends_with_its_tag():
    assert html_main.main_text(f"<article><p>{SENTENCE}</p><a href='foo>link</article>") == f"{SENTENCE.strip()}\n\nlink"


def test_part_of_a_name_takes_no_text_out_of_an_article():
    long = SENTENCE * 2
    page = (f'<article><p>{long}A</p><p>{long}B</p><div class="social-science"><p>{long}C</p></div>'
            '<div class="social-share"><a href=x>share this</a></div>'
            f'<div class="related-articles"><p>{long}D</p></div></article>')
    assert html_main.main_text(page) == "\n\n".join(f"{long}{k}" for k in "ABC")


@pytest.mark.parametrize("role, inside", [('role="main"', True), ("role='main'", True), ("role=main", True), ('ROLE="Main"', True),
                                          ('data-role="main"', False)])
def test_role_main(role, inside):
    text = html_main.main_text(f"<body><p>{SENTENCE}out</p><div {role.lower() if not inside else role}><p>{SENTENCE}in</p></div></body>")
    assert text.endswith("in") and ("out" in text) != inside


@pytest.mark.parametrize("page", ["<p>x</p>" * 100_000, "<body>" + "<div>" * 100_000 + "</span>" * 100_000,
                                  "<div>" * 10 + "<article>" + "<span>" * 100_000 + "</div>" * 100_000 + "text"])
def test_long_pages_take_linear_time(page):
    start = time.process_time()
    html_main.main_text(page)
    assert time.process_time() - start < 4


def test_labels_of_the_nearest_block():
    def plain(labels, regions, has_article, headings):
        end, out = 1 if has_article else -1, []
        for k, label in enumerate(labels):
            step = 0
            while label == 0:
                step += 1
                near = []
                for j in (k - step, k + step):
                    if not 0 <= j < len(labels) or regions[j] != regions[k]:
                        near.append(end)
                    elif labels[j] and not (has_article and labels[j] < 0):
                        near.append(labels[j])
                if near:
                    label = near[-1] if headings[k] else min(near)
            out.append(label)
        return out
    rng = np.random.default_rng(8)
    for _ in range(500):
        n = int(rng.integers(0, 15))
        args = (rng.choice([-1, 0, 0, 0, 1], n).tolist(), np.sort(rng.integers(0, 3, n)).tolist(), bool(rng.integers(2)), rng.integers(0, 2, n).astype(bool).tolist())
        assert html_main.inherited(*args) == plain(*args)


# operator 6

def test_items_by_row_and_small_tables(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice([f"w{k}" for k in range(400)], n))
    a, b, c = prose(30), prose(30), prose(30)
    words = a.split()
    edited = " ".join(w if k % 4 else "changed" for k, w in enumerate(words))  # every seed but those between is broken
    items = spark.createDataFrame([(None, a), (5, b), (5, c), (6, None)], "item_id bigint, text string")
    docs = [(0, prose(50) + " " + a), (1, b), (2, c), (3, edited), (None, prose(20) + " " + b)] + [(10 + k, prose(100)) for k in range(45)]
    for limit in (1_000_000, 40):
        got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(
            spark.createDataFrame(docs, "doc_id bigint, text string"), items, broadcast_seeds=limit).collect())
        assert got == Counter([(0, None), (1, 5), (2, 5), (3, None), (None, 5)])


def test_a_single_seed_passage_does_not_depend_on_the_tables_size(spark):
    item = "alpha beta gamma delta epsilon zeta"
    once = "alpha beta gamma other words delta x epsilon zeta"  # one seed, near enough to align
    for n in (5, 60, 300):
        docs = [(0, once)] + [(k, f"nothing to see {k}") for k in range(1, n)]
        got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                    spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
        assert [(r.doc_id, r.item_id) for r in got] == [(0, 1)]


def test_passages_of_a_long_document_with_a_common_seed(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PASSAGE_ROWS", 7)
    filler = " ".join(f"f{k}" for k in range(40))
    item = "one two three four five six"
    text = " ".join(f"one two three {filler}" for _ in range(300)) + " " + item
    docs = spark.createDataFrame([(1, text), (2, "one two three " * 2000)], "doc_id bigint, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.score) for r in got if r.score == 1} == {(1, 1.0)}


def test_runs_of_hits_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        hits = sorted(((int(i), 5 + int(i), int(rng.integers(0, 4)), int(at), int(rng.integers(0, 6)), 4)
                       for i, at in zip(rng.integers(0, 3, 25), rng.integers(0, 120, 25))), key=lambda h: h[3])
        want = []
        for item in {h[0] for h in hits}:
            run = []
            for h in [x for x in hits if x[0] == item] + [None]:
                if run and (h is None or h[3] - run[-1][3] > run[0][1]):
                    size = run[0][1]
                    seeds = sorted({x[4] for x in run})
                    want.append((item, seeds, len(seeds) >= 2, max(0, run[0][3] - max(x[2] for x in run) - int(size / 2)),
                                 min(150, run[-1][3] + size + int(size / 2))))
                    run = []
                if h is not None:
                    run.append(h)
        assert sorted(decontam.gather(150, iter(hits))) == sorted(want)


# operator 7

def test_ten_thousand_listed_rules(spark):
    rng = np.random.default_rng(2)
    labels = ["a", "b", "c", "dd", "net", "org", "x-y"]
    host = lambda: ".".join(rng.choice(labels, rng.integers(1, 5)))
    path = lambda: "/" + "/".join(rng.choice(labels, rng.integers(0, 3)))
    rules = sorted({host() + path() for _ in range(60_000)})[:10_000]
    rules = [(r, "block" if k % 2 else "allow") for k, r in enumerate(rules)]
    assert len(rules) > 5_000
    urls = [(k, f"http://{host()}{path()}/tail") for k in range(300)] + [(900, None), (901, "no host")]
    none = spark.createDataFrame([], "tokens array<string>, support double, confidence double, anchor string")
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(urls, "page_id bigint, url string"), none, rules).collect()}
    split = [(r.partition("/")[0], "/" + r.partition("/")[2], r, action) for r, action in rules]
    for k, u in urls:
        h, p = (u.split("://")[1].partition("/")[0], "/" + u.split("://")[1].partition("/")[2]) if u and "://" in u else ("", "")
        fits = [(-len(r), r, action) for rh, rp, r, action in split if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        assert (got[k].rule, got[k].verdict) == ((min(fits)[1], min(fits)[2]) if fits else (None, "allow"))


# operator 9

def test_a_conversation_of_twenty_thousand_turns(spark):
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                       F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                       F.concat(F.lit("ñ日</s> "), F.col("id").cast("string"), F.lit(" text" * 40)).alias("text"))
    chats = chat_format.format_chats(turns.withColumn("parts", chat_format.text_parts(F.col("text"))))
    start = time.time()
    r = chat_format.read_back(chats).first()
    assert time.time() - start < 20
    assert r.learned == "".join(f"ñ日</s> {k}" + " text" * 40 for k in range(1, 20_000, 2)) and len(r.turns) == 20_000
    m = chats.select("formatted", "mask").first()
    assert all(m.formatted[s.start:s.stop] == m.formatted.encode()[s.start_byte:s.stop_byte].decode() for s in m["mask"][::500])
