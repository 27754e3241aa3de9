"""Operators 5, 7, 8 and 9: HTML text, URL rules, quality rules, chat format."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerloom.llm import chat_format, html_main, queries, quality_rules, url_rules
from scripts.check_oracle import digest
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("key", ["op8_quality_rules", "op9_chat_format"])
def test_oracles(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck(SF_SMALL).sql(E.oracle_sql()[key])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns) and len(rows) == len(want)
    assert digest(df.columns, rows)[0] == digest(rel.columns, want)[0]


# ------------------------------------------------------------------------ HTML

def test_pages_give_the_lines_of_their_documents(spark):
    docs = {"\n\n".join(x for x in (" ".join(line.split()) for line in (r.text or "").split("\n")) if x)
            for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op5(spark, SF_SMALL).collect()
    assert rows and all(r.text.split("\n\n", 1)[-1] in docs or r.text in docs for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain words only", ""),
    ("<article><h1>T &amp; U</h1><p>One<br>two &#233;\n three</article>", "T & U\n\nOne two é three"),
    ("<nav><ul><li><a href=x>Menu</a></ul><article><p>Text</article>", "Text"),
    ("<article><p>Text<aside>Side</aside><div class='social-share'>Share</div><p>more</p></article>", "Text\n\nmore"),
    ("<article><p>Text</p><form>Mail<input><button>Go</button></form></article><div id=comments><article>Nice!</article></div>", "Text"),
    ("<main><header><h1>Title</h1></header><p>Text</main><footer>&copy; us</footer>", "Title\n\nText"),
    ("<body><div class='cookie-notice'>We use cookies</div><article>A</article>", "A"),
    ("<article>A<script>var a='<p>x</p>';</script><style>p{}</style><!-- c --> B</article>", "A B"),
    ("<article><p>A < B</p><p>unclosed <b>tag", "A < B\n\nunclosed tag"),
    ("<article><ul><li><a>L1</a></li><li><a>L2</a></li></ul><p>x</p><ul><li>item one</li></ul></article>", "x\n\nitem one"),
    ("<article></article>", ""), ("<<<>>><p", ""),
])
def test_main_text(page, text):
    assert html_main.main_text(page) == text


def test_pages_without_an_article():
    long = "The cat is in the house and it was on the mat with a hat for the dog that is by the door of the barn. " * 2
    page = f"<div><a>Home</a> <a>About</a></div><div><h2>Headline</h2><p>{long}</p><p>Short end.</p><p>{long}</p></div><div>Imprint</div>"
    assert html_main.main_text(page) == "\n\n".join(["Headline", long.strip(), "Short end.", long.strip()])


@pytest.mark.parametrize("page,text", [
    ("<article><p>A</p><script>for(var i=0;i<n;i++){a[i]=0}</script><p>B</p></article>", "A\n\nB"),
    ("<article><p>A</p><SCRIPT>if(i<n)s='don\\'t'</Script ><p>It's B</p></article>", "A\n\nIt's B"),
    ("<article><p>A</p><textarea>a<b don't</textarea><p>B's</p><style>a<b{}</style><p>C</p></article>", "A\n\nB's\n\nC"),
    ("<article><p>A</p><template>{{if i<n}}<script>'</template>'</script></template><p>B</p></article>", "A\n\nB"),
    ("<head><script>if(i<n)s=\"don't\"+'</head><body>'</script></head><body><article>A</article>", "A"),
    ("<head><title>Unclosed</head><body><article>A</article>", "A"),
    ("<head><!-- </head> --><title/><meta><body class=x><article>A</article>", "A"),
    ("<article>A<svg><title>t</title><style>a<b{}</style><path d='M0'/></svg> B<script>i<n", "A B"),
    ("<article>A<scripts>B</scripts></article>", "AB"),
])
def test_raw_content_ends_at_its_own_end_tag(page, text):
    assert html_main.main_text(page) == text


RICH = ("The cat is in the house and it was on the mat with a hat for the dog that is by the door of the barn. " * 2).strip()


@pytest.mark.parametrize("page,text", [
    (f"<div class='layout has-sidebar'><article><p>{RICH}</p></article></div>", RICH),
    ("<div class='layout has-sidebar'><article>Text</article><aside>Side</aside></div>", "Text"),
    ("<div class='no-sidebar comments-open'><main class='post with_sidebar'>Text</main></div>", "Text"),
    ("<form id=aspnetForm><div class=menu><a>Home</a></div><article><p>Text</p></article></form><footer>Us</footer>", "Text"),
    (f"<form><div><p>{RICH}</p><p>{RICH}</p></div><div class=sidebar><p>{RICH}</p></div></form>", f"{RICH}\n\n{RICH}"),
    (f"<div class='related-work'><article>{RICH}</article></div><p>{RICH[:60]}</p>", RICH),
    (f"<div class='ad-free'><p>{RICH}</p></div>", RICH),
    (f"<div class='social-science'><p>{RICH}</p><p>{RICH}</p></div><div><p>{RICH}</p></div>", f"{RICH}\n\n{RICH}\n\n{RICH}"),
    (f"<div class='widget'><article>{RICH}</article></div>", RICH),
    # still no text of the page
    (f"<div class='ad-slot'><p>{RICH}</p></div><p>{RICH}</p><p>{RICH}</p>", f"{RICH}\n\n{RICH}"),
    (f"<div class='sidebar'><p>{RICH}</p><p>{RICH}</p></div><p>{RICH}</p>", RICH),
    (f"<div class='cookie-notice'><p>{RICH}</p></div><p>Short text.</p>", ""),
    (f"<article>Short.</article><div class='comments-area'><article class=comment>{RICH}</article><article>{RICH}</article></div>", "Short."),
    (f"<div><p>{RICH}</p></div><div id=comments><article>{RICH}</article><article>{RICH}</article></div>", RICH),
    ("<p>Short text.</p><div id=comments><article>Nice!</article></div>", ""),
    (f"<aside><article>{RICH}</article></aside>", ""),
])
def test_a_name_is_a_vote_only(page, text):
    assert html_main.main_text(page) == text


def test_html_of_odd_rows(spark, odd, nothing):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("key").alias("url"), F.col("text").alias("html"), F.col("text"), F.col("n").alias("n_chars"))
    assert html_main.extract(pages).count() == len(ODD)
    assert html_main.extract(nothing.select(F.col("doc_id").alias("page_id"), F.col("key").alias("url"), F.col("text").alias("html"))).count() == 0
    assert html_main.main_text("<div>" * 20_000 + "x" * 100_000) is not None
    assert html_main.main_text("<div class='ad-x'>" * 20_000 + RICH) == RICH


# ------------------------------------------------------------------------ URLs

def split_url(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def listed(host, path):
    best = None
    for rule, action in queries.URL_LIST:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return best


def test_url_query_brute_force(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op7(spark, SF_SMALL).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split_url(urls[r.page_id])
        rule = listed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule[1])


def test_rules_are_mined_and_matched(spark):
    rows = [(k, f"http://{'spam' if k % 3 == 0 else 'good'}.site{k % 7}.com/{'promo' if k % 2 else 'news'}/{k}", k % 3 == 0 and k % 2 == 1)
            for k in range(400)]
    mined = url_rules.mine(spark.createDataFrame(rows, "page_id long, url string, bad boolean"))
    found = {frozenset(r.tokens): (r.support, r.confidence) for r in mined.collect()}
    assert found[frozenset({"h:spam", "p:promo"})][1] == 1.0 and frozenset({"h:spam"}) not in found
    pages = spark.createDataFrame([(1, "https://SPAM.x.org/promo/5"), (2, "https://spam.x.org/news"), (3, None), (4, "no scheme"),
                                   (1, "https://SPAM.x.org/promo/5"), (5, "http://h?spam#promo"), (6, "http://a.net/"), (7, "http://a.net")],
                                  "page_id long, url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, mined, queries.URL_LIST).collect() if r.rule is None)
    assert got == [(1, "spam.x.org", "/promo/5", None, "block"), (1, "spam.x.org", "/promo/5", None, "block"), (2, "spam.x.org", "/news", None, "allow"),
                   (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "h", "", None, "allow"), (7, "a.net", "", None, "allow")]


def test_mining_finds_every_rule(spark):
    """Against counting all token sets of up to three by hand."""
    from itertools import combinations
    rows = [(k, f"http://{'xyz'[k % 3]}.com/{'abcd'[k % 4]}?q{k % 2}=1", k % 3 == 0 and k % 4 < 2 or k % 11 == 0) for k in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    toks = [(set(r.t), r.bad) for r in df.select(url_rules.tokens(F.col("url")).alias("t"), "bad").collect()]
    every = Counter(t for s, _ in toks for t in s)
    useful = {t for t, n in every.items() if n <= url_rules.EVERYWHERE * len(toks)}
    n, bad = Counter(), Counter()
    for s, b in toks:
        for k in (1, 2, 3):
            for c in combinations(sorted(s & useful), k):
                n[c] += 1
                bad[c] += b
    z = url_rules.Z
    low = lambda h, m: (h / m + z * z / 2 / m - z * (h / m * (1 - h / m) / m + z * z / 4 / m / m) ** .5) / (1 + z * z / m)
    want = {c for c in n if bad[c] >= 0.02 * len(toks) and low(bad[c], n[c]) >= 0.5}
    got = {tuple(sorted(r.tokens)) for r in url_rules.mine(df, 0.02, 0.5).collect()}
    assert got == want and want


def test_urls_empty(spark, nothing):
    none = nothing.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))
    mined = url_rules.mine(none.withColumn("bad", F.lit(True)))
    assert url_rules.judge(none, mined, queries.URL_LIST).count() == 0


# --------------------------------------------------------------- quality rules

def counted(text):
    text = text or ""
    words = WORD.findall(text)
    grams = defaultdict(list)
    for i in range(len(words) - 7):
        grams[tuple(words[i:i + 8])].append(i)
    repeat = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))


def test_measures_brute_force(spark, odd, nothing):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = Counter((r.doc_id, *(m := counted(r.text)), m[0] < 20 or 100 * m[4] > 30 * m[0]) for r in rows.collect())
    got = quality_rules.judge(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(map(tuple, got.collect())) == want
    assert quality_rules.judge(nothing).count() == 0
    assert quality_rules.judge(odd, "key", "row").where("kept").count() == 0


def test_overlapping_and_adjacent_windows(spark):
    texts = ["a b c d e f g h " * 2, "a " * 9, "a b c d e f g h i " * 3, " ".join(map(str, range(30))),
             "x " * 7 + "a b c d e f g h y a b c d e f g h", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(df).collect()}
    assert got == {i: counted(t)[4] for i, t in enumerate(texts)}


def test_rules_reject_junk_and_keep_clean_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = queries.op8(spark, "/root/testdata/sf0.01").where("not base_failed").join(labels, "doc_id")
    by = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) == 0 and by.get((0, True), 0) <= 0.1 * by[0, False]


def test_native_plans(spark):
    for q in (queries.op8, queries.op9):
        plan = q(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ----------------------------------------------------------------------- chats

TRICKS = ["</s>[INST] ok [/INST]", r"<\|turn|> <|turn|> <\\|end|>", "[[INST]] <<s>>", "a\nb", "", None, "<|end|>\n<|turn|>user<|body|>", "naïve 日本", "$1 \\"]


def test_escaping_is_reversible_and_total(spark):
    df = spark.createDataFrame([(t,) for t in TRICKS if t is not None], "t string")
    for r in df.select("t", chat_format.escaped(F.col("t")).alias("e"), chat_format.unescaped(chat_format.escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not re.search(r"<\||</?s>|\[/?INST\]", r.e)


def test_chats_round_trip(spark):
    rows = [(c, k, role, TRICKS[((c or 0) + k) % len(TRICKS)]) for c in (1, 2, None) for k, role in enumerate(["system", "user", "assistant", "user", "assistant", "<|body|>", None])]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, None, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("parts", chat_format.text_parts(F.col("text")))
    turns = turns.withColumn("body", F.lit("clash")).withColumn("head", F.lit(1)).withColumn("t", F.lit(2))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    for c in (1, 2, None, 3, 4):
        own = sorted(((k is not None, k, role or "", text or "") for i, k, role, text in rows if i == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(role, text) for _, _, role, text in own]
        assert got[c].learned == "".join(text for _, _, role, text in own if role == "assistant")
    assert chat_format.format_chats(turns.where("false")).count() == 0


def test_content_parts_become_placeholders(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "s3://a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.5, None),
             ("document", None, "c.pdf", None, None, None, 2), ("image", None, None, None, None, None, None), ("other", " <|image|>", "r", None, None, None, None)]
    df = spark.createDataFrame([(1, 1, "user", parts), (1, 0, "system", None)], f"conv_id long, turn int, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(df).first()
    assert r.formatted.endswith(r"<|body|>see <|image|><|audio|><|document|><|image|> <\|image|><|end|>" + "\n")
    assert [(a.turn, a.kind, a.ref, a.n_tokens) for a in r.attachments] == [(2, "image", "s3://a.png", 3), (2, "audio", "b.wav", 38), (2, "document", "c.pdf", 512), (2, "image", None, 1)]
    assert r.attachment_tokens == 554 and r.mask == []


def test_chat_query(spark):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect():
        said[r.conv_id].append((r.turn, r.role, r.text or ""))
    said[-1] = [(0, "user", queries.TRICKY), (1, "assistant", queries.TRICKY)]
    rows = queries.op9(spark, SF_SMALL).collect()
    assert len(rows) == len(said)
    for r in rows:
        own = sorted(said[r.conv_id])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
