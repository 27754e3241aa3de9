"""URL filters by mined association rules (operator 7).

Tokens of a url: scheme, host labels, path segments (numbers as one token),
file extension, query keys, fragment. Spark's FP-growth mines the token sets
that are frequent among labelled urls, with the label as one more item, so a
set's frequency with and without the label gives its confidence. A rule is
kept if its support reaches ``MIN_SUPPORT`` and the lower Wilson bound of its
confidence ``MIN_CONFIDENCE``: combinations that are bad by chance go. Tokens
in more than ``EVERYWHERE`` of the urls tell nothing and are left out.

Rules match by an inverted index: each rule stands under its rarest token;
the distinct urls' tokens join the index on it, and the rule fires if the url
holds all its tokens. Urls are reduced to distinct ones first, so a hot url or
host is matched once for each text.

A given list (host/path, action) goes before: a rule fits its host and all
subdomains if the path starts with its path; the longest wins. The list is
configuration, at most ``MAX_LISTED`` entries. It is one constant, a hash table
of the rules by host; the suffixes of a url's host are looked up in it, so the
cost of a url does not grow with the list.

Null urls and such without ``://`` have empty host and path, no tokens, and
are allowed unless a rule says else. No labels or no rules: all allowed.
Repeated rows get a row each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import pick, written

MIN_SUPPORT, MIN_CONFIDENCE, EVERYWHERE = 0.005, 0.6, 0.95
Z = 2.58
BAD = "!bad"
MAX_LISTED = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows ``://`` (null without one)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), rest


def tokens(url: Column) -> Column:
    """Distinct tokens of a url, each with its kind before a colon."""
    host, path, rest = parts(url)
    tagged = lambda kind, words: F.transform(words, lambda w: F.concat(F.lit(kind), w))
    segments = F.regexp_replace(F.lower(path), r"\d+", "#")
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    found = F.concat(
        F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1)))),
        tagged("h:", F.split(host, r"[.:@]")),
        tagged("p:", F.split(F.regexp_replace(segments, r"\.[a-z0-9#]+$", ""), "/")),
        tagged("x:", F.array(F.regexp_extract(segments, r"\.([a-z0-9#]+)$", 1))),
        tagged("q:", F.transform(F.split(query, "&"), lambda kv: F.substring_index(kv, "=", 1))),
        F.when(F.instr(rest, "#") > 0, F.array(F.lit("f:#"))).otherwise(F.array().cast("array<string>")))
    return F.coalesce(F.array_distinct(F.filter(found, lambda t: F.length(t) > 2)), F.array().cast("array<string>"))


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, support, confidence, anchor) of labelled urls (url, bad)."""
    spark = urls.sparkSession
    items = written(pick(urls, "url", "bad").where("url is not null and bad is not null")
                    .select(tokens(F.col("url")).alias("tokens"), "bad"), "labelled-urls")
    n, n_bad = items.agg(F.count("*"), F.count(F.when(F.col("bad"), 1))).first()
    schema = "tokens array<string>, support double, confidence double, anchor string"
    if not n_bad:
        return spark.createDataFrame([], schema)
    # tokens of less than the support are in no rule, so at most tokens-per-url / MIN_SUPPORT remain
    seen = (items.select(F.explode("tokens").alias("token")).groupBy("token").count()
            .where((F.col("count") >= min_support * n) & (F.col("count") <= EVERYWHERE * n))).collect()
    share = {r.token: r["count"] for r in seen}
    if not share:
        return spark.createDataFrame([], schema)
    useful = F.array(*[F.lit(t) for t in sorted(share)])
    baskets = items.select(F.concat(F.array_intersect("tokens", useful),
                                    F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    sets = written(FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(baskets).freqItemsets, "itemsets")
    of = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(
        F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("hits"))
    p, z = F.col("hits") / F.col("n"), Z
    low = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    rank = F.create_map(*[F.lit(x) for t in sorted(share) for x in (t, share[t])])
    anchor = F.array_min(F.transform("tokens", lambda t: F.struct(rank[t].alias("n"), t.alias("t"))))["t"]
    return (bad.join(of, "tokens").where(low >= min_confidence)
            .select("tokens", (F.col("hits") / n).alias("support"), p.alias("confidence"), anchor.alias("anchor")))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that a rule fires on, with the strongest rule's confidence."""
    own = urls.select("url").where("url is not null").distinct().select("url", tokens(F.col("url")).alias("own"))
    hits = own.select("url", "own", F.explode("own").alias("anchor")).join(rules, "anchor")
    return (hits.where(F.size(F.array_except("tokens", "own")) == 0).groupBy("url")
            .agg(F.max("confidence").alias("confidence")))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest listed rule that fits (ties: the first by text), as struct(rule, action), or null."""
    if len(rules) > MAX_LISTED:
        raise ValueError(f"at most {MAX_LISTED} listed rules")
    slots: list[list] = [[] for _ in range(max(1, len(rules)))]
    for rule, action in rules:
        h, slash, p = rule.partition("/")
        slots[zlib.crc32(h.encode()) % len(slots)].append({"h": h, "p": slash + p, "rule": rule, "action": action})
    # folded to one literal when the query is planned
    listed = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<h: string, p: string, rule: string, action: string>>>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = F.flatten(F.transform(F.array_distinct(suffixes), lambda s: F.filter(
        F.element_at(listed, (F.crc32(s.cast("binary")) % len(slots) + 1).cast("int")), lambda r: (r["h"] == s) & path.startswith(r["p"]))))
    best = F.array_min(F.transform(near, lambda r: F.struct((-F.length(r["rule"])).alias("size"), r["rule"].alias("rule"), r["action"].alias("action"))))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["action"].alias("action")))


def judge(pages: DataFrame, mined: DataFrame, listed: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and the confidence of the mined rule for ``pages`` (page_id, url)."""
    pages = pick(pages, "page_id", "url")
    mined = written(mined, "url-rules")
    if mined.isEmpty():
        scored = pages.withColumn("confidence", F.lit(None).cast("double"))
    else:
        scored = pages.join(matched(pages, mined), "url", "left")
    host, path, _ = parts(F.col("url"))
    cut = scored.select("page_id", host.alias("host"), path.alias("path"), "confidence")
    ruled = cut.withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", F.col("listed.rule").alias("rule"),
                        F.coalesce("listed.action", method).alias("verdict"), F.col("confidence").alias("mined_confidence"))
