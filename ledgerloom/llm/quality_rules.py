"""Quality rules as one projection (operator 8, native).

``RULES`` is the threshold table: a name, a ratio of two measures, and the
range that passes. ``compiled`` turns the table into boolean columns of one
projection; measures and ratios are built-in functions only. Nothing is
shuffled.

A rule whose ratio is null (division by zero words or lines) passes; texts
without words fail the base rule on length. Null text: no words. Repeated
rows get a row each; null ids are kept. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import pick

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: White space that parts words (fixed by the definition of a word).
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_stop_words", "n_lines",
            "n_ellipsis_lines")
STOP_WORDS = """the of and to in is that for with der die und den das von zu mit le la les de des et en un une du que
est pour dans el los las y del por con para a it on be by this are was from or not""".split()


@dataclass(frozen=True)
class Rule:
    """The ratio of two measures and the range that passes."""
    name: str
    count: str
    per: str
    low: float | None = None
    high: float | None = None

    def passes(self, m: Column) -> Column:
        ratio = m[self.count] / F.nullif(m[self.per], F.lit(0))
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (ratio >= self.low)
        if self.high is not None:
            ok = ok & (ratio <= self.high)
        return F.coalesce(ok, F.lit(True))

    def sql(self) -> str:
        ratio = f"{self.count} / nullif({self.per}, 0)"
        ok = [f"{ratio} >= {self.low}"] * (self.low is not None) + [f"{ratio} <= {self.high}"] * (self.high is not None)
        return f"coalesce({' AND '.join(ok)}, true)"


RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("exclaim_ratio", "n_exclaims", "n_words", None, 0.5),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 0.5),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more.

    Windows are compared by a 64-bit hash of their words. Only texts with an
    equal pair are sorted; the positions of equal windows are then merged to
    intervals in order, so the cost is n log n at most.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def merged(t: Column) -> Column:
            n = F.size(t)
            twins = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(
                (F.get(t, j)["h"] == F.get(t, j - 1)["h"]) | (F.get(t, j)["h"] == F.get(t, j + 1)["h"]),
                F.get(t, j)["h"] == F.get(t, j - 1)["h"], F.get(t, j)["h"] == F.get(t, j + 1)["h"], F.lit(False)))
            places = F.sort_array(F.transform(twins, lambda j: F.get(t, j)["at"]))
            return F.aggregate(
                places, F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
                lambda a, p: F.struct((p + WINDOW).alias("end"), (a["total"] + (p + WINDOW - F.greatest(p, a["end"]))).alias("total")),
                lambda a: a["total"])

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(tagged, merged)).otherwise(F.lit(0).cast("bigint"))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """All counts of a text as one struct."""
    size = lambda c: F.size(c).cast("bigint")
    without = lambda t, signs: F.length(F.translate(t, signs, ""))

    def counts(s: Column) -> Column:
        text, words, lines = s["text"], s["words"], s["lines"]
        found = {
            "n_words": size(words), "word_chars": without(text, SPACES).cast("bigint"),
            "n_symbols": (F.length(text) - without(text, SYMBOLS)).cast("bigint"),
            "n_dup_lines": size(lines) - size(F.array_distinct(lines)), "n_repeat_words": repeat_words(words),
            "n_exclaims": (F.length(text) - without(text, "!")).cast("bigint"),
            "n_stop_words": size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))), "n_lines": size(lines),
            "n_ellipsis_lines": size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        }
        return F.struct(*[v.alias(k) for k, v in found.items()])

    cut = let(F.coalesce(text, F.lit("")), lambda t: F.struct(
        t.alias("text"), F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: without(x, SPACES) > 0).alias("lines")))
    return let(cut, counts)


def compiled(m: Column, rules: tuple[Rule, ...]) -> Column:
    """Measures ``m``, base_failed, a boolean per rule and kept, as one struct."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    kept = ~failed
    for r in rules:
        kept = kept & r.passes(m)
    return F.struct(*[m[k].alias(k) for k in MEASURES], failed.alias("base_failed"),
                    *[r.passes(m).alias(f"ok_{r.name}") for r in rules], kept.alias("kept"))


def judge(docs: DataFrame, *carry: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the columns named in ``carry``, measures, base_failed, one boolean per rule, and kept.

    The verdict is one expression, so a filter on it may move below the
    projection without measuring twice.
    """
    verdict = let(measures(F.col("text")), lambda m: compiled(m, rules))
    return pick(docs, "doc_id", "text", *carry).select("doc_id", *carry, verdict.alias("_v")).select("doc_id", *carry, "_v.*")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> tuple[str, str]:
    """base_failed and kept as SQL over the measures."""
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return failed, " AND ".join([f"NOT {failed}", *(r.sql() for r in rules)])
