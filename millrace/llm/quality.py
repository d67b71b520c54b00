"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a condition that rejects a text. On a bounded sample every rule
is first run once together with all others, so that code is compiled and rows
are at hand, and then timed alone, less the time of a pass without a rule. One
more pass counts the sample's rows by the set of rules that reject them. The
cascade takes next the rule with most rejections a second among the rows that
the rules before it leave; a row that one rule rejects isn't tried further
(``CASE WHEN``). The order changes the work, never the verdict. Metrics that
several rules share are computed once. Everything is DataFrame functions.

Null and empty texts have no words; their counts are 0 and the base fails
(under 50 words). Rows are handled alone; repeated rows give equal results,
and an empty table gives none (then the rules keep their written order).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, discard

#: Rows of the sample that costs and selectivities are measured on, about.
SAMPLE_ROWS = 2000
#: Under this many words, or with more than this percentage of words in repeated windows, the base fails.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda over a single-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points in words: those that aren't white space."""
    return F.length(F.regexp_replace(_text(text), f"[{SPACE}]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit("[#*$%&|<>]")).cast("long")


def n_upper(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit("[A-Z]"))


def n_lower(text: Column) -> Column:
    """Runs are removed whole: letters are too many for a match each."""
    t = _text(text)
    return F.length(t) - F.length(F.regexp_replace(t, "[a-z]+", ""))


def n_marks(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit("[!?]"))


def _lines(text: Column) -> Column:
    """Lines with a word: what is left between line breaks that isn't white space alone."""
    return F.filter(F.split(_text(text), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(WORD), F.lit(0))


def n_repeat_words(text: Column) -> Column:
    """Words inside a window of three words that the text holds twice or more."""
    return _let(_words(text), _repeated)


def _repeated(words: Column) -> Column:
    """The same, of an array of words.

    Windows are compared by a 64-bit hash first, which most texts hold once
    each; those that share a hash are compared as words.
    """

    def hashes(w: Column) -> Column:
        return F.slice(F.transform(w, lambda v, i: F.xxhash64(v, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2)

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def twice(s: Column) -> Column:
        """Entries that a neighbour equals: in order, equal windows are neighbours."""
        return F.filter(s, lambda e, k: (e["v"] == F.get(s, k - 1)["v"]) | (e["v"] == F.get(s, k + 1)["v"]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        shared = _let(placed, twice)
        exact = F.sort_array(F.transform(shared, lambda e: F.struct(window(e["i"]).alias("v"), e["i"].alias("i"))))
        return _let(exact, lambda s: F.size(F.array_distinct(F.flatten(F.transform(twice(s), lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(hashes(words), count)).cast("long")


#: What the rules look at, by name, as functions of the text.
METRICS = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_lines": n_lines, "n_upper": n_upper, "n_lower": n_lower, "n_marks": n_marks}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``reject(metric)`` is true; ``metric`` gives a Column by name."""

    name: str
    reject: object


BASE = (
    Rule("few_words", lambda m: m("n_words") < LEAST_WORDS),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > MOST_REPEATED * m("n_words")),
)
RULES = (
    Rule("symbols", lambda m: 100 * m("n_symbols") > 5 * m("word_chars")),
    Rule("duplicate_lines", lambda m: (m("n_lines") >= 4) & (100 * m("n_dup_lines") > 40 * m("n_lines"))),
    Rule("word_length", lambda m: (m("word_chars") > 12 * m("n_words")) | (m("word_chars") < 2 * m("n_words"))),
    Rule("capitals", lambda m: (m("n_upper") >= 20) & (m("n_upper") > m("n_lower"))),
    Rule("shouting", lambda m: 100 * m("n_marks") > 10 * m("word_chars")),
)


def _by_text(text: Column):
    return lambda name: METRICS[name](text)


def _timed(sample: DataFrame, hits: list[Column], times: int = 2) -> float:
    """Seconds of a pass that evaluates ``hits``, the least of some."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        sample.agg(F.count("*").alias("n"), *(F.count_if(h).alias(f"h{i}") for i, h in enumerate(hits))).first()
        took.append(time.perf_counter() - began)
    return min(took)


def cascade(counts: dict[int, int], costs: list[float]) -> list[int]:
    """Rules by rejections a second among the rows that earlier ones leave.

    ``counts`` has the number of rows for each set of rejecting rules, as bits.
    """
    left, order = dict(counts), []
    while len(order) < len(costs):
        total = sum(left.values())
        gain = {i: (sum(n for m, n in left.items() if m >> i & 1) + 0.5) / (total + 1) / costs[i] for i in range(len(costs)) if i not in order}
        best = max(gain, key=lambda i: (gain[i], -i))
        order.append(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return order


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of the cascade, measured on a bounded sample of ``docs``."""
    total = docs.count()
    if not total:
        return list(rules)
    share = min(1.0, sample_rows / total)
    # by a hash of the id, so that the sample is the same on every run
    picked = docs.select("text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = cut(picked.limit(4 * sample_rows), "rule-sample")
    hits = [F.coalesce(r.reject(_by_text(F.col("text"))), F.lit(False)) for r in rules]
    mask = sum((F.when(h, F.lit(1 << i)).otherwise(F.lit(0)) for i, h in enumerate(hits)), F.lit(0))
    counts = {r["m"]: r["n"] for r in sample.groupBy(mask.alias("m")).agg(F.count("*").alias("n")).collect()}  # a warm-up, too
    bare = _timed(sample, [])
    costs = [max(_timed(sample, [h]) - bare, 1e-4) for h in hits]
    discard(sample)
    return [rules[i] for i in cascade(counts, costs)]


def _shared(rules: list[Rule]) -> list[str]:
    """The metrics that more than one rule looks at."""
    seen: dict[str, int] = {}
    for rule in rules:
        names: set[str] = set()
        rule.reject(lambda name: names.add(name) or F.lit(0))  # noqa: B023  it returns at once
        for n in names:
            seen[n] = seen.get(n, 0) + 1
    return [n for n in METRICS if seen.get(n, 0) > 1]


def passes(order: list[Rule], metric) -> Column:
    """The cascade: false at the first rule that rejects, else true."""
    out = None
    for rule in order:
        hit = F.coalesce(rule.reject(metric), F.lit(False))
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    order, text = order_rules(docs, RULES), F.col("text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # the rest of a rule's metrics are computed only where the cascade gets to it
    of_words = _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    m = docs.select("doc_id", "text", of_words.alias("w"), *(METRICS[k](text).alias(k) for k in base if k not in ("n_words", "n_repeat_words"))).select("*", "w.n_words", "w.n_repeat_words")
    metric = lambda name: F.col(name) if name in base else METRICS[name](text)
    failed = BASE[0].reject(metric) | BASE[1].reject(metric)
    out = m.withColumn("base_failed", failed)
    return out.select("doc_id", *base, "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(passes(order, metric)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, base rules included, by one cascade."""
    order, text = order_rules(docs, BASE + RULES), F.col("text")
    shared = _shared(order)
    own = F.struct(*(METRICS[n](text).alias(n) for n in shared))
    return docs.where(_let(own, lambda m: passes(order, lambda name: m[name] if name in shared else METRICS[name](text))))


__all__ = ["BASE", "METRICS", "RULES", "SPACE", "Rule", "cascade", "keep_good", "measured", "order_rules", "passes"]
