"""Secret scans with native expressions only.

Three base kinds (assign, access, hex) follow fixed rules; their spans always
stay. Kind ``random`` adds tokens that a battery of randomness tests finds too
even to be words or identifiers. For each token of 20 or more characters the
encoding is inferred (hex, base32, one case with digits, or base64), and three
statistics are compared with what *structured* text in it shows: chi-squared
uniformity over the alphabet, runs of character classes, and serial
correlation of neighbouring codes. How structured text behaves was fitted for
each encoding (``NULL``) on identifiers made of words and numbers. The three are
combined with weights into one normal score, whose p-value is the chance that
such an identifier looks as random as the token.
It goes into a false-discovery procedure with a stratum for
each length class, over the tokens of all documents: p-values fall into fixed
bins, bins are counted for the whole corpus, and each stratum's threshold is
the largest bin whose expected share of false discoveries is at most ``FDR``.
Tokens of any length are tested. Tokens that touch a base span are left out.

Offsets are code points with ends exclusive. Null texts count as empty: no
spans, and the digest of the empty string. Repeated rows count as often as
they occur; equal p-values are decided alike. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Equal to the shorter patterns with the length checked afterwards: their matches are whole runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: Expected share of false discoveries that each length class allows.
FDR = 0.01
#: Of structured text, by alphabet size: mean of the coincidence excess and its deviation times sqrt(n), mean
#: rate of class changes and its deviation times sqrt(n - 1), mean square of the serial z at length 0 and its growth a letter.
NULL = {16: (0.9, 2.5, 0.20, 0.40, 1.2, 0.01), 32: (0.75, 2.9, 0.15, 0.39, 0.1, 0.105), 36: (0.90, 3.1, 0.15, 0.38, 0.1, 0.105), 64: (1.93, 4.8, 0.44, 0.44, 0.4, 0.055)}
#: Weights of uniformity, runs and serial correlation in the combined score.
WEIGHTS = (1.0, 1.2, 0.5)
#: Bins of -log10(p), each 1/BINS_PER wide.
BINS_PER, BINS = 20, 800
LENGTH_CLASSES = (20, 28, 40, 64, 128)
#: Matches whose spans are built in one go.
CHUNK = 512
SPAN = "array<struct<start:int,end:int,kind:int>>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none() -> Column:
    return F.array().cast(SPAN)


def _matches(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of a pattern's matches: what lies between them gives their places.

    ``keep`` is an array of booleans beside the matches.
    """
    # the text is cut at every match; gaps and matches in turn give offsets
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def some(h: Column, g: Column, at: Column, first: Column) -> Column:
        """(place after them, spans) of matches from number ``first`` on, whose first gap begins at ``at``."""
        zero = F.struct(at.alias("at"), first.alias("i"), _none().alias("out"))

        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + F.length(F.get(g, acc["i"]))
            end = start + F.length(m)
            one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)
            return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], one).alias("out"))

        return F.aggregate(h, zero, step)

    def spans(h: Column, g: Column) -> Column:
        # in chunks: an array that grows by one element at a time is copied each time
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def chunk(acc: Column, k: Column) -> Column:
            return _let(some(F.slice(h, k + 1, F.lit(CHUNK)), g, acc["at"], k), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        many = F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(h) - 1, F.lit(CHUNK)), zero, chunk)["out"])
        found = F.when(F.size(h) <= CHUNK, some(h, g, F.lit(0), F.lit(0))["out"]).otherwise(many)
        return found if keep is None else F.transform(F.filter(F.arrays_zip(found.alias("s"), keep.alias("k")), lambda z: z["k"]), lambda z: z["s"])

    both = _let(F.struct(hits.alias("h"), gaps.alias("g")), lambda x: spans(x["h"], x["g"]))
    return F.when(F.regexp_like(text, F.lit(pattern)), both).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of the base rules by start, then kind as listed."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 6)
    return F.array_sort(F.concat(_matches(text, ASSIGN, 0, long_enough), _matches(text, ACCESS, 1), _matches(text, HEX, 2)))


def _evidence(z: Column) -> Column:
    """-log10 P(Z > z) of a standard normal variable.

    Below 3 by a logistic-polynomial form, from there by the tail's asymptotic
    one, which doesn't run out of digits; relative errors of p under a tenth.
    """
    x = F.greatest(z, F.lit(-8.0))
    near = F.log10(1 + F.exp(x * (1.5976 + 0.07056 * x * x)))
    far = x * x / 2 * math.log10(math.e) + F.log10(x + 1 / x) + math.log10(math.sqrt(2 * math.pi))
    return F.when(x < 3, near).otherwise(far)


def _statistics(token: Column) -> Column:
    """-log10 of the p-value: the chance that structured text looks as random as ``token``."""

    def of(t: Column) -> Column:
        size = F.when(F.regexp_like(t, F.lit("^([0-9a-f]+|[0-9A-F]+)=*$")), F.lit(16.0)).when(F.regexp_like(t, F.lit("^[A-Z2-7]+=*$")), F.lit(32.0)).when(F.regexp_like(t, F.lit("^([0-9A-Z]+|[0-9a-z]+)=*$")), F.lit(36.0)).otherwise(F.lit(64.0))
        codes = F.transform(F.split(t, ""), lambda y: F.ascii(y))

        # what a lambda reads is bound first: an expression inside it would be computed for every letter
        def bound(x: Column) -> Column:
            c = x["c"]
            klass = F.transform(c, lambda y: F.when(y.between(48, 57), 0).when(y.between(65, 90), 1).when(y.between(97, 122), 2).otherwise(3))
            m = F.aggregate(c, F.lit(0.0), lambda s, y: s + y) / F.size(c).cast("double")
            return _let(F.struct(c.alias("c"), x["a"].alias("a"), klass.alias("klass"), m.alias("m")), battery)

        def battery(x: Column) -> Column:
            c, a, klass, m = x["c"], x["a"], x["klass"], x["m"]
            n_ = F.size(c).cast("double")
            # sum of squared letter counts = number of ordered equal pairs
            squares = F.aggregate(F.array_distinct(c), F.lit(0.0), lambda s, v: s + F.pow(F.size(F.filter(c, lambda y: y == v)).cast("double"), F.lit(2.0)))
            # chi-squared as the excess of coincidences over 1/a, which doesn't grow with the length
            excess = a * (squares - n_) / (n_ * (n_ - 1)) - 1
            changes = F.size(F.filter(klass, lambda k, i: (i > 0) & (k != F.get(klass, i - 1)))).cast("double")
            v = F.aggregate(c, F.lit(0.0), lambda s, y: s + (y - m) * (y - m))
            lag = F.aggregate(F.transform(c, lambda y, i: F.when(i > 0, (y - m) * (F.get(c, i - 1) - m)).otherwise(0.0)), F.lit(0.0), lambda s, y: s + y)
            z = F.abs(F.when(v > 0, lag / v).otherwise(1.0)) * F.sqrt(n_)
            null = [F.lit(x) for x in NULL[64]]
            for size in (36, 32, 16):
                null = [F.when(a == size, F.lit(x)).otherwise(y) for x, y in zip(NULL[size], null, strict=True)]
            even = (null[0] - excess) * F.sqrt(n_) / null[1]
            runs = (changes - null[2] * (n_ - 1) - 0.5) / (null[3] * F.sqrt(n_ - 1))
            serial = (1 - z * z / (null[4] + null[5] * n_)) / math.sqrt(2)  # structured text: mean 0, variance 1
            score = (WEIGHTS[0] * even + WEIGHTS[1] * runs + WEIGHTS[2] * serial) / math.sqrt(sum(w * w for w in WEIGHTS))
            # a correlation that one random token in ten thousand shows speaks for structure
            return F.when(z > 4, F.lit(0.0)).otherwise(_evidence(score))

        return _let(F.struct(codes.alias("c"), size.alias("a")), bound)

    return _let(token, of)


def _length_class(length: Column) -> Column:
    out = F.lit(0)
    for i, lo in enumerate(LENGTH_CLASSES[1:], 1):
        out = F.when(length >= lo, F.lit(i)).otherwise(out)
    return out


def _has_mixture(token: Column) -> Column:
    """Letters and digits both, or both cases: else it is a word or a number."""
    kinds = sum((F.regexp_like(token, F.lit(p)).cast("int") for p in ("[0-9]", "[a-z]", "[A-Z]")), F.lit(0))
    return kinds >= 2


def _tested(text: Column) -> Column:
    """Tokens with their spans, length class and evidence bin."""
    spans = _matches(text, TOKEN, 3)

    def one(s: Column) -> Column:
        t = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        evidence = F.when(_has_mixture(t), _statistics(t)).otherwise(F.lit(0.0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), _length_class(s["end"] - s["start"]).alias("klass"), F.least(F.floor(evidence * BINS_PER), F.lit(BINS - 1)).cast("int").alias("bin"))

    return F.transform(spans, one)


def thresholds(docs: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each length class the least evidence bin that is reported (Benjamini-Hochberg on bins).

    The counts cover the tokens of every document; what comes to the driver is
    at most BINS counts for each length class.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.where(F.regexp_like(text, F.lit(TOKEN))).select(F.explode(_tested(text)).alias("t"))
    counts: dict[int, dict[int, int]] = {}
    for r in tokens.groupBy("t.klass", "t.bin").count().collect():
        counts.setdefault(r["klass"], {})[r["bin"]] = r["count"]
    out = {}
    for klass, by in counts.items():
        total, above = sum(by.values()), 0
        for b in sorted(by, reverse=True):
            above += by[b]
            if 10.0 ** (-b / BINS_PER) * total <= fdr * above:
                out[klass] = b  # the largest set of discoveries: the lowest bin that qualifies
    return out


def all_spans(text: Column, limits: dict[int, int]) -> tuple[Column, Column]:
    """(base, all) spans of a text column."""
    base = base_spans(text)
    if not limits:
        return base, base
    table = F.create_map(*[x for k, v in sorted(limits.items()) for x in (F.lit(k), F.lit(v))])
    strong = F.transform(F.filter(_tested(text), lambda t: t["bin"] >= F.coalesce(F.try_element_at(table, t["klass"]), F.lit(BINS))), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(3).alias("kind")))
    return base, strong.cast(SPAN)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: the base spans and all spans."""
    limits = thresholds(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    mine, all_ = "_base", "_spans"
    while {mine, all_} & set(docs.columns):
        mine, all_ = "_" + mine, "_" + all_
    base, strong = all_spans(text, limits)
    out = docs.withColumn(mine, base)
    if not limits:
        return out.withColumn(all_, F.col(mine)), mine, all_
    own = F.filter(strong, lambda s: ~F.exists(F.col(mine), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn(all_, F.array_sort(F.concat(F.col(mine), own))), mine, all_


def span_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found, mine, all_ = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter(mine, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col(mine)), 256).alias("base_sha256"), _joined(F.col(all_)).alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each merged span replaced by ``[SECRET]``."""

    gaps = "array<struct<a:int,b:int>>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b"))).cast(gaps)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    def pieces(x: Column) -> Column:
        # what lies between merged spans, in chunks as above
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{gaps}>").alias("out"))

        def chunk(acc: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(x, k + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), F.array().cast(gaps).alias("out")), step)
            return _let(own, lambda y: F.struct(y["at"].alias("at"), F.concat(acc["out"], F.array(y["out"])).alias("out")))

        kept = lambda y: F.array_join(F.transform(F.flatten(y["out"]), lambda g: F.concat(F.substring(text, g["a"] + 1, g["b"] - g["a"]), F.lit("[SECRET]"))), "")
        return _let(F.aggregate(F.sequence(F.lit(0), F.size(x) - 1, F.lit(CHUNK)), zero, chunk), lambda y: F.concat(kept(y), F.substring(text, y["at"] + 1, F.length(text))))

    return _let(spans, pieces)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars``, if there, counted anew."""
    found, _, all_ = with_spans(docs)
    text = F.when(F.size(all_) > 0, _replaced(F.col("text"), F.col(all_))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(all_) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
