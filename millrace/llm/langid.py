"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language. The counts of all orders follow
from those of the highest: a lower order counts the distinct characters seen
before a gram. Discounted probabilities and interpolation weights of all
languages lie in arrays sorted by gram hash, each gram with an entry for the
languages that have it, and a text's grams are looked up by binary search. The
language of lowest cross-entropy a symbol is chosen; a calibrated score and a
rejection come with it. Languages with fewer than ``OWN_ROWS`` calibration rows,
or none, have a limit too, a wider one. A letter is a symbol; beyond
``WIDE`` it is two, its page and its place in the page, so that none share one.

The models are fitted on a bounded sample of labelled rows: whole texts of
about ``SAMPLE_BYTES`` a language and ``ALL_BYTES`` in all, chosen by a hash of
the id among rows with a language and crc32(id) mod 5 other than 0; a single
text longer than a language's share isn't chosen. Every language is learned
and none of its grams is dropped. Rows with remainder 4 calibrate; the rest
are counted.

A null text and one without a letter is ``und`` with score 0 and rejected. If
no row may be learned from, every text is. Ties go to the language that sorts
first. Rows are handled alone; repeated rows give equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches

ORDER = 5
#: UTF-8 bytes of labelled texts that the sample aims at, of each language and in all.
SAMPLE_BYTES, ALL_BYTES = 1_500_000, 60_000_000
#: Entries of the matrices (grams, languages) that a batch is scored by at a time.
CHUNK = 1 << 22
#: Entries (grams, languages) of a table up to which a worker spreads it out as a matrix (8 MB).
DENSE = 1 << 21
#: Code points from which on a letter is two symbols.
WIDE = 2560
#: Cross-entropy a character from which a text counts as no language at all is the
#: calibration rows' mean plus this many deviations, wider for short texts.
REJECT_DEVIATIONS = 8.0
#: Calibration rows from which a language's own mean and deviation decide alone, and the
#: rows that the stand-ins count for where there are fewer.
OWN_ROWS, PRIOR_ROWS = 20, 2
_BITS, _PAD = 12, 1
_MASK = np.uint64((1 << _BITS) - 1)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, whether each is scored, and its text's number.

    Letters are lower-cased; each run of other characters is one space. Every
    text begins after ORDER - 1 pads, so that no context reaches another text.
    """
    lead = "\0" * (ORDER - 1)
    raw = np.frombuffer("".join(lead + t.lower() + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    pad = raw == 0  # a NUL within a text counts as a pad too: it is no letter
    letter = _letter_table()[raw]
    begins = np.r_[True, letter[:-1] | pad[:-1]]
    keep = letter | pad | begins
    sizes = [len(lead + t.lower()) + 1 for t in texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    raw, letter, pad, owner = raw[keep], letter[keep], pad[keep], owner[keep]
    wide = letter & (raw >= WIDE)
    ids = np.where(letter, np.where(wide, WIDE + np.minimum(raw >> np.uint32(8), 1023), raw), np.where(pad, np.uint32(_PAD), np.uint32(32))).astype(np.uint64)
    if wide.any():
        at = np.repeat(np.arange(len(ids)), 1 + wide)
        second = np.r_[False, at[1:] == at[:-1]]
        ids, pad, owner = np.where(second, WIDE + 1024 + (raw[at] & np.uint32(255)), ids[at]).astype(np.uint64), pad[at], owner[at]
    return ids, ~pad, owner


def _grams(ids: np.ndarray) -> np.ndarray:
    """The gram of ORDER symbols that ends at each place, newest symbol lowest."""
    g = ids.copy()
    for k in range(1, ORDER):
        g[k:] |= ids[:-k] << np.uint64(k * _BITS)
    return g


def _mix(g: np.ndarray, order: int) -> np.ndarray:
    """Hash of a gram of ``order`` symbols."""
    with np.errstate(over="ignore"):
        x = g + np.uint64(order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _low(g: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of each gram."""
    return g & np.uint64((1 << (order * _BITS)) - 1)


@dataclass
class Table:
    """Values by gram hash and language: sorted hashes, and for each the languages that have it."""

    keys: np.ndarray
    begins: np.ndarray
    langs: np.ndarray
    values: np.ndarray
    matrix: np.ndarray | None = None

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Table:
        """From each language's hashes (each once) and values."""
        h = np.concatenate([p[0] for p in parts])
        lang = np.repeat(np.arange(len(parts), dtype=np.uint16 if len(parts) < 1 << 16 else np.uint32), [len(p[0]) for p in parts])
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return cls(h[first], np.r_[first, len(h)], lang[order], np.concatenate([p[1] for p in parts])[order].astype(np.float32))

    def at(self, h: np.ndarray, n: int, missing: float) -> np.ndarray:
        """The values (hash, language), ``missing`` where there is none."""
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        if len(self.keys) * n <= DENSE:  # few languages: the same values as a matrix, which is faster to read
            if self.matrix is None:
                self.matrix = np.full((len(self.keys), n), missing, np.float32)
                self.matrix[np.repeat(np.arange(len(self.keys)), np.diff(self.begins)), self.langs] = self.values
            return np.where((self.keys[i] == h)[:, None], self.matrix[i], np.float32(missing))
        out = np.full((len(h), n), missing, np.float32)
        hit = np.flatnonzero(self.keys[i] == h)
        lo = self.begins[i[hit]]
        many = self.begins[i[hit] + 1] - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out[np.repeat(hit, many), self.langs[at]] = self.values[at]
        return out


@dataclass
class Models:
    """Models of all languages over common sorted hash arrays."""

    langs: list[str]
    uniform: float
    grams: list[Table]  # by order: discounted probabilities
    contexts: list[Table]  # by order: interpolation weights
    sharpness: float = 1.0
    limits: np.ndarray | None = None  # by language: mean and allowed deviation of the cross-entropy

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
        """From each language's grams of the highest order and their counts."""
        langs = sorted(counts)
        per: list[list] = [[] for _ in range(ORDER)]
        symbols: set[int] = set()
        for lang in langs:
            g, c = counts[lang]
            symbols.update(np.unique(_low(g, 1)).tolist())
            for k in range(ORDER, 0, -1):
                n1, n2 = int((c == 1).sum()), int((c == 2).sum())
                d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
                ctx, at = np.unique(g >> np.uint64(_BITS), return_inverse=True)
                total, kinds = np.bincount(at, c), np.bincount(at)
                per[k - 1].append((_mix(g, k), np.maximum(c - d, 0) / total[at], _mix(ctx, k + 100), d * kinds / total))
                g, c = np.unique(_low(g, k - 1), return_counts=True)  # distinct symbols before
                c = c.astype(float)
        grams = [Table.of([p[:2] for p in per[k]]) for k in range(ORDER)]
        contexts = [Table.of([p[2:] for p in per[k]]) for k in range(ORDER)]
        return cls(langs, 1 / (len(symbols) + 1), grams, contexts)

    def log_probabilities(self, g: np.ndarray) -> np.ndarray:
        """Interpolated log probability of each gram's last symbol, by language."""
        n = len(self.langs)
        p = np.full((len(g), n), self.uniform, np.float32)
        for k in range(1, ORDER + 1):
            own = _low(g, k)
            p = self.grams[k - 1].at(_mix(own, k), n, 0.0) + self.contexts[k - 1].at(_mix(own >> np.uint64(_BITS), k + 100), n, 1.0) * p
        return np.log(p)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a symbol (text, language), scored symbols, letters of each text."""
        ids, scored, owner = _symbols(texts)
        g, who = _grams(ids)[scored], owner[scored]
        ids = ids[scored]
        kinds, at = np.unique(g, return_inverse=True)
        n = np.bincount(who, minlength=len(texts))
        letters = np.bincount(who[ids != 32], minlength=len(texts))
        ce = np.zeros((len(texts), len(self.langs)))
        step = max(1, CHUNK // max(1, len(self.langs)))
        runs = [(0, slice(None))]
        if len(kinds) > step:  # symbols by gram, so that grams can be taken in runs
            order, ends = np.argsort(at, kind="stable"), np.r_[0, np.cumsum(np.bincount(at, minlength=len(kinds)))]
            runs = [(lo, order[ends[lo] : ends[min(lo + step, len(kinds))]]) for lo in range(0, len(kinds), step)]
        for lo, own in runs:
            logs, place, text = self.log_probabilities(kinds[lo : lo + step]), at[own] - lo, who[own]
            for j in range(len(self.langs)):
                ce[:, j] -= np.bincount(text, logs[place, j], len(texts))
        return ce / np.maximum(n, 1)[:, None], n, letters

    def calibrate(self, ce: np.ndarray, n: np.ndarray, letters: np.ndarray, langs: list[str]) -> None:
        """Fit the score's sharpness and the rejection limits on rows not counted: their entropies and languages."""
        # a language without rows: worse than a uniform guess among its symbols is no language
        chance = np.log1p(np.bincount(self.grams[0].langs, minlength=len(self.langs)))
        self.limits = np.stack([chance, np.full(len(chance), REJECT_DEVIATIONS * 0.5)], 1)
        if not len(ce):
            return
        truth = np.array([self.langs.index(x) if x in self.langs else -1 for x in langs])
        use = (letters > 0) & (truth >= 0)
        ce, n, truth = ce[use], n[use], truth[use]
        if not len(ce):
            return

        def loss(t: float) -> float:
            z = -t * ce * np.minimum(n, 200)[:, None]
            z -= z.max(1, keepdims=True)
            return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean())

        self.sharpness = min((0.02 * 1.25**i for i in range(20)), key=loss)
        kinds = np.bincount(truth, minlength=len(self.langs))
        own = ce[np.arange(len(ce)), truth]
        means = np.bincount(truth, own, len(self.langs)) / np.maximum(kinds, 1)
        dev = (own - means[truth]) * np.sqrt(np.minimum(n, 400))
        pooled = (dev**2).sum() / max(1, len(dev) - (kinds > 0).sum())
        for j, k in enumerate(kinds.tolist()):
            mean, var = means[j], dev[truth == j].var() if k else 0.0
            if k < OWN_ROWS:  # the mean is drawn to chance, the deviation to that of all languages
                mean = (k * mean + PRIOR_ROWS * chance[j]) / (k + PRIOR_ROWS)
                var = (k * var + PRIOR_ROWS * pooled) / (k + PRIOR_ROWS)
            self.limits[j] = mean, REJECT_DEVIATIONS * max(math.sqrt(var), 0.5)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, cross-entropy) for each text."""
        if not self.langs:
            return [("und", 0.0, True, None)] * len(texts)
        ce, n, letters = self.entropies(texts)
        best = ce.argmin(1)
        z = -self.sharpness * ce * np.minimum(n, 200)[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        score = z.max(1) / z.sum(1)
        low = ce[np.arange(len(ce)), best]
        mean, dev = self.limits[best, 0], self.limits[best, 1]
        far = np.isfinite(mean) & ((low - np.where(np.isfinite(mean), mean, 0)) * np.sqrt(np.clip(n, 1, 400)) > dev)
        return [(self.langs[b], float(s), bool(f), float(c)) if k else ("und", 0.0, True, None) for b, s, f, c, k in zip(best.tolist(), score.tolist(), far.tolist(), low.tolist(), letters.tolist(), strict=True)]


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, all_bytes: int = ALL_BYTES) -> Models:
    """Models of the languages in ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where("lang is not null and text is not null").where(_fold(F.col("doc_id")) != 0)
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("lang").collect()
    if not sizes:
        return Models([], 1.0, [], [])
    own = max(1, min(sample_bytes, all_bytes // len(sizes)))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1 << 30, math.ceil(own / max(1, r["bytes"]) * (1 << 30)))))])
    sample = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).where(F.octet_length("text") <= own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                ids, scored, _ = _symbols(texts)
                g, c = np.unique(_grams(ids)[scored], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(c, pa.int64())], names=["lang", "gram", "n"])

    counted = sample.where(_fold(F.col("doc_id")) != 4).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most a row for each symbol of the sample
    if not len(table):
        return Models([], 1.0, [], [])
    table = table.sort_by([("lang", "ascending"), ("gram", "ascending")])
    gram, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(float)
    lang = table["lang"].combine_chunks().dictionary_encode()
    codes, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
    cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
    models = Models.fit({names[codes[lo]]: (gram[lo:hi][o], n[lo:hi][o]) for lo, hi in zip(cuts, cuts[1:], strict=False) for o in [np.argsort(gram[lo:hi])]})
    sent = spark.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ce, n, letters = sent.value.entropies(b[0].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(list(ce), pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(letters, pa.int64()), b[1]], names=["ce", "n", "letters", "lang"])

    held = sample.where(_fold(F.col("doc_id")) == 4).select("text", "lang").mapInArrow(score, "ce array<double>, n long, letters long, lang string").toArrow()
    ce = np.array(held["ce"].to_pylist(), float).reshape(len(held), len(models.langs))
    models.calibrate(ce, held["n"].to_numpy(), held["letters"].to_numpy(), held["lang"].to_pylist())
    return models


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, cross_entropy) per row; only the text decides."""
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    sent = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = sent.value.predict([t or "" for t in b[1].to_pylist()])
                cols = [b[0], *zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")
    return out.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected, all columns as they were."""
    spark, names = docs.sparkSession, docs.schema.names
    small_batches(spark)
    ship(spark)
    sent, at = spark.sparkContext.broadcast(models), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array([not r[2] for r in sent.value.predict([t or "" for t in b[at].to_pylist()])]))

    return docs.mapInArrow(run, docs.schema)
