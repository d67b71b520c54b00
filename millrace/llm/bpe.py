"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of every new word. A proposal is
the true merge result exactly if each of its tokens is what its own characters
merge to, and each adjacent pair is *compatible*: no merge crosses the border
between the two. Merges happen in order of rank, so each token has a birth (the
rank that made it) and its border pieces are born and merged away at known
ranks; a pair is followed back from its whole tokens to their border
characters, always taking apart the piece that was made last, and a border
merge of lower rank than what merged the pieces away would have come first.
All adjacent pairs of a batch take these steps together as arrays: a search in
the sorted ranks for each step. Only words with a failing pair are merged
exactly.

Reads a ``tokenizers`` JSON file of a byte-level BPE with word ends: NFC,
lower case, words by pattern, bytes as characters, last one with ``</w>``. The
driver reads the file and broadcasts its bytes. Special tokens in a text become
their ids, as in the library. Decoding goes from ids. A null text
encodes as an empty one: no tokens, digests of the empty string. Rows are
handled alone; repeated rows and ties need nothing special.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, small_batches

TOKENIZER = "word_bpe_49k.json"
#: Words that a Python worker remembers; beyond it starts afresh.
REMEMBERED = 500_000
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(3)
def _pattern(top: int) -> re.Pattern:
    """The word pattern for texts of code points up to ``top``, for ``re``.

    Unicode categories are spelt out. A class with characters beyond the basic
    plane is slow to search, so texts without any get a pattern of their own.
    """
    runs: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(top + 1):
        own = runs.get(unicodedata.category(chr(c))[0])
        if own and own[-1][1] == c - 1:
            own[-1][1] = c
        elif own is not None:
            own.append([c, c])
    spelt = {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in runs.items()}
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{spelt['L']}]+|[{spelt['N']}]|[^{_WHITE}{spelt['L']}{spelt['N']}]+")


def _find(text: str) -> list[str]:
    top = 127 if text.isascii() else sys.maxunicode if _ASTRAL.search(text) else 0xFFFF
    return _pattern(top).findall(text)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """Exact encoder and decoder of one tokenizer file."""

    def __init__(self, source: str | bytes):
        """``source`` is the file's path, or its content as bytes."""
        spec = json.loads(source if isinstance(source, bytes) else open(source, "rb").read())
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = _byte_chars()
        self.words: dict[str, tuple[int, str]] = {}
        self.by_text = {str(i): t for i, t in self.tokens.items()}
        # merges by ids, sorted, with their ranks
        codes = np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in merges if a in self.vocab and b in self.vocab], np.int64)
        ranks = np.array([i for i, (a, b) in enumerate(merges) if a in self.vocab and b in self.vocab], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.code_ranks = codes[order], ranks[order]
        # of each token: its last merge (left, right, rank), -1 for characters; -2 while unknown, and whether its characters merge to it
        top = max(self.tokens) + 1
        self.left, self.right, self.birth = np.full(top, -2, np.int64), np.full(top, -2, np.int64), np.full(top, -1, np.int64)
        self.whole = np.zeros(top, bool)

    def normal(self, text: str) -> str:
        text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() would look at its context
            return "".join(c.lower() for c in text)
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        find = _find
        if not self.split or "<|" not in text:
            return find(self.normal(text))
        out: list[str] = []
        for part in self.split.split(text):
            # no word has white space, so it marks special tokens here
            out += [f" {part}"] if part in self.special else find(self.normal(part))
        return out

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode("utf-8")])

    def merge(self, parts: list[str]) -> list[str]:
        """Exact merging: the pair of least rank first, leftmost first."""
        rank, none = self.ranks.get, len(self.ranks)
        of = [rank(p, none) for p in zip(parts, parts[1:])]
        while of:
            best = min(of)
            if best == none:
                break
            at = of.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del of[at]
            if at:
                of[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(of):
                of[at] = rank((parts[at], parts[at + 1]), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap over linked symbols, for very long words."""
        import heapq

        n, ranks = len(parts), self.ranks
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (r := ranks.get((parts[k], parts[right[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[right[k]]))
        return [p for p, x in zip(parts, alive, strict=True) if x]

    def exact(self, s: str) -> list[int]:
        """Token ids of a word given as symbols."""
        parts = [*s[:-1], s[-1] + self.end]
        return [self.vocab[p] for p in (self.merge(parts) if len(parts) < 64 else self.merge_long(parts))]

    def propose(self, s: str) -> list[int]:
        vocab, end, n, at, out = self.vocab, self.end, len(s), 0, []
        while at < n:
            if n - at <= self.longest and (t := vocab.get(s[at:] + end)) is not None:
                out.append(t)
                break
            for stop in range(min(n - 1, at + self.longest), at, -1):
                if (t := vocab.get(s[at:stop])) is not None:
                    out.append(t)
                    at = stop
                    break
            else:
                return self.exact(s)
        return out

    def split_of(self, token: int) -> None:
        """Find out how a token's own characters merge, and enter its pieces."""
        t = self.tokens[token]
        core = t.removesuffix(self.end)
        parts = [*core[:-1], core[-1] + self.end] if t != core and core else [*core]
        if len(parts) < 2:
            self.left[token] = self.right[token] = -1
            self.whole[token] = True
            return
        rank, none = self.ranks.get, len(self.ranks)
        while len(parts) > 2:  # down to the last merge
            of = [rank(p, none) for p in zip(parts, parts[1:])]
            best = min(of)
            if best == none:
                break
            at = of.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        last = rank((parts[0], parts[1]), none) if len(parts) == 2 else none
        if last == none:
            self.left[token] = self.right[token] = -1
            return  # never the result of merging: no proposal with it stands
        self.left[token], self.right[token], self.birth[token] = self.vocab[parts[0]], self.vocab[parts[1]], last
        self.whole[token] = True

    def _known(self, tokens: np.ndarray) -> None:
        """Enter these tokens and all their pieces."""
        while len(tokens := np.unique(tokens[self.left[tokens] == -2])):
            for t in tokens.tolist():
                self.split_of(t)
            tokens = np.concatenate([self.left[tokens], self.right[tokens]])
            tokens = tokens[tokens >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays two tokens when their characters stand together (b < 0: a alone)."""
        self._known(np.concatenate([a, b[b >= 0]]))
        good = self.whole[a] & ((b < 0) | self.whole[np.maximum(b, 0)])
        at = np.flatnonzero(good & (b >= 0))
        x, y = a[at], b[at]
        never = np.int64(len(self.ranks) + 1)
        gone_x, gone_y = np.full(len(at), never), np.full(len(at), never)  # when each piece was merged away
        while len(at):
            code = x << 20 | y
            i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            rank = np.where(self.codes[i] == code, self.code_ranks[i], never)
            # at equal ranks the leftmost merge comes first: one inside x before the border's, one inside y after it
            crossed = (rank < gone_x) & (rank <= gone_y) & (rank < never)
            good[at[crossed]] = False
            bx, by = self.birth[x], self.birth[y]
            on = ~crossed & ((bx >= 0) | (by >= 0))
            at, x, y, gone_x, gone_y, bx, by = (v[on] for v in (at, x, y, gone_x, gone_y, bx, by))
            back_x = bx > by  # equal merges ran from left to right, so y's was the later one
            x, gone_x = np.where(back_x, self.right[x], x), np.where(back_x, bx, gone_x)
            y, gone_y = np.where(back_x, y, self.left[y]), np.where(back_x, gone_y, by)
        return good

    def learn(self, new: list[str]) -> None:
        """Encode new words: propose all, verify all pairs at once, mend failures."""
        plain = [w for w in new if w[0] != " "]
        for w in new:
            if w[0] == " ":
                self.words[w] = (1, str(self.special[w[1:]]))
        if not plain:
            return
        spelt = [self.symbols(w) for w in plain]
        proposed = [self.propose(s) for s in spelt]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        ids = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        last = np.cumsum(sizes) - 1
        after = np.empty_like(ids)
        after[:-1] = ids[1:]
        after[last] = -1
        keep = np.ones(len(ids), bool)
        keep[last[sizes > 1]] = False  # the last token has no right neighbour
        codes, where = np.unique(ids[keep] << 20 | (after[keep] + 1), return_inverse=True)
        verdicts = self.compatible(codes >> 20, (codes & 0xFFFFF) - 1)
        owner = np.repeat(np.arange(len(plain)), sizes)[keep]
        good = np.ones(len(plain), bool)
        good[owner[~verdicts[where]]] = False
        for w, s, p, ok in zip(plain, spelt, proposed, good.tolist(), strict=True):
            if not ok:
                p = self.exact(s)
            self.words[w] = (len(p), " ".join(map(str, p)))

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: the number of tokens, their ids and the decoded text, space-joined."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        split = [self.pieces(t) for t in texts]
        known = self.words
        self.learn([w for w in dict.fromkeys(w for p in split for w in p) if w not in known])
        out = []
        for p in split:
            got = [known[w] for w in p]
            ids = " ".join([g[1] for g in got])
            out.append((sum([g[0] for g in got]), ids, self.decode(ids)))
        return out

    def decode(self, ids: str) -> str:
        """Of ids joined by spaces, as the library without a decoder: token strings joined by spaces."""
        return " ".join([*map(self.by_text.__getitem__, ids.split(" "))]) if ids else ""


@lru_cache(2)
def encoder(source: str | bytes) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    return Encoder(source)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def _mapped(docs: DataFrame, path: str, make, schema: pa.Schema, ddl: str, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        for batch in batches:
            if batch.num_rows:
                rows = [make(d, *g) for d, g in zip(batch[0].to_pylist(), enc.encode_batch([t or "" for t in batch[1].to_pylist()]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, ddl)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: token count and digests of its ids and of the decoded text."""
    return _mapped(docs, path, lambda d, n, ids, text: (d, n, _sha(ids), _sha(text)), _SCHEMA, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its token ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _mapped(docs, path, lambda d, n, ids, text: (d, [*map(int, ids.split())]), schema, "doc_id long, ids array<int>", id_col, text_col)
