"""Main text of web pages: block roles, and a suffix array for each host.

``parse`` turns a page into blocks and tells by structure which lie in the
main container (``article``, else ``main``, else a content class), which are
menus, notices, forms and the like, and which are undecided.

Boilerplate is what a host repeats: substrings of ``DEPTH`` tokens or more, in
blocks outside main containers, that ``PAGES`` different pages or more show. The
token streams of a host's pages are concatenated and their suffixes sorted;
neighbours that share ``DEPTH`` tokens are one class, and a place is covered if a
class of enough pages begins up to ``DEPTH - 1`` tokens before it. Suffixes
needn't be sorted further: a longer repeat is the union of the overlapping ones
of ``DEPTH`` tokens. They are ordered by prefix doubling, and the last step
joins two ranks that overlap. Each task sorts the suffixes of its own batch, emits every
class of equal suffixes with at most ``PAGES`` of its pages, and the classes
meet by (host, class) in partly aggregated shuffles; so a host with a third of
all pages is gathered nowhere. Covered runs are removed from undecided blocks; the
unique runs stay. Hosts where every page has a main container need none of
this and skip it.

"Different pages" differ in url and body: those of equal url and those whose
text outside menus is nearly equal (MinHash, ``NEAR``) are linked, and each
connected group counts once, so copies and recaptures are no evidence. From main
containers only goes what undecided blocks of ``PAGES`` pages show; a passage that
others show only in menus, asides and the like (a teaser) or in main containers
is content however often it is repeated. Null html is empty text. A null or broken url belongs to the
host "". Repeated rows, ties and null ids give one result row each; an empty
table none. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, bits_set, cut, ship, small_batches
from .graph import components

#: Tokens that a repeated substring has at least, and the different pages that show it.
DEPTH, PAGES = 12, 3
#: Least share of equal MinHash values of nearly equal pages; bands and values in each.
NEAR, BANDS, BAND_ROWS = 0.7, 16, 4
#: Bits of the filter that picks the pages to look at again (4 MB in all).
FILTER_BITS = 1 << 25
MAIN, OUTSIDE, UNDECIDED = 0, 1, 2

_MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[/a-zA-Z!?][^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes that tell what an element is for.
_TELLS = re.compile(r"class|id|role|hidden|itemprop", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
_EDGE = frozenset("article aside body fieldset footer form header main nav section table td th".split())
_SKIP = frozenset("aside button canvas datalist dialog footer form head menu nav object search select svg audio video map".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELL = frozenset("td th".split())
#: What an opening tag closes, and where the search for it ends.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": (_CELL, {"tr", "table"}), "th": (_CELL, {"tr", "table"})}
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_SKIP_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead toolbar pagination pager social share sharing related recommended recommendations widget widgets "
    "comment comments disqus respond replies skip hidden disclaimer copyright search".split()
)
_COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|page|main)?[-_]?(?:content|body|text|article)(?:$|[\s_-])", re.I)


#: What surrounds a place in a page: (skip, in a header, in a heading, container 0/1/2, content class).
_Around = tuple[bool, bool, bool, int, bool]
_OUTERMOST: _Around = (False, False, False, 0, False)


@lru_cache(100_000)
def _within(name: str, raw: str, up: _Around) -> _Around:
    """What surrounds the text within an element ``name`` with attributes ``raw``."""
    skip, header, heading, main, content = up
    skip = skip or name in _SKIP
    if name == "header":
        header, skip = header or main == 2, skip or main != 2  # in an article it may hold the heading
    if raw and name not in ("html", "body"):
        at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
        role, named = at.get("role", "").lower(), f"{at.get('class', '')} {at.get('id', '')}"
        parts = {p.lower() for p in _PART.findall(named)}
        if "hidden" in at or role in _SKIP_ROLES or parts & (_COMMENT_WORDS if name in ("article", "main") else _SKIP_WORDS):
            skip = skip or not (name == "header" and main == 2 and not parts & _COMMENT_WORDS)
        if role == "main":
            main = max(main, 1)
        if not skip and ("articlebody" in at.get("itemprop", "").lower() or _CONTENT.search(named)):
            content = True
    if name == "article":
        main = 2
    elif name == "main":
        main = max(main, 1)
    return skip, header, heading or name in _HEADINGS, main, content


def parse(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order, as (role, text)."""
    stack: list[tuple[str, _Around]] = []
    top, state = _OUTERMOST, (False, 0, False)
    open_: dict[str, int] = {}
    blocks: list[tuple[tuple[bool, int, bool], str]] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append((state, text))

    def close(names, ends) -> None:
        nonlocal top
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                for f in stack[i:]:
                    open_[f[0]] -= 1
                del stack[i:]
                top = stack[-1][1] if stack else _OUTERMOST
                return
            if stack[i][0] in ends:
                return

    at, n, search = 0, len(page), _MARKUP.search
    while m := search(page, at):
        start = m.start()
        if start > at:
            now = (top[0] or (top[1] and not top[2]), top[3], top[4])
            if now != state:
                if parts:
                    flush()
                state = now
            text = page[at:start]
            parts.append(htmllib.unescape(text) if "&" in text else text)
        at = m.end()
        ends, name, raw, ends2, name2, raw2 = m.groups()
        name = name or name2
        if not name:
            continue
        name = name.lower()
        block = name in _BLOCK
        if block:
            if parts:
                flush()
        elif name in _CELL:
            parts.append(" ")
        if ends or ends2:
            if open_.get(name):
                close((name,), () if name in _EDGE else _EDGE)
            continue
        if block:
            if open_.get("p"):
                close(("p",), _EDGE)
        elif name == "br":
            parts.append(" ")
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            continue
        if name in _VOID:
            continue
        if name in _CLOSES and any(open_.get(x) for x in _CLOSES[name][0]):
            close(*_CLOSES[name])
        raw = raw or raw2 or ""
        inner = _within(name, raw if raw and _TELLS.search(raw) else "", top)
        if block or inner[0] or name in _EDGE:
            stack.append((name, inner))
            open_[name] = open_.get(name, 0) + 1
            top = inner
    if at < n:
        now = (top[0] or (top[1] and not top[2]), top[3], top[4])
        if now != state:
            if parts:
                flush()
            state = now
        parts.append(htmllib.unescape(page[at:]))
    flush()
    for has in (lambda s: s[1] == 2, lambda s: s[1] == 1, lambda s: s[2]):
        if any(has(s) and not s[0] for s, _ in blocks):
            return [(MAIN if has(s) and not s[0] else OUTSIDE, t) for s, t in blocks]
    return [(OUTSIDE if s[0] else UNDECIDED, t) for s, t in blocks]


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    """Powers of the hash's base and of its inverse, at least ``n`` of each."""
    global _powers
    if _powers.shape[1] < n:
        step = np.empty((2, max(n, 1 << 16)), np.uint64)
        step[:, 0], step[0, 1:], step[1, 1:] = 1, _P, _P_INVERSE
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(step, axis=1)
    return _powers


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in a row, and each one's text.

    A token's hash is a polynomial in its bytes, as a difference of running
    sums over all bytes; tokens are what blanks and line feeds separate.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = (data == 32) | (data == 10)
    begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.flatnonzero(blank & ~np.r_[True, blank[:-1]])
    up, down = _power_table(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[begins]) * down[begins]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), begins, side="right")
    return h ^ (h >> np.uint64(32)), owner


def _classes(tokens: np.ndarray) -> np.ndarray:
    """A hash of the DEPTH tokens that begin at each place."""
    h, k = tokens, 1
    with np.errstate(over="ignore"):
        while k < DEPTH and len(tokens) >= DEPTH:
            more = min(k, DEPTH - k)
            h = (h[:-more] * _P ^ (h[:-more] >> np.uint64(29))) * np.uint64(2 * k + 1) + h[more:]
            k += more
    return h if len(tokens) >= DEPTH else h[:0]


def suffix_classes(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of concatenated streams, sorted to DEPTH tokens.

    ``owner`` tells each token's stream. Returns the places in sorted order and
    the rank of each place's class of equal suffixes. Suffixes with fewer than
    DEPTH tokens left in their stream are left out.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < DEPTH and len(tokens) >= DEPTH:  # prefix doubling: ranks by 2k tokens, in the end by DEPTH, from ranks by k
        more = min(k, DEPTH - k)
        rank = np.unique(rank[:-more] * (int(rank.max()) + 1) + rank[more:], return_inverse=True)[1].astype(np.int64)
        k += more
    places = np.arange(max(0, len(tokens) - DEPTH + 1))
    places = places[owner[places] == owner[places + DEPTH - 1]]
    order = places[np.argsort(rank[places], kind="stable")] if len(places) else places
    return order, rank[order]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url.strip()).hostname or "") if url else ""
    except ValueError:
        return ""


def _id64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.int64()), ("page", pa.int64()), ("main", pa.bool_()), ("text", pa.string()), ("around", pa.string()), ("roles", pa.string())])
_READ_DDL = "page_id long, url string, host long, page long, main boolean, text string, around string, roles string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with what structure keeps, and their blocks outside main containers with a digit for each one's role."""
    for b in batches:
        if not b.num_rows:
            continue
        rows = []
        for page_id, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
            blocks = parse(page or "")
            around = [(role, t) for role, t in blocks if role != MAIN]
            rows.append((page_id, url, _id64(host_of(url)), _id64(page or ""), all(role != UNDECIDED for role, _ in blocks), "\n\n".join([t for role, t in blocks if role != OUTSIDE]), "\n\n".join([t for _, t in around]), "".join([str(role) for role, _ in around])))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


_SKETCH = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("values", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHash values of each page's body, and keys (bands and url) that linked pages of a host share."""
    seeds = np.random.default_rng(7).integers(1, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) | np.uint64(1)
    for b in batches:
        if not b.num_rows:
            continue
        node, host, url, text, around = (b[k] for k in ("node", "host", "url", "text", "around"))
        hosts, urls = host.to_numpy().view(np.uint64), [(u or "").strip() for u in url.to_pylist()]
        keys, values = [], []
        for i, (t, other) in enumerate(zip(text.to_pylist(), around.to_pylist(), strict=True)):
            h, _ = _tokens([t or other or ""])
            with np.errstate(over="ignore"):
                pairs = h[:-1] * _P + h[1:] if len(h) > 1 else np.r_[h, np.zeros(int(not len(h)), np.uint64)]
                x = (pairs ^ (pairs >> np.uint64(31))) * seeds
                least = (x ^ (x >> np.uint64(29))).min(1)
                bands = np.arange(BANDS, dtype=np.uint64) + hosts[i]
                for v in least.reshape(BANDS, BAND_ROWS).T:
                    bands = (bands * _P ^ (bands >> np.uint64(32))) + v
            own = bands.view(np.int64).tolist()
            keys.append([*own, _id64(f"{hosts[i]} {urls[i]}")] if urls[i] else own)
            values.append(least.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([node, pa.array(keys, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))], schema=_SKETCH)


def same_pages(pages: DataFrame) -> DataFrame:
    """(node, component) of pages (node, host, url, text, around) that have others of equal url or nearly equal body."""
    sketch = cut(pages.mapInArrow(_sketch, "node long, `keys` array<long>, `values` array<long>"), "sketches")
    keys = sketch.select("node", F.posexplode("keys").alias("at", "key"))
    least = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    near = cut(keys.join(least, "key").where("node != least").groupBy("node", "least").agg(F.max("at").alias("at")), "near")
    bodies = sketch.groupBy("node").agg(F.first("values").alias("values"))
    other = bodies.join(near.select(F.col("least").alias("node")).distinct(), "node").toDF("least", "others")
    equal = F.aggregate(F.zip_with("values", "others", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    edges = near.join(bodies, "node").join(other, "least").where((F.col("at") == BANDS) | (equal >= NEAR * BANDS * BAND_ROWS))
    return components(cut(edges.select(F.col("node").alias("a"), F.col("least").alias("b")), "same"))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix classes of each host's pages in the batch, with up to PAGES of their groups of pages, in any blocks and in undecided ones."""
    for b in batches:
        hosts = b["host"].to_numpy()
        for host in np.unique(hosts).tolist():
            own = b.filter(pa.array(hosts == host))
            texts = own["around"].to_pylist()
            tokens, owner = _tokens(texts)
            order, rank = suffix_classes(tokens, owner)
            if not len(order):
                continue
            free = np.concatenate([np.repeat(r == str(UNDECIDED), len(x.split(" "))) for t, roles in zip(texts, own["roles"].to_pylist(), strict=True) if t for x, r in zip(t.split("\n\n"), roles, strict=True)])
            runs = np.r_[0, np.cumsum(free)]
            free = (runs[DEPTH:] - runs[:-DEPTH])[order] == DEPTH
            groups, group = np.unique(own["component"].to_numpy(), return_inverse=True)
            pair = rank * len(groups) + group[owner[order]]
            name = _classes(tokens)[order].view(np.int64)
            for only, is_free in ((free, True), (slice(None), False)):
                found, at = np.unique(pair[only], return_index=True)
                first = np.flatnonzero(np.r_[True, np.diff(found // len(groups)) > 0])[: len(found)]
                nth = np.arange(len(found)) - np.repeat(first, np.diff(np.r_[first, len(found)]))
                at, found = at[nth < PAGES], found[nth < PAGES]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), host, np.int64)), pa.array(name[only][at]), pa.array(groups[found % len(groups)]), pa.array(np.full(len(at), int(is_free), np.int32))], names=["host", "class", "component", "free"])


_ASKED = ("node", "host", "url", "text", "around", "roles")


def repeats(read: DataFrame) -> DataFrame:
    """(host, class, free): suffix classes outside main containers that PAGES different pages of a host share, and whether in undecided blocks."""
    spark = read.sparkSession
    asking = spark.sparkContext.broadcast(bit_filter(F.col("host"), read.where("not main").select("host"), FILTER_BITS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of hosts that have an undecided page; one let through by chance adds nothing that is asked for."""
        for b in batches:
            if b.num_rows:
                own = b.filter(pa.array(bits_set(asking.value, b["host"].to_numpy() & np.int64(FILTER_BITS - 1))))
                node = own["host"].to_numpy() ^ own["page"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node), *(own[c] for c in _ASKED[1:])], names=list(_ASKED))

    pages = read.select("host", "page", *_ASKED[2:]).mapInArrow(ask, "node long, host long, url string, text string, around string, roles string")
    same = cut(same_pages(pages), "groups")
    counted = pages.join(same, "node", "left").select("host", F.coalesce("component", "node").alias("component"), "around", "roles")
    classes = counted.mapInArrow(_suffixes, "host long, `class` long, component long, free int")
    by_page = classes.groupBy("host", "class", "component").agg(F.max("free").alias("free"))
    return by_page.groupBy("host", "class").agg(F.count("*").alias("n"), F.sum("free").alias("free")).where(F.col("n") >= PAGES).select("host", "class", (F.col("free") >= PAGES).alias("free"))


def unique_runs(text: str, removed: np.ndarray) -> str:
    """The blocks of ``text`` without what removed classes cover.

    A block goes if all of its tokens are covered. Of any other, those tokens go
    that a repeat within the block covers: one that runs in from a neighbour
    takes no part of it.
    """
    blocks = text.split("\n\n")
    tokens, _ = _tokens([text])
    block = np.repeat(np.arange(len(blocks)), [len(t.split(" ")) for t in blocks])
    at = np.flatnonzero(np.isin(_classes(tokens), removed))

    def left(starts: np.ndarray) -> np.ndarray:
        covered = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + DEPTH, -1)
        return np.cumsum(covered)[:-1] == 0

    whole, within = left(at), left(at[block[at] == block[at + DEPTH - 1]])
    out = []
    for i, t in enumerate(blocks):
        own = slice(*np.searchsorted(block, [i, i + 1]))
        if whole[own].any():
            kept = [x for x, k in zip(t.split(" "), within[own].tolist(), strict=True) if k]
            out += [" ".join(kept)] if kept else []
    return "\n\n".join(out)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_OUT_DDL = "page_id long, url string, text string, n_chars long"
_DOUBT_DDL = "page_id long, url string, host long, page long, main boolean, text string, classes array<long>"


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    spark = pages.sparkSession
    small_batches(spark)
    ship(spark)
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    read = cut(p.mapInArrow(_read, _READ_DDL), "pages")
    found = cut(repeats(read), "repeats")
    bits = spark.sparkContext.broadcast(bit_filter(F.col("host").bitwiseXOR(F.col("class")), found, FILTER_BITS))

    def classes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Classes of a batch's texts that may be repeats, and the rows they are in."""
        tokens, owner = _tokens([t or "" for t in b["text"].to_pylist()])
        c = _classes(tokens).view(np.int64)
        own = owner[: len(c)]
        at = (c ^ b["host"].to_numpy()[own]) & np.int64(FILTER_BITS - 1)
        hit = bits_set(bits.value, at)
        hit &= own == owner[DEPTH - 1 : DEPTH - 1 + len(c)]
        return c[hit], own[hit]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = np.ones(b.num_rows, bool)
                keep[classes(b)[1]] = False
                own = b.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([own["page_id"], own["url"], own["text"], pc.utf8_length(own["text"]).cast(pa.int64())], schema=_OUT)

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c, own = classes(b)
                at = np.unique(own)
                if len(at):
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array([np.unique(c[own == i]) for i in at], pa.list_(pa.int64()))], names=["page_id", "url", "host", "page", "main", "text", "classes"])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = [unique_runs(t, np.array(gone, np.int64).view(np.uint64)) if gone else t for t, gone in zip(b["text"].to_pylist(), b["gone"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_OUT)

    kept = read.select("page_id", "url", "host", "page", "main", "text")
    doubt = cut(kept.mapInArrow(doubtful, _DOUBT_DDL), "doubtful")
    # copies of a page ask the same, so they fall together before the join
    asked = doubt.select("host", "page", "main", F.explode("classes").alias("class")).distinct().join(found, ["host", "class"]).where("free or not main")
    gone = asked.groupBy("host", "page").agg(F.collect_list("class").alias("gone"))
    mended = doubt.join(gone, ["host", "page"], "left").select("page_id", "url", "text", "gone").mapInArrow(mend, _OUT_DDL)
    return kept.mapInArrow(plain, _OUT_DDL).unionByName(mended)
