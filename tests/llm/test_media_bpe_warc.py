import hashlib
import random
import zlib

import pytest

from millrace.llm import bpe, media, warc
from millrace.llm.common import scratch, table

from .fixtures import awkward, empty, with_clashes


def test_media_round_trip(spark, sf):
    for docs in (table(spark, sf, "documents"), awkward(spark), with_clashes(awkward(spark))):
        want = []
        for r in docs.collect():
            raw = (r.text or "").encode()
            n = max(576, -(-len(raw) // 576) * 576)
            p = raw.ljust(n, b"\xff")
            want.append((r.doc_id or 0, len(raw), n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
        rows = media.media_columns(docs).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
        assert all("cc_errors=0" in r.feature and all(r.random_access) and r.pts == sorted(r.pts) for r in rows)
    assert media.media_columns(empty(spark)).count() == 0


def test_media_stream_is_checked():
    s = bytearray(media.mux(b"ab" * 288 * 60))
    assert media.demux(bytes(s))["errors"] == 0 and len(s) % 188 == 0
    lost = bytes(s[: 188 * 40] + s[188 * 41 :])
    with pytest.raises(ValueError):
        media.demux(lost)
    s[188 * 5 + 3] ^= 1
    assert media.demux(bytes(s))["errors"] > 0


def test_bpe_equals_the_library(spark, sf):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(bpe.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    for docs in (table(spark, sf, "documents"), awkward(spark), with_clashes(awkward(spark))):
        want = []
        for r in docs.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((r.doc_id or 0, *r[1:]) for r in bpe.encode_digests(docs, P.path(bpe.TOKENIZER)).collect()) == sorted(want)
    e, r = bpe.encoder(P.path(bpe.TOKENIZER)), random.Random(7)
    pool = "abcdefghijklmnopqrstuvwxyzABC'’ \n\t0123456789.,!?éÉßİıΣσς中文字😀́‍<|>\x00\x1f\x85\xa0-_/\\#@&àÀ"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    texts += ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", " <|endoftext|> x", "'S 'LL it's"]
    for text, (n, ids, decoded) in zip(texts, e.encode_batch(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want), repr(text)
        assert decoded == t.decode(want, skip_special_tokens=False), repr(text)
    assert bpe.encode_digests(empty(spark), P.path(bpe.TOKENIZER)).count() == 0


PAGES = "page_id long, url string, html string"


def test_warc_edges(spark):
    rows = [(1, "http://a.org/x y", "<p>é</p>"), (2, "http://b.a.org/", "<p>é</p>"), (3, None, None), (4, "::bad[", ""), (None, "http://a.org/", "z"), (5, "http://a.org/x y", "q" * 300_000), (5, "http://a.org/x y", "q" * 300_000)]
    got = warc.archive_round_trip(spark, spark.createDataFrame(rows, PAGES)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7
    assert (by[1].record_type, by[1].refers_to) == ("revisit", 2) and by[2].record_type == "response"
    assert (by[3].record_type, by[3].refers_to, by[3].payload_bytes) == ("revisit", 4, 0)
    assert by[5].record_type == "response" and by[5].payload_bytes == 300_000
    assert by[None].record_type == "response"
    assert warc.archive_round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_warc_index(spark, sf):
    pages = table(spark, sf, "pages")
    root = scratch(spark, "warc-test")
    captures = warc.write_archives(pages, root)
    index = warc.CaptureIndex(warc.build_index(captures, root, block_rows=7))
    rows = pages.collect()
    for r in rows:
        own = [x for x in rows if warc.surt(x.url) == warc.surt(r.url)]
        found = index.lookup(r.url)
        assert len(found) == len(own)
        assert any(p == r.html.encode() for _, _, p in found) or all(h["WARC-Type"] == "revisit" for h, _, _ in found)
    assert index.lookup("http://nowhere.example/") == []
    assert index.keys == sorted(index.keys)


@pytest.mark.parametrize("hot", [1, 1000])
def test_warc_equal_payloads_and_odd_urls(spark, monkeypatch, hot):
    """Against plain code, with the repeated payloads joined (hot = 1) and with them written where they are read."""
    import base64

    monkeypatch.setattr(warc, "HOT", hot)
    r = random.Random(9)
    urls = [None, "", "http://a.org/\x01\x1f x", "http://a.org/~a b", "HTTP://WWW.a.org/~a b", "http://b.org/", "\x7f\x00", "http://é.org/ü?q=1"]
    rows = [(i, r.choice(urls), r.choice([None, "", "same" * 50, "é" * 9, f"own {i}"]), "x") for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, sha string").selectExpr("*", "1 AS key", "2 AS keeper", "3 AS file", "4 AS n")
    keeper = {}
    for i, _, h, _ in rows:
        keeper[h or ""] = max(i, keeper.get(h or "", 0))
    want = []
    for i, _, h, _ in rows:
        raw, k = (h or "").encode(), keeper[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == k else "revisit", None if i == k else k))
    assert sorted(map(tuple, warc.archive_round_trip(spark, docs).collect())) == want
    root = scratch(spark, "with a blank")
    captures = warc.write_archives(docs, root)
    assert sorted(map(tuple, warc.read_archives(captures).collect())) == want
    index = warc.build_index(captures, root, block_rows=7)
    assert sorted(map(tuple, warc.lookup_all(docs.select("url"), index).collect())) == want
    some = docs.where("url = 'http://b.org/' or url = ''").select("url")
    assert sorted(x.page_id for x in warc.lookup_all(some, index).collect()) == [i for i, u, _, _ in rows if u in (None, "", "http://b.org/")]


def packets(stream):
    return [stream[i : i + 188] for i in range(0, len(stream), 188)]


def renumbered(parts, pid):
    """The packets of a PID with its continuity counted anew."""
    out, n = [], 0
    for p in parts:
        q = bytearray(p)
        if (q[1] & 31) << 8 | q[2] == pid and q[3] & 0x10:
            q[3] = q[3] & 0xF0 | n & 15
            n += 1
        out.append(bytes(q))
    return out


def test_legal_packets_are_no_errors():
    payload = bytes(range(256)) * 9 * 30
    stream = media.mux(payload)
    parts = packets(stream)
    null = b"\x47\x1f\xff\x10" + b"\xff" * 184
    clock_only = b"\x47\x01\x00\x20" + bytes((183, 0x10)) + b"\x00" * 182
    told = bytearray(parts[9])
    told[3:] = bytes((0x20 | told[3] & 0x1F, 1, 0x80)) + bytes(183)
    for changed in (parts[:7] + [parts[6]] + parts[7:], parts[:5] + [null, null] + parts[5:], parts[:8] + [clock_only] + parts[8:]):
        got = media.demux(b"".join(changed))
        assert got["errors"] == got["lost"] == 0 and got["payload"] == payload
    assert media.demux(b"".join(parts[:7] + [parts[6], parts[6]] + parts[7:]), strict=False)["errors"] > 0


def test_losses_are_reported():
    payload = bytes(range(251)) * 576
    parts = packets(media.mux(payload))
    whole = media.demux(b"".join(parts))
    units = [payload[i : i + media.UNIT] for i in range(0, len(payload), media.UNIT)]
    got = media.demux(b"".join(parts[:40] + parts[41:]), strict=False)
    assert got["errors"] == 1 and got["lost"] == 1 and got["payload"] == b"".join(units[1:]) and got["pts"] == whole["pts"][1:]
    damaged = bytearray(b"".join(parts))
    damaged[188 * 200 + 1] |= 0x80
    got = media.demux(bytes(damaged), strict=False)
    assert got["errors"] == 2 and got["lost"] == 1 and len(got["payload"]) < len(payload)


def test_several_programs_and_long_tables():
    payload = b"xyz" * 192 * 100
    one = packets(media.mux(payload))
    pat = media._section(0x00, 1, bytes((0, 0, 0xE0, 0x10, 0, 1, 0xF0, 0x00, 0, 2, 0xF0, 0x01)))
    info = bytes((0xE2, 0x00, 0xF0, 255)) + b"\x05\xfd" + b"n" * 253 + bytes((0x06, 0xE2, 0x00, 0xF0, 0))  # longer than a packet
    pmt = media._section(0x02, 2, info)
    first = b"\x47\x50\x01\x10\x00" + pmt[:183]
    rest = b"\x47\x10\x01\x11" + pmt[183:].ljust(184, b"\xff")
    other = []
    for p in one:
        if p[1] & 31 == 1 and p[2] == 0:
            other.append(bytes((0x47, p[1] & 0x40 | 2, 0)) + p[3:])
    mixed = [media._table_packet(0, pat).tobytes(), one[1], first, rest]
    own = [p for p in one if p[1] & 31 == 1 and p[2] == 0]
    for a, b in zip(own, other, strict=True):
        mixed += [a, b]
    got = media.demux(b"".join(mixed))
    assert got["programs"] == {1: 0x1000, 2: 0x1001} and got["network"] == 0x10 and got["streams"] == {0x100: 6, 0x200: 6}
    assert got["units"][0x100]["payload"] == got["units"][0x200]["payload"] == payload and got["errors"] == 0


def test_bpe_pairs_against_merging():
    """Compatibility by steps equals merging the characters of both tokens."""
    P = pytest.importorskip("public_tokenizers")
    import numpy as np

    e, r = bpe.encoder(P.path(bpe.TOKENIZER)), random.Random(3)
    ids = [i for t, i in e.vocab.items() if t.removesuffix(e.end)]
    inner = [i for i in ids if not e.tokens[i].endswith(e.end)]
    short = [i for i in inner if len(e.tokens[i]) < 4]
    pairs = [(r.choice(inner), r.choice(ids)) for _ in range(3000)] + [(r.choice(short), r.choice(short)) for _ in range(6000)] + [(i, i) for i in inner[:3000]] + [(i, -1) for i in ids[:3000]]

    def by_merging(a, b):
        whole = e.tokens[a] + (e.tokens[b] if b >= 0 else "")
        core = whole.removesuffix(e.end)
        parts = [*core[:-1], core[-1] + e.end] if whole != core else [*core]
        return e.merge(parts) == ([e.tokens[a], e.tokens[b]] if b >= 0 else [e.tokens[a]])

    a, b = np.array(pairs).T
    assert e.compatible(a, b).tolist() == [by_merging(x, y) for x, y in pairs]
