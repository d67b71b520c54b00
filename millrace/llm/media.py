"""Media columns: payload bytes in stored MPEG transport streams.

``mux`` wraps a payload of 8-bit samples in a single-program transport
stream (PAT, PMT, PES with PTS, PCR and random-access flags). ``media_streams``
makes a column of them; ``media_columns`` stores it in the shared folder and
reads the stored bytes back. ``demux`` reads any such stream from its packets:
it parses the program tables, whose sections may span packets, checks the
continuity counters of every PID, reassembles the elementary packets of every
stream and lists time stamps and random-access points. Null packets, packets
without payload, legal duplicates and signalled discontinuities are no errors.
A unit that misses packets is left out and counted (``strict`` raises instead).

Null texts count as empty; an empty text is one frame of padding. Equal texts
give equal streams. Each row is handled alone, so repeated rows, ties and
very long texts need nothing special.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut, map_rows

PACKET = 188
FRAME = 576
UNIT = 28 * FRAME  # bytes of payload in one elementary packet (access unit)
PMT_PID, ES_PID, NULL_PID = 0x1000, 0x0100, 0x1FFF
STREAM_TYPE = 0x06  # private data in PES packets
TICKS = 90_000 * UNIT // 48_000  # 48,000 samples a second on a 90 kHz clock
FIRST_PTS = 90_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    n = 5 + len(body) + 4
    head = bytes((table_id, 0xB0 | n >> 8, n & 255, number >> 8, number & 255, 0xC1, 0, 0)) + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes((0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0)) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(0, _section(0x00, 1, bytes((0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255))))
_PMT = _table_packet(PMT_PID, _section(0x02, 1, bytes((0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0))))


def _pts(v: int) -> bytes:
    return bytes((0x21 | (v >> 29) & 0x0E, (v >> 22) & 255, 0x01 | (v >> 14) & 0xFE, (v >> 7) & 255, 0x01 | (v << 1) & 0xFE))


def _unit(data: bytes, k: int, cc: int) -> np.ndarray:
    """The packets of access unit ``k``: tables, then one elementary packet."""
    pts = (FIRST_PTS + k * TICKS) & 0x1FFFFFFFF
    size = len(data) + 8
    pes = np.frombuffer(b"\x00\x00\x01\xbd" + size.to_bytes(2, "big") + b"\x84\x80\x05" + _pts(pts) + data, np.uint8)
    rest = len(pes) - 176  # the first packet has 8 bytes of adaptation field
    full, tail = divmod(rest, 184)
    n = 1 + full + (tail > 0)
    out = np.full((n + 2, PACKET), 255, np.uint8)
    out[0], out[1] = _PAT, _PMT
    out[0, 3] = out[1, 3] = 0x10 | k & 15
    es = out[2:]
    es[:, 0], es[:, 1], es[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
    es[:, 3] = 0x10 | (np.arange(cc, cc + n) & 15).astype(np.uint8)
    base = pts - 9_000
    es[0, 1] |= 0x40
    es[0, 3] |= 0x20
    es[0, 4:12] = (7, 0x50, base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0)
    es[0, 12:] = pes[:176]
    if full:
        es[1 : 1 + full, 4:] = pes[176 : 176 + full * 184].reshape(full, 184)
    if tail:
        es[-1, 3] |= 0x20
        es[-1, 4] = 183 - tail
        if tail < 183:
            es[-1, 5] = 0
        es[-1, PACKET - tail :] = pes[-tail:]
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``, whose length FRAME divides."""
    parts, cc = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        part = _unit(payload[at : at + UNIT], k, cc)
        cc += len(part) - 2
        parts.append(part)
    return np.concatenate(parts).tobytes()


@lru_cache(1000)
def _sound(section: bytes) -> bool:
    return not crc_mpeg(section)


class _Packets:
    """The packets of one PID that count: with payload, each once, with the places where some are missing."""

    def __init__(self, a: np.ndarray, rows: np.ndarray, start: np.ndarray, flags: np.ndarray):
        cc = (a[rows, 3] & 15).astype(np.int32)
        again = np.zeros(len(rows), bool)
        for i in (np.flatnonzero(cc[1:] == cc[:-1]) + 1).tolist():  # sent twice, which is legal once, if the count goes on from there
            goes_on = i + 1 == len(cc) or cc[i + 1] in (cc[i], (cc[i] + 1) & 15)
            again[i] = not again[i - 1] and goes_on and (a[rows[i], 4:] == a[rows[i - 1], 4:]).all()
        rows, cc = rows[~again], cc[~again]
        told = (flags[rows] & 0x80) != 0
        self.rows, self.start = rows, start[rows]
        self.gap = np.r_[False, (((cc[1:] - cc[:-1]) & 15) != 1) & ~told[1:]] if len(rows) else np.zeros(0, bool)
        self.begins = (a[rows, 1] & 0x40) != 0
        self.random_access = (flags[rows] & 0x40) != 0


def _sections(a: np.ndarray, p: _Packets) -> list[bytes]:
    """The different sections that a PID carries, in order of their first copy."""
    out: dict[bytes, None] = {}
    open_, raw = False, bytearray()

    def cut_off() -> None:
        nonlocal open_
        while len(raw) >= 3 and raw[0] != 0xFF:
            n = 3 + ((raw[1] & 15) << 8 | raw[2])
            if len(raw) < n:
                return
            section = bytes(raw[:n])
            if not _sound(section):
                raise ValueError("a program table's checksum is wrong")
            out[section] = None
            del raw[:n]
        open_ = len(raw) > 0 and raw[0] != 0xFF

    for row, start, begins, gap in zip(p.rows.tolist(), p.start.tolist(), p.begins.tolist(), p.gap.tolist(), strict=True):
        data = a[row, start:].tobytes()
        if gap:
            open_ = False
        if begins and data:
            at = 1 + data[0]
            if open_:
                raw += data[1:at]
                cut_off()
            raw[:] = data[at:]
            open_ = True
        elif open_:
            raw += data
        if open_:
            cut_off()
    return list(out)


def _units(a: np.ndarray, p: _Packets, strict: bool) -> dict:
    """The elementary packets of a PID: bodies, time stamps, random-access flags, units lost."""
    rows = a[p.rows]
    data = rows[np.arange(PACKET)[None, :] >= p.start[:, None]].tobytes()
    ends = np.cumsum(PACKET - p.start)
    at = np.flatnonzero(p.begins)
    opens = (ends - (PACKET - p.start))[at].tolist() + [len(data)]
    # a unit that states its length is whole if it has it; another is if no packet is missing up to its successor
    gaps = np.r_[0, np.cumsum(p.gap)]
    broken = gaps[np.r_[at[1:] + 1, len(p.gap)]] > gaps[at + 1] if len(at) else np.zeros(0, bool)
    body, stamps, rap, lost = [], [], [], 0
    for k, (lo, hi) in enumerate(zip(opens, opens[1:], strict=False)):
        size = data[lo + 4] << 8 | data[lo + 5] if hi - lo >= 9 else -1
        whole = hi - lo >= 9 and data[lo : lo + 3] == b"\x00\x00\x01" and (lo + 6 + size == hi or (size == 0 and not broken[k]))
        if not whole:
            if strict:
                raise ValueError("a broken elementary packet")
            lost += 1
            continue
        t = data[lo + 9 : lo + 14] if data[lo + 7] & 0x80 else None
        stamps.append(None if t is None else (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1)
        rap.append(bool(p.random_access[at[k]]))
        body.append(data[lo + 9 + data[lo + 8] : hi])
    return {"payload": b"".join(body), "pts": stamps, "rap": rap, "lost": lost}


def demux(stream: bytes, strict: bool = True) -> dict:
    """Read a transport stream.

    ``programs`` maps program numbers to the PIDs of their tables, ``network``
    is the network's PID or -1, ``streams`` maps elementary PIDs to stream
    types, ``units`` to what each holds; ``payload``, ``pts`` and ``rap`` are
    those of the first stream. ``errors`` counts breaks of continuity and
    packets marked as damaged, ``lost`` the units left out.
    """
    if len(stream) % PACKET or not stream:
        raise ValueError("not a whole number of packets")
    a = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (a[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    field = (a[:, 3] & 0x20) != 0
    start = np.where(field, 5 + a[:, 4].astype(np.int32), 4)
    flags = np.where(field & (a[:, 4] > 0), a[:, 5], 0)
    bad = ((a[:, 1] & 0x80) != 0) | (start > PACKET)
    use = ((a[:, 3] & 0x10) != 0) & (pid != NULL_PID) & ~bad
    kept = {int(p): _Packets(a, np.flatnonzero(use & (pid == p)), start, flags) for p in np.unique(pid[use])}
    none = _Packets(a, np.zeros(0, np.int64), start, flags)
    programs, network = {}, -1
    for s in _sections(a, kept.get(0, none)):
        if s[0] == 0x00 and s[5] & 1:
            for i in range(8, len(s) - 4, 4):
                number, at = s[i] << 8 | s[i + 1], (s[i + 2] & 31) << 8 | s[i + 3]
                if number:
                    programs[number] = at
                else:
                    network = at
    streams, clock = {}, -1
    for number, pmt in sorted(programs.items()):
        for s in _sections(a, kept.get(pmt, none)):
            if s[0] != 0x02 or not s[5] & 1 or s[3] << 8 | s[4] != number:
                continue
            clock = (s[8] & 31) << 8 | s[9] if clock < 0 else clock
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i < len(s) - 4:
                streams[(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    units = {p: _units(a, kept.get(p, none), strict) for p in streams}
    first = units[next(iter(units))] if units else {"payload": b"", "pts": [], "rap": []}
    errors = int(bad.sum()) + sum(int(p.gap.sum()) for p in kept.values())
    return {"payload": first["payload"], "programs": programs, "network": network, "streams": streams, "units": units, "clock_pid": clock, "pts": first["pts"], "rap": first["rap"], "errors": errors, "lost": sum(u["lost"] for u in units.values()), "packets": len(a)}


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text, padded to whole frames, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME), len(raw)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.bool_()))])
_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<boolean>"


def _row(doc_id, n, stream):
    got = demux(stream)
    back = got["payload"]
    es, kind = next(iter(got["streams"].items()))
    level = np.frombuffer(back, np.uint8)
    feature = f"programs={len(got['programs'])};es={es}:{kind:02x};pcr={got['clock_pid']};packets={got['packets']};pes={len(got['pts'])};rap={sum(got['rap'])};pts={got['pts'][0]}-{got['pts'][-1]};cc_errors={got['errors']};level={int(level.sum(dtype=np.int64)) * 1000 // len(level)}"
    return doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, got["pts"], got["rap"]


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def media_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each document's stream, and its bytes before padding."""

    def row(doc_id, text):
        payload, n = payload_of(text)
        return doc_id, n, mux(payload)

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), row, _STORED, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """One row per stored stream: its digests, features and index.

    ``pts`` holds the time stamp of every access unit, ``random_access``
    whether decoding may begin there.
    """
    return map_rows(stored.select("doc_id", "n_bytes", "media"), _row, _SCHEMA, _DDL)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' streams, stored in the shared folder and read back; other columns of ``docs`` aren't read."""
    return read_media(cut(media_streams(docs, id_col, text_col), "media"))
