"""Personal data: exact base rules, then boosted trees over wider candidates.

Four base kinds (email, ip, card, phone) are found by fixed rules and always
kept. High-recall generators propose further, overlapping spans (other phone
formats, social security numbers, IBANs, disguised addresses, IPv6, dates of
birth, names of persons, street addresses); gradient-boosted trees score each from its format and context, and the
calibrated threshold of its kind decides. Spans that overlap a base span or a
better one are left out.

The trees are trained here, on ``TRAINING_ROWS`` generated examples with a
fixed seed, never on the corpus, which has no labels for it. They are tested on
sentences written apart from the generator. Offsets are code points, ends exclusive. Null texts count as
empty: no spans, digest of the empty string. Rows are handled alone.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosted
from .common import ship, small_batches

BASE = ("email", "ip", "card", "phone")
MORE = ("phone_local", "ssn", "iban", "email_disguised", "ipv6", "birth_date", "person", "street")
#: Generated examples that the trees are fitted on, and those for calibration.
TRAINING_ROWS, CALIBRATION_ROWS = 9000, 5000
#: Least precision on the calibration rows at a kind's threshold.
PRECISION = 0.98
_SEED = 20240501

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The rules' own patterns, but begun only where a run of digits begins: a match that could begin within a run would have begun at its start.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email rule: an @, the run before it, the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            lo = at
            while lo > done and text[lo - 1] in _LOCAL_SET:
                lo -= 1
            if lo < at:
                out.append((lo, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base rules, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


_GENERATORS = {
    "phone_local": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-]{0,2}[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "email_disguised": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.ASCII | re.IGNORECASE),
    # four groups or more, or a '::' at any place; perhaps an IPv4 tail
    "ipv6": re.compile(r"(?<![0-9A-Za-z_:])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){3})(?:[0-9A-Fa-f]{1,4}|(?=::))(?:::?[0-9A-Fa-f]{1,4}){0,8}(?:(?:\.[0-9]{1,3}){3}|::)?(?![0-9A-Za-z_]|:[0-9A-Fa-f:])"),
    "street": re.compile(r"(?<![\w.,/-])[0-9]{1,5}[a-zA-Z]? (?:[NSEW]\. )?(?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Place|Pl|Square|Sq|Terrace)(?![\w-])\.?(?:,? (?:Apt|Suite|Unit|No)\.? ?[0-9A-Z]+)?|(?<![\w.])[A-Z][a-zäöüß]+(?:straße|strasse|weg|platz|gasse|allee) [0-9]{1,4}[a-z]?(?!\w)"),
    "birth_date": re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])"),
}
#: Runs of capitalised words, in which every window of two or three, or of a title and one, is proposed as a name.
_CAPITALS = re.compile(r"(?<![\w.@/-])[A-Z][a-zà-öø-ÿ'-]*\.?(?: (?:de |van |von |der |la )?[A-Z][a-zà-öø-ÿ'-]*\.?)+(?![\w@])")
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?")
_PARTICLES = ("de", "van", "von", "der", "la")
_CUES = {
    "phone_local": ("phone", "call", "tel", "mobile", "cell", "fax", "contact", "dial", "reach"),
    "ssn": ("ssn", "social", "security", "taxpayer", "tin"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta", "wire"),
    "email_disguised": ("mail", "email", "e-mail", "contact", "write", "reach", "address"),
    "ipv6": ("ip", "ipv6", "address", "host", "client", "remote", "login"),
    "person": ("name", "named", "called", "signed", "dear", "mr", "mrs", "ms", "dr", "prof", "contact", "patient", "regards", "sincerely", "attn", "client", "customer", "employee", "tenant", "herr", "frau", "by", "from", "met", "with"),
    "street": ("address", "lives", "live", "living", "resident", "residing", "ship", "deliver", "delivered", "home", "moved", "at", "to", "mail"),
    "birth_date": ("born", "birth", "dob", "birthday", "geboren", "naissance", "nacimiento"),
}
_AGAINST = ("version", "part", "order", "sku", "isbn", "invoice", "serial", "ref", "page", "table", "figure", "no.", "id", "code", "published", "updated", "release", "mac")
_WORD = re.compile(r"[a-z.-]+")
#: Words that begin or end capitalised phrases which name no person, and given names that speak for one.
_NO_NAME = frozenset(
    "the this that these those a an in on at of and but for when while after before if new old north south east west united great royal national international general public annual first second last world city state county university college school institute company corporation group bank center centre department ministry council committee court act law bill house party church museum park river lake mountain island street road avenue "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday spring summer autumn winter project report chapter section table figure part volume version edition guide manual system service network program programme team league cup prize award day week year war battle treaty union republic kingdom empire times post news journal press review games software systems inc ltd gmbh llc".split()
)
_GIVEN = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony margaret mark sandra paul ashley steven emily andrew donna george helen kevin anna brian maria edward laura peter emma hans greta klaus ingrid jean pierre marie claire luc carlos sofia juan carmen luis elena ahmed fatima wei li yuki ivan olga priya raj omar lucia marco giulia".split()
)
#: What the pattern of disguised addresses takes for an @, in lower case.
_AT = ("[at]", "(at)", "{at}", " at ")
#: The end of an address whose dots are written out or stand tight, by its last label.
_TOP = re.compile(r"(?:[A-Za-z0-9-]\.| dot |[\])}] ?)(?:com|org|net|edu|gov|info|biz|io|co|ai|eu|uk|de|fr|es|it|nl|ch|at|be|pl|us|ca|au|jp)$", re.I)


def _names(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _CAPITALS.finditer(text):
        words = [(w[0], m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m[0])]
        for i, (w, lo, _) in enumerate(words):
            title, names = bool(_TITLE.fullmatch(w)), 0
            if w in _PARTICLES:
                continue
            for v, _, hi in words[i + title : i + 5]:
                if v in _PARTICLES:
                    continue
                names += len(v) > 2 and v[-1] != "."
                if names > 3 or (len(v) > 2 and v[-1] == "." and not _TITLE.fullmatch(v) and hi - v.count(".") < m.end() - 1):
                    break
                if names >= (1 if title else 2) and len(v) > 2:
                    out.append(("person", lo, hi - (v[-1] == ".")))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Everything that the generators propose, overlaps included."""
    out = _names(text)
    has_digit = _DIGIT.search(text) is not None
    lower = None
    for kind, pattern in _GENERATORS.items():
        if kind == "email_disguised":
            lower = text.lower() if lower is None else lower
            if not any(x in lower for x in _AT) or not ("dot" in lower or "." in lower):
                continue
        elif kind == "ipv6":
            if text.count(":") < 2:
                continue
        elif not has_digit:
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def _mod97(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _is_ipv6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
        return True
    except ValueError:
        return False


def features(text: str, kind: str, lo: int, hi: int) -> list[float]:
    """Format and context of one candidate."""
    s, before, after = text[lo:hi], text[max(0, lo - 40) : lo].lower(), text[hi : hi + 20].lower()
    d = _digits(s)
    near = _WORD.findall(before)[-6:]
    cue = next((i for i, w in enumerate(reversed(near)) if any(w.startswith(c) for c in _CUES[kind])), 9)
    against = next((i for i, w in enumerate(reversed(near)) if any(w.rstrip(":") == c for c in _AGAINST)), 9)
    seps = [c for c in s if not c.isalnum()]
    valid = 0.0
    if kind == "iban":
        valid = float(_mod97(s))
    elif kind == "ssn":
        valid = float(d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000")
    elif kind == "phone_local":
        valid = float(d[0] not in "01" and d[3] not in "01")
    elif kind == "email_disguised":
        valid = float(bool(re.search(r"[\[({]at[\])}]", s, re.I)) + bool(re.search(r"[\[({]dot[\])}]", s, re.I)))
        valid += 0.5 * bool(_TOP.search(s))
    elif kind == "ipv6":
        valid = float(_is_ipv6(s))
    elif kind == "person":
        words = [w.strip(".,'").lower() for w in s.split()]
        named = [w for w in words if w not in ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "sr", "sra")]
        valid = 2.0 * (len(named) < len(words)) + 1.0 * bool(named and named[0] in _GIVEN) - 3.0 * any(w in _NO_NAME for w in named)
    elif kind == "street":
        valid = 1.0 - 1.0 * any(w in ("version", "chapter", "page", "top", "of") for w in s.lower().split())
    elif kind == "birth_date":
        valid = float(1900 <= int(next(x for x in re.split(r"[./-]", s) if len(x) == 4)) <= 2012)
    return [
        MORE.index(kind), len(s), len(d), len(d) / len(s), len(seps), len(set(seps)), len(set(d)) / max(1, len(d)), valid, cue, against,
        float(before[-1:].isalnum()), float(after[:1].isalnum()), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), float("(" in s), float(s[:1].isupper()), float("://" in before[-12:]),
    ]


def _iban(r: random.Random, good: bool) -> str:
    land, body = r.choice(("DE", "FR", "ES", "NL", "GB")), "".join(r.choice("0123456789") for _ in range(r.choice((14, 18, 20))))
    check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    check = check if good else (check + r.randint(1, 90)) % 97 + 1
    return f"{land}{check:02d}{body}"


def _ipv6(r: random.Random) -> str:
    """A valid address: whole, or with '::' at any place, at times with an IPv4 tail."""
    n = lambda: f"{r.getrandbits(r.choice((4, 8, 16, 16))):x}"
    if r.random() < 0.3:
        return ":".join(f"{r.getrandbits(16):x}" for _ in range(8))
    ahead = r.choice((["2001", "db8"], ["fe80"], ["fd00", n()], [], [f"{r.getrandbits(16):x}", n(), n()], [n() for _ in range(r.randint(1, 6))]))
    after = [n() for _ in range(r.randint(0 if len(ahead) > 1 else 1, 7 - len(ahead)))]
    if not ahead and r.random() < 0.4:
        after = ["1"]
    if 0 < len(after) < 6 - len(ahead) and r.random() < 0.1:
        after[-1] = ".".join(str(r.randint(0, 255)) for _ in range(4))
    return f"{':'.join(ahead)}::{':'.join(after)}"


def _example(r: random.Random) -> tuple[str, str, int, int, int]:
    """One generated candidate in context: (text, kind, start, end, label)."""
    kind, good = r.choice(MORE), r.random() < 0.5
    n = lambda k, first="0123456789": r.choice(first) + "".join(r.choice("0123456789") for _ in range(k - 1))
    sep = r.choice("-. ")
    if kind == "phone_local":
        f = "23456789" if good else "01"
        s = r.choice((f"({n(3, f)}) {n(3, f)}-{n(4)}", f"{n(3, f)}{sep}{n(3, f)}{sep}{n(4)}"))
    elif kind == "ssn":
        s = f"{n(3, '12345') if good else r.choice(('000', '666', n(3, '9')))}-{r.randint(1, 99) if good else r.choice((0, r.randint(1, 99))):02d}-{n(4, '123456789')}"
    elif kind == "iban":
        s = _iban(r, good)
    elif kind == "email_disguised":
        who, host, end = r.choice(("joan.k", "info", "m_weber", "pat99")), r.choice(("mail", "example", "corp-net")), r.choice(("com", "org", "de"))
        if good:
            s = r.choice((f"{who} [at] {host} [dot] {end}", f"{who}(at){host}(dot){end}", f"{who} [at] {host}.{end}", f"{who} at {host} dot {end}", f"{who} at {host}.{end}", f"{who} at {host} dot {end}"))
        else:
            s = f"{r.choice(('look', 'meet', 'arrive', 'stood'))} at {r.choice(('the', 'noon', 'home'))}{r.choice((' dot ', '. ', '. ', '. '))}{r.choice(('com', 'then', 'later', 'She', 'It'))}"
    elif kind == "person":
        title = r.choice(("", "", "Mr. ", "Mrs ", "Dr. ", "Prof. ", "Ms. "))
        last = "".join((r.choice(("Ba", "Mc", "Ro", "Sa", "Ke", "Lin", "Mor", "Had", "Wil", "Oko", "Fer")), r.choice(("ley", "son", "man", "ter", "berg", "rett", "nov", "ski", "dez", "well", "ford"))))
        if good:
            first = r.choice(sorted(_GIVEN)).capitalize() if r.random() < 0.8 else r.choice(("Zorah", "Tamsin", "Bexley", "Ilvo"))
            s = f"{title}{first} {last}" if r.random() < 0.85 or not title else f"{title}{last}"
        else:
            s = f"{r.choice(sorted(_NO_NAME)).capitalize()} {r.choice((last, r.choice(sorted(_NO_NAME)).capitalize()))}" if r.random() < 0.6 else f"{last} {r.choice(('Street', 'Report', 'River', 'Company', 'Systems', 'Prize'))}" if r.random() < 0.6 else f"{r.choice(('Quarterly', 'Open', 'Deep', 'Blue', 'Silent', 'Central', 'Grand'))} {r.choice(('Results', 'Ocean', 'Mountain', 'Harbor', 'Station', 'Forest', 'Valley'))}"
    elif kind == "street":
        name = r.choice(("Baker", "Elm", "Old Mill", "Lincoln", "Kings", "Rose Hill", "Second"))
        s = f"{r.randint(1, 9999)} {name} {r.choice(('Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive', 'Court'))}{r.choice(('', '', ', Apt 4', ' Suite 210'))}" if r.random() < 0.8 else f"{r.choice(('Haupt', 'Garten', 'Linden'))}{r.choice(('straße', 'weg', 'allee'))} {r.randint(1, 200)}"
        if not good:
            s = f"{r.choice((1, 2, 3, 10, 50, 100))} {r.choice(('Best', 'Top', 'Great', 'New'))} {r.choice(('Way', 'Drive', 'Court', 'Place', 'Square'))}"
    elif kind == "ipv6":
        s = _ipv6(r) if good else r.choice((":".join(f"{r.randint(0, 59):02d}" for _ in range(r.randint(4, 7))), ":".join(f"{r.getrandbits(8):02x}" for _ in range(6)), r.choice(("::", "a::b", "ab::add", "face::add", "bad::cafe", "::add", "12:30::", "::Face"))))
    else:
        s = f"{r.randint(1, 28):02d}{r.choice('./-')}{r.randint(1, 12):02d}{r.choice('./-')}{r.randint(1930, 2010) if good else r.randint(1990, 2030)}"
    filler = [r.choice(("the", "then", "of", "was", "with", "on", "file", "new", "and", "for", "reading")) for _ in range(r.randint(0, 5))]
    odds = 0.75 if good else 0.08
    if kind in ("person", "street"):
        odds = 0.7 if good else 0.3
    if kind == "birth_date":
        odds = 0.95 if good else 0.03  # a date is personal only by its context
    cue = r.choice(_CUES[kind]) if r.random() < odds else r.choice(_AGAINST) if r.random() < (0.05 if good else 0.5) else ""
    before = " ".join([*filler, cue, *(["number"] if cue and r.random() < 0.2 else [])]).strip() + r.choice((": ", " ", " is "))
    after = r.choice((" and so on", ".", ", then", "\n", " 17 rows", ""))
    text = before + s + after
    return text, kind, len(before), len(before) + len(s), int(good and (kind != "birth_date" or cue in _CUES[kind]))


@lru_cache(1)
def model() -> tuple[Boosted, dict[str, float]]:
    """The trained trees and the calibrated threshold of each kind."""
    r = random.Random(_SEED)
    rows = [_example(r) for _ in range(TRAINING_ROWS + CALIBRATION_ROWS)]
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    y = np.array([row[4] for row in rows], float)
    trees = Boosted().fit(x[:TRAINING_ROWS], y[:TRAINING_ROWS]).calibrate(x[TRAINING_ROWS:], y[TRAINING_ROWS:])
    p, held, thresholds = trees.predict(x[TRAINING_ROWS:]), rows[TRAINING_ROWS:], {}
    for kind in MORE:
        own = np.array([row[1] == kind for row in held])
        q, t = p[own], y[TRAINING_ROWS:][own]
        order = np.argsort(-q)
        precise = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        ok = np.flatnonzero(precise >= PRECISION)
        thresholds[kind] = float(max(0.5, q[order][ok[-1]])) if len(ok) else 1.1
    return trees, thresholds


def found(texts: list[str], trained: tuple[Boosted, dict[str, float]]) -> list[tuple[list, list]]:
    """For each text its base spans and the added spans, as (kind, start, end)."""
    trees, thresholds = trained
    base = [base_spans(t) for t in texts]
    proposed = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    added: list[list] = [[] for _ in texts]
    if proposed:
        p = trees.predict(np.array([features(texts[i], k, a, b) for i, k, a, b in proposed]))
        taken = [[(a, b) for _, a, b in spans] for spans in base]
        for score, (i, kind, a, b) in sorted(zip(p.tolist(), proposed, strict=True), key=lambda x: (x[1][0], -x[0], x[1][2], x[1][1])):
            if score >= thresholds[kind] and all(b <= c or d <= a for c, d in taken[i]):
                taken[i].append((a, b))
                added[i].append((kind, a, b))
    order = {k: i for i, k in enumerate(MORE)}
    return [(x, sorted(y, key=lambda s: (order[s[0]], s[1]))) for x, y in zip(base, added, strict=True)]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlaps merge."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])
_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _mapped(docs: DataFrame, make, schema: pa.Schema, ddl: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    trained = spark.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [t or "" for t in batch[1].to_pylist()]
                rows = [make(d, t, *f) for d, t, f in zip(batch[0].to_pylist(), texts, found(texts, trained.value), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, ddl)


def span_digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, their digest, and all spans."""

    def make(doc, text, base, added):
        kinds = [s[0] for s in base]
        return doc, *(kinds.count(k) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)

    return _mapped(docs, make, _SCHEMA, _DDL)


def redacted(docs: DataFrame) -> DataFrame:
    """Per document: its text with all found spans replaced."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return _mapped(docs, lambda doc, text, base, added: (doc, redact(text, base + added)), schema, "doc_id long, text string")
