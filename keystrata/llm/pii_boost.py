"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans, boosted trees score each
from its format and the words around it, and a calibrated probability over a
threshold selects what is redacted. Spans of the four base kinds follow fixed
patterns and always stay; proposals that overlap them are dropped. The others
are taken by falling probability, each unless it overlaps one taken already,
so a span loses only to one that stays itself.

Base kinds: email, ip, card, phone. Added kinds: handle (a written-out
address), local_phone, national_id, iban, ipv6, birth_date, passport, street,
person, credential. Lengths within their patterns are the formats' own: 64 and
63 letters in an address' parts, 7 to 18 digits in a number, 15 to 34 signs in
an IBAN.

The trees are trained here, on findings with known labels that
``labelled_findings`` writes from a seed: real formats in fitting context, and
numbers, dates, versions, hashes and article codes that only look alike.

Cases: a null text counts as empty and has no spans; rows that share a doc_id,
or have none, are scanned separately; an empty table yields no rows; other
columns are left out. A text of any length is scanned whole, and every pattern
is linear in its length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_slices, whole_texts

KINDS = ("email", "ip", "card", "phone", "handle", "local_phone", "national_id", "iban", "ipv6", "birth_date", "passport", "street", "person", "credential")
BASE = 4
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive runs find what plain ones would, without going back over them
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, by start, then kind."""
    found: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(Span("email", start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(Span("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(Span("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    found.append(Span("phone", *m.span()))
    return sorted(found, key=lambda s: (s.start, _RANK[s.kind]))


# ------------------------------------------------------------- proposals

_EDGE, _END = r"(?<![\w.+/=-])", r"(?![\w/=-])"
_HANDLE = re.compile(r"(?<!\w)[A-Za-z][\w.+-]{0,63} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9][\w-]{0,62}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63})+(?!\w)")
_NUMBER = re.compile(_EDGE + r"\(?[0-9](?:[ .()/-]{0,2}[0-9]){6,17}" + _END)
_IBAN = re.compile(_EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}" + _END)
_IPV6 = re.compile(_EDGE + r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")

_DATE = re.compile(_EDGE + r"(?:(?:19|20)[0-9]{2}[-./](?:0?[1-9]|1[0-2])[-./][0-3]?[0-9]|[0-3]?[0-9][-./ ][01]?[0-9][-./ ](?:19|20)[0-9]{2})(?![\w/=-])")
_PASSPORT = re.compile(r"(?<!\w)[A-Z]{1,2}[0-9]{6,8}(?!\w)")
_NAME_WORD = r"[A-ZÀ-ÖØ-Þ][\w'-]*+"
_STREET = re.compile(
    rf"(?<!\w)[0-9]{{1,5}}[a-z]? (?:{_NAME_WORD} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard)\b\.?|(?<!\w)[A-ZÀ-ÖØ-Þ]\w*?(?:straße|strasse|weg|platz|gasse) [0-9]{{1,4}}[a-z]?(?!\w)"
    rf"|(?<!\w)[0-9]{{1,5}},? (?:rue|avenue|place|impasse)(?: (?:de|du|des|la|le|les|{_NAME_WORD})){{1,5}}|(?<!\w)(?:[Cc]alle|[Pp]laza|[Aa]venida)(?: (?:de|del|la|las|los|{_NAME_WORD})){{1,5}},? [0-9]{{1,4}}(?!\w)"
)
_STREET_WORDS = re.compile(r"Street|St\b|Road|Rd\b|Avenue|Ave\b|Lane|Drive|Boulevard|straße|strasse|weg |platz |gasse |rue |avenue |place |impasse |alle |laza |venida ")
_PERSON = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Sra?|Mme|Monsieur|Madame)\.? {_NAME_WORD}(?: {_NAME_WORD}){{0,2}}")
_CREDENTIAL = re.compile(r"(?<![A-Za-z])(?i:password|passwd|secret|api_?key|token|passwort|contraseña)[\"']?[ \t]*+[=:][ \t]*+[\"']?[^\s\"']{6,}+")


def proposals(text: str) -> list[Span]:
    """Everything that might be personal data, overlaps included."""
    found = []
    if "(at)" in text or "[at]" in text or (" at " in text and " dot " in text):
        found += [Span("handle", *m.span()) for m in _HANDLE.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            found += [Span("local_phone", *m.span()), Span("national_id", *m.span())]
        found += [Span("iban", *m.span()) for m in _IBAN.finditer(text)]
        if ":" in text:
            found += [Span("ipv6", *m.span()) for m in _IPV6.finditer(text)]
        for kind, pattern in (("birth_date", _DATE), ("passport", _PASSPORT)):
            found += [Span(kind, *m.span()) for m in pattern.finditer(text)]
        if _STREET_WORDS.search(text):
            found += [Span("street", *m.span()) for m in _STREET.finditer(text)]
    found += [Span("person", *m.span()) for m in _PERSON.finditer(text)]
    if "=" in text or ":" in text:
        found += [Span("credential", *m.span()) for m in _CREDENTIAL.finditer(text)]
    return found


# Words that stand near personal data, by what they speak of.
PHONE_WORDS = {"tel", "telephone", "telefon", "phone", "call", "mobile", "mobil", "fax", "appelez", "llame", "anrufen", "móvil", "téléphone"}
ID_WORDS = {"ssn", "social", "security", "passport", "ausweis", "dni", "nif", "identity", "taxpayer", "seguro"}
BANK_WORDS = {"iban", "account", "konto", "compte", "cuenta", "bank", "transfer", "payee"}
MAIL_WORDS = {"mail", "email", "e", "contact", "write", "reach", "kontakt", "contacto", "courriel", "correo"}
NET_WORDS = {"ip", "address", "host", "server", "ipv6", "from", "peer"}
OTHER_WORDS = {"order", "invoice", "isbn", "version", "date", "model", "serial", "commit", "hash", "article", "part", "room", "page", "build", "ticket", "on", "total", "price"}
BIRTH_WORDS = {"born", "birth", "birthday", "dob", "geboren", "geburtstag", "geburtsdatum", "né", "née", "naissance", "nacido", "nacida", "nacimiento"}
HOME_WORDS = {"lives", "live", "home", "resident", "resides", "wohnt", "wohnhaft", "adresse", "habite", "domicile", "vive", "domicilio", "dirección"}
HOLLOW = re.compile(r"example|changeme|placeholder|your[_-]|dummy|sample|xxxx|redacted|[*]{3}|[$<{(\[]", re.IGNORECASE)

_WORD = re.compile(r"[^\W\d_]+")


def iban_fits(x: str) -> bool:
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a proposal as numbers."""
    x = text[span.start : span.end]
    digits = _digits(x)
    groups = [len(g) for g in re.findall(r"[0-9]+", x)]
    near = [w.lower() for w in _WORD.findall(text[max(0, span.start - 48) : span.start])[-5:]]
    after = [w.lower() for w in _WORD.findall(text[span.end : span.end + 24])[:2]]
    has = lambda words: float(any(w in words for w in near))
    ssn = bool(re.fullmatch(r"[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}", x)) and x[:3] not in ("000", "666")
    day = bool(re.match(r"\(?(?:19|20)[0-9]{2}[-./ ](?:0?[1-9]|1[0-2])[-./ ]|[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)[0-9]{2}", x))
    return [
        *(float(span.kind == k) for k in KINDS[BASE:]), float(len(x)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)), float(groups[-1] if groups else 0),
        float(x.count("-")), float(x.count(".")), float(x.count("(")), float(x.count("/")), float(x.count(" ")), float(x.count(":")), float(ssn), float(day), float(x[:1] == "0" or x[:2] == "(0"),
        float(span.kind == "iban" and iban_fits(x)), float(span.kind == "handle" and ("(" in x or "[" in x)), float("::" in x), float(bool(re.search("[a-fA-F]", x)) if span.kind == "ipv6" else 0),
        has(PHONE_WORDS), has(ID_WORDS), has(BANK_WORDS), has(MAIL_WORDS), has(NET_WORDS), has(OTHER_WORDS), float(any(w in OTHER_WORDS for w in after)), float(text[span.start - 1 : span.start] in ('"', "'", "=", "#")),
        has(BIRTH_WORDS), has(HOME_WORDS), float(bool(HOLLOW.search(x))), float(sum(c.isupper() for c in x)), float(sum(c.islower() for c in x)), float(len(set(x))), float(bool(re.match(r"[A-Z][a-z]+\.? [A-Z]\w+ [A-Z]", x))),
    ]


# -------------------------------------------------------------- training


def labelled_findings(seed: int = 5, n: int = 5400) -> list[tuple[str, Span, int]]:
    """Texts with a proposal each and whether it is personal data."""
    r = random.Random(seed)
    words = ["the", "and", "then", "of", "heure", "und", "casa", "when", "over", "small", "red", "noon", "we", "they", "met"]
    pick = lambda xs: r.choice(sorted(xs))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 9)))

    def iban(good: bool) -> str:
        body, country = num(18), r.choice(["DE", "ES", "FR", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        x = f"{country}{check if good else (check % 96 + 2):02d}{body}"
        return " ".join(x[i : i + 4] for i in range(0, len(x), 4)) if r.random() < 0.5 else x

    def hexes(k: int) -> str:
        return ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(k))

    made = {
        ("handle", 1): lambda: (f"{name()}{r.choice([' (at) ', '(at)', ' [at] ', ' at '])}{name()}{r.choice([' (dot) ', ' [dot] ', ' dot '])}{r.choice(['com', 'org', 'net', 'de'])}", MAIL_WORDS),
        ("handle", 0): lambda: (f"{r.choice(words)} at {r.choice(words)} dot {r.choice(words)}", OTHER_WORDS),
        ("local_phone", 1): lambda: (r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(6)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(3)}"]), PHONE_WORDS),
        ("local_phone", 0): lambda: (r.choice([num(8), num(12), num(16), f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)} 1{num(1)}", f"{num(1)}.{num(2)}.{num(3)}.{num(1)}.{num(1)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(3)}"]), OTHER_WORDS),
        ("national_id", 1): lambda: (f"{r.randint(100, 665)}-{r.randint(10, 99)}-{num(4)}", ID_WORDS),
        ("national_id", 0): lambda: (r.choice([num(9), f"{num(3)}-{num(3)}-{num(4)}", f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(4)}-{num(4)}-{num(2)}", num(13)]), OTHER_WORDS | PHONE_WORDS),
        ("iban", 1): lambda: (iban(True), BANK_WORDS),
        ("iban", 0): lambda: (r.choice([iban(False), f"AB{num(14)}", f"XK{num(2)}{name().upper()}{num(8)}AZ"]), OTHER_WORDS),
        ("ipv6", 1): lambda: (r.choice([hexes(8), f"fe80::{hexes(4)}", f"2001:db8::{hexes(2)}"]), NET_WORDS),
        ("ipv6", 0): lambda: (f"{num(2)}:{num(2)}:{num(2)}", OTHER_WORDS),
        ("birth_date", 1): lambda: (r.choice([f"19{r.randint(30, 99)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1940, 2010)}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1940, 2010)}"]), BIRTH_WORDS),
        ("birth_date", 0): lambda: (r.choice([f"20{num(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1990, 2030)}"]), OTHER_WORDS),
        ("passport", 1): lambda: (f"{r.choice(['C', 'L', 'AB', 'XK', 'P'])}{num(r.randint(6, 8))}", ID_WORDS),
        ("passport", 0): lambda: (f"{r.choice(['SKU', 'A', 'B', 'ISO', 'RX', 'QT'])[:2]}{num(r.randint(6, 8))}", OTHER_WORDS),
        ("street", 1): lambda: (r.choice([f"{r.randint(1, 999)} {name().title()} {r.choice(['Street', 'Road', 'Avenue', 'Lane'])}", f"{name().title()}{r.choice(['straße', 'weg', 'platz'])} {r.randint(1, 199)}", f"{r.randint(1, 199)} rue de {name().title()}", f"calle {name().title()}, {r.randint(1, 199)}"]), HOME_WORDS),
        ("street", 0): lambda: (r.choice([f"{r.randint(1900, 2030)} {name().title()} Road", f"{r.randint(1, 9)} avenue de {name().title()}"]), OTHER_WORDS),
        ("person", 1): lambda: (f"{r.choice(['Mr', 'Mrs', 'Dr', 'Ms', 'Herr', 'Frau', 'Mme', 'Señor'])}{r.choice(['', '.'])} {name().title()}{r.choice(['', ' ' + name().title()])}", HOME_WORDS | MAIL_WORDS | PHONE_WORDS),
        ("person", 0): lambda: (f"{r.choice(['Dr', 'Ms', 'Sr', 'Frau', 'Mr'])} {name().upper()}", OTHER_WORDS),
        ("credential", 1): lambda: (f"{r.choice(['password', 'token', 'secret', 'api_key', 'Passwort'])}{r.choice(['=', ' = ', ': '])}{r.choice(['', chr(34)])}{name()}{num(r.randint(2, 6))}{r.choice(['', '!', '#'])}{r.choice([name(), num(4), name().upper()])}", HOME_WORDS),
        ("credential", 0): lambda: (f"{r.choice(['password', 'token', 'secret', 'api_key'])}{r.choice(['=', ' = ', ': '])}{r.choice(['example', 'changeme', 'your_token', '${TOKEN}', '<secret>', '********', 'placeholder', name() + name()[:3], 'required'])}", OTHER_WORDS),
    }
    out = []
    while len(out) < n:
        kind, label = r.choice(sorted(made))
        x, context = made[kind, label]()
        lead = f"{pick(context)} " if r.random() < (0.75 if label else 0.35) else ""
        text = f"{' '.join(r.choices(words, k=r.randint(2, 7)))} {lead}{x} {' '.join(r.choices(words, k=3))}"
        start = text.find(x)
        for s in proposals(text):
            if s.kind == kind and s.start < start + len(x) and start < s.end:
                out.append((text, s, label))
    return out[:n]


class Trees(NamedTuple):
    """Complete trees of one depth: split features and bounds by level order, leaf values."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    start: float
    slope: float
    shift: float
    threshold: float


DEPTH = 3


def _leaves(t_feature, t_bound, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[np.arange(len(x)), t_feature[at]] > t_bound[at])
    return at - (2**DEPTH - 1)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Second-order boosting of the logistic loss."""
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    inner = 2**DEPTH - 1
    features, bounds, leaves = [], [], []
    cuts = [np.unique(c)[:-1] for c in x.T]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, bound = np.zeros(inner, int), np.full(inner, np.inf)
        rows: dict[int, np.ndarray] = {0: np.arange(len(y))}
        for node in range(inner):
            own = rows[node]
            best = 1e-6
            gs, hs = g[own].sum(), h[own].sum()
            for f, cut in enumerate(cuts):
                for c in cut if len(cut) <= 24 else cut[:: len(cut) // 24]:
                    right = x[own, f] > c
                    gr, hr = g[own][right].sum(), h[own][right].sum()
                    if hr < 1 or hs - hr < 1:
                        continue
                    gain = gr * gr / (hr + l2) + (gs - gr) ** 2 / (hs - hr + l2) - gs * gs / (hs + l2)
                    if gain > best:
                        best, feature[node], bound[node] = gain, f, c
            right = x[own, feature[node]] > bound[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
        leaf = np.array([-rate * g[rows[inner + k]].sum() / (h[rows[inner + k]].sum() + l2) for k in range(2**DEPTH)])
        margin += leaf[_leaves(feature, bound, x)]
        features.append(feature)
        bounds.append(bound)
        leaves.append(leaf)
    return np.array(features), np.array(bounds), np.array(leaves), start


def margins(t: Trees, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), t.start)
    for f, b, leaf in zip(t.feature, t.bound, t.leaf, strict=True):
        total += leaf[_leaves(f, b, x)]
    return total


def probabilities(t: Trees, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(t.slope * margins(t, x) + t.shift)))


@lru_cache(maxsize=1)
def model(precision: float = 0.99) -> Trees:
    """Trees fitted on two thirds of the labelled findings; the rest calibrates
    the probability and sets the least threshold of that precision."""
    rows = labelled_findings()
    x = np.array([describe(t, s) for t, s, _ in rows])
    y = np.array([label for _, _, label in rows], float)
    own = np.arange(len(y)) % 3 > 0
    t = Trees(*boost(x[own], y[own]), 1.0, 0.0, 0.5)
    m, held = margins(t, x[~own]), y[~own]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit on the margin
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - held) * m).sum() + 1e-3 * a, (p - held).sum()])
        a, b = np.array([a, b]) - np.linalg.solve([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]], gradient)
    t = t._replace(slope=float(a), shift=float(b))
    p = probabilities(t, x[~own])
    for bound in np.unique(np.round(p, 3)):
        if bound >= 0.5 and held[p >= bound].mean() >= precision:
            return t._replace(threshold=float(bound))
    return t._replace(threshold=0.995)


# --------------------------------------------------------------- results


def chosen(offered: list[Span], p: np.ndarray, threshold: float) -> list[Span]:
    """The spans of probability ``threshold`` or more that none taken before
    overlaps, the likeliest first; of equal ones the first, by start and kind."""
    starts: list[int] = []
    taken: list[Span] = []
    for k in sorted(np.flatnonzero(p >= threshold), key=lambda k: (-p[k], offered[k].start, _RANK[offered[k].kind])):
        s = offered[k]
        at = bisect_left(starts, s.end)  # taken spans are apart, so the last that starts before s ends is the last to reach it
        if not at or taken[at - 1].end <= s.start:
            starts.insert(at, s.start)
            taken.insert(at, s)
    return taken


def all_spans(text: str, t: Trees, base: list[Span]) -> list[Span]:
    """Base spans and the selected proposals, by start, then kind."""
    offered = proposals(text)
    if base and offered:
        offered = _clear_of(offered, base)
    if not offered:
        return base
    p = probabilities(t, np.array([describe(text, s) for s in offered]))
    return sorted([*base, *chosen(offered, p, t.threshold)], key=lambda s: (s.start, _RANK[s.kind]))


def _clear_of(offered: list[Span], base: list[Span]) -> list[Span]:
    """Proposals that overlap no base span, by binary search over merged ranges."""
    merged: list[list[int]] = []
    for s in base:
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end])
    starts = np.array([a for a, _ in merged])
    ends = np.array([b for _, b in merged])
    first = np.searchsorted(ends, [s.start for s in offered], side="right")
    return [s for s, k in zip(offered, first, strict=True) if k == len(starts) or starts[k] >= s.end]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlaps as one, replaced by its first kind."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row per document: base counts, the base spans' hash, all spans and
    their number; with_text adds the redacted text."""
    trees = model()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long" + (", redacted string" if with_text else "")

    def each(batch):
        out = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base = base_spans(text)
            spans = all_spans(text, trees, base)
            kinds = [s.kind for s in base]
            row = [doc, *(kinds.count(k) for k in KINDS[:BASE]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)]
            out.append([*row, redact(text, spans)] if with_text else row)
        types = [pa.string() if x.split()[1] == "string" else pa.int64() for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return map_slices(whole_texts(docs), each, schema)
