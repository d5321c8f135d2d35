"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Plan
----
1. Base patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and
   international phone numbers exactly; what they find always stays.
2. Further generators propose overlapping spans of other kinds (access tokens,
   local phone numbers, bank accounts, national ids, masked addresses).  They
   aim at recall only.
3. Gradient-boosted trees score each proposed span by its format (length, mix
   and entropy of characters, check digits) and its context (key words before
   it, quotes, assignment signs, what it touches).
4. Each kind has its own threshold: the least score from which on the precision
   on held-out examples is ``PRECISION`` or more (``calibrated``).  Examples
   without telling context, of either label, keep the scores of a kind apart
   from 0 and 1, so the held-out half decides.  Spans that pass and do not
   overlap a base span or a better one are added.

The trees are trained on examples that a generator with a fixed seed makes
(``TRAIN_EXAMPLES`` of them), so every run has the same model and no text of the
corpus is kept in it.  Texts are scanned whole, in one pass, without shuffles;
all patterns take time linear in the text.

Defined results: a null text counts as empty and has no spans.  Offsets are
code points, the end is exclusive.  Every row gives one row, so repeated rows
and null ids stay as they are; an empty table gives an empty result.  Only id
and text are read, so other columns, whatever their names, play no part; an id
column named as an output column is refused by Spark.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ruleframe.llm.common import mapped

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "local_phone", "bank_account", "national_id", "masked_email")
KINDS = BASE_KINDS + ADDED_KINDS
TRAIN_EXAMPLES = 6000
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 16
PRECISION = 0.97
CONTEXT = 24
FRONT = 64 + 63 + 12

Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts: what follows the run decides.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """From each @: the longest local part before it, then the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        else:
            # No address can cross this @ later on.
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    out = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


_GENERATORS: dict[str, re.Pattern] = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+"),
    "local_phone": re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "bank_account": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "masked_email": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]?(?:at|AT)[\])]?\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]?(?:dot|DOT)[\])]?\x20?[A-Za-z0-9-]{1,63})+"),
}
_DOT = re.compile(r"dot|DOT")
_DIGIT = re.compile(r"[0-9]")


def candidates(text: str) -> Iterator[Span]:
    """Spans of the added kinds; they may overlap."""
    if _DIGIT.search(text):
        for kind in ADDED_KINDS[:4]:
            for m in _GENERATORS[kind].finditer(text):
                if kind != "secret" or _DIGIT.search(m[0]):
                    yield kind, *m.span()
    free = 0
    for word in _DOT.finditer(text):
        # What stands before the first "dot" of an address has at most FRONT characters.
        at = max(free, word.start() - FRONT)
        while at < word.start():
            m = _GENERATORS["masked_email"].match(text, at)
            if m:
                yield "masked_email", *m.span()
                at = free = m.end()
            else:
                at += 1


# English, German, French and Spanish.
_KEYWORDS = (
    ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "auth", "bearer", "credential", "private key", "passwort", "kennwort", "schlüssel", "mot de passe", "jeton", "contraseña", "clave"),
    ("call", "phone", "tel", "fax", "mobil", "cell", "dial", "ruf", "handy", "télé", "appel", "portable", "móvil", "llam"),
    ("iban", "account", "bank", "transfer", "konto", "überweis", "compte", "virement", "cuenta", "banco"),
    ("ssn", "social security", "tax id", "national id", "insurance", "steuer", "versicherung", "sécurité sociale", "seguridad social"),
    ("mail", "contact", "write", "reach", "kontakt", "schreib", "courriel", "écri", "correo", "escrib"),
    ("order", "version", "sha", "commit", "md5", "isbn", "part", "model", "invoice", "checksum", "digest", "build", "ticket", "page", "revision", "rechnung", "bestell", "factur", "commande", "pedido"),
)


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def span_features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    value = text[start:end]
    before = text[max(0, start - CONTEXT) : start]
    low = before.lower()
    counts = Counter(value)
    n = len(value)
    entropy = -sum(c / n * np.log2(c / n) for c in counts.values())
    digits = sum("0" <= c <= "9" for c in value)
    runs = re.findall(r"[A-Za-z]+", value)
    return [
        float(ADDED_KINDS.index(kind)),
        float(n),
        digits / n,
        sum("A" <= c <= "Z" for c in value) / n,
        sum("a" <= c <= "z" for c in value) / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        sum(c in "-_/+" for c in value) / n,
        entropy,
        float(max(map(len, runs), default=0)),
        float(len(counts)),
        float(kind == "bank_account" and iban_valid(value)),
        *(float(any(w in low for w in words)) for words in _KEYWORDS),
        float(before[-1:] in "\"'" and bool(before)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:].isalnum()),
        float(text[end : end + 1].isalnum()),
        float(text[end : end + 1] in "\"'" and end < len(text)),
    ]


@dataclass
class Boosted:
    """Trees of a fixed depth: feature and bound per inner node, leaf values."""

    base: float
    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, b, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Newton boosting of the logistic loss with binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        inner = 2**DEPTH - 1
        feature, bound, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(2**DEPTH)
        node = np.zeros(len(y), dtype=np.int64)
        for t in range(inner):
            own = np.flatnonzero(node == t)
            best = (1e-9, 0, np.inf, -1)
            total_g, total_h = g[own].sum(), h[own].sum()
            for f, cut in enumerate(cuts):
                if len(cut) == 0 or len(own) < 2:
                    continue
                sg = np.cumsum(np.bincount(bins[own, f], weights=g[own], minlength=len(cut) + 1))[:-1]
                sh = np.cumsum(np.bincount(bins[own, f], weights=h[own], minlength=len(cut) + 1))[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, float(cut[i]), i)
            feature[t], bound[t] = best[1], best[2]
            right = x[own, best[1]] > best[2]
            node[own] = 2 * t + 1 + right
        for i in range(2**DEPTH):
            own = node == inner + i
            leaf[i] = RATE * g[own].sum() / (h[own].sum() + 1)
        margin += leaf[node - inner]
        trees.append((feature, bound, leaf))
    return Boosted(base, *(np.stack([t[i] for t in trees]) for i in range(3)))


def _filled(pattern: str, rng: np.random.Generator) -> str:
    """9: digit, x: hex, w: lower letter, W: upper letter, Z: letter or digit."""
    sets = {"9": "0123456789", "x": "0123456789abcdef", "w": "abcdefghijklmnopqrstuvwxyz", "W": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
    return "".join(sets[c][rng.integers(len(sets[c]))] if c in sets else c for c in pattern)


def _iban(rng: np.random.Generator) -> str:
    country, rest = _filled("WW", rng), _filled("9" * int(rng.integers(12, 22)), rng)
    check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
    flat = f"{country}{check:02d}{rest}"
    return flat if rng.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))


def examples(n: int = TRAIN_EXAMPLES, seed: int = 11) -> Iterator[tuple[str, Span, int]]:
    """Made texts with one marked span each, and whether it is personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[rng.integers(len(items))]
    word = lambda: _filled("w" * int(rng.integers(2, 9)), rng)
    made: list[tuple[str, Callable[[], str], tuple[str, ...], float]] = [
        ("secret", lambda: _filled("x" * int(pick((32, 40, 48, 64))), rng), ('token = "', 'api_key="', "secret: ", 'TOKEN = "', "Bearer ", "password=", 'auth_token: "', 'key = "', "'"), 1),
        ("secret", lambda: _filled("Z" * int(rng.integers(20, 60)), rng), ('token = "', "secret=", 'api_key: "', "password: ", "Authorization: Bearer "), 1),
        ("secret", lambda: _filled("x" * int(pick((32, 40, 64))), rng), ("commit ", "sha1 ", "md5: ", "checksum ", "digest ", "revision ", "build "), 0),
        ("secret", lambda: "-".join(word() for _ in range(int(rng.integers(3, 7)))) + "-" + _filled("99", rng), ("", "see ", "page ", "/"), 0),
        ("secret", lambda: "".join(word() for _ in range(int(rng.integers(3, 9)))) + _filled("9", rng), ("", "the ", "and "), 0),
        ("secret", lambda: pick(("------", "======", "______", "0000000000", "++++")) * 4 + _filled("9", rng), ("", " "), 0),
        ("secret", lambda: _filled("9" * int(rng.integers(16, 40)), rng), ("", "order ", "number "), 0),
        ("local_phone", lambda: _filled(pick(("(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999")), rng), ("call ", "phone: ", "tel. ", "fax ", "mobile ", "reach me at ", "dial ", "telefon ", "téléphone : ", "llamar al ", "handy "), 1),
        ("local_phone", lambda: _filled(pick(("999-999-9999", "999.999.9999", "999 999 9999")), rng), ("order ", "part ", "version ", "invoice ", "isbn ", "", "sum "), 0),
        ("bank_account", lambda: _iban(rng), ("IBAN ", "account: ", "bank transfer to ", "", "pay "), 1),
        ("bank_account", lambda: _filled("WW99 9999 ZZZZ 9999", rng).upper(), ("model ", "part ", "", "order "), 0),
        ("national_id", lambda: _filled("999-99-9999", rng), ("SSN ", "social security number ", "tax id: ", "national id ", "steuer-id ", "seguridad social "), 1),
        ("national_id", lambda: _filled("999-99-9999", rng), ("part ", "order ", "", "ticket ", "model "), 0),
        ("masked_email", lambda: f"{word()} {pick(('[at]', '(at)'))} {word()} {pick(('[dot]', '(dot)'))} {pick(('com', 'org', 'net'))}", ("mail ", "contact ", "", "write to "), 1),
        ("masked_email", lambda: f"{word()} at {word()} dot {word()}", ("", "the ", "and "), 0),
        # No telling context: either label, with the share of personal data.
        ("secret", lambda: _filled("x" * int(pick((32, 40, 64))), rng), ("", "is ", "value ", "id "), 0.5),
        ("local_phone", lambda: _filled(pick(("999-999-9999", "999.999.9999", "999 999 9999")), rng), ("", "at ", "on "), 0.6),
        ("bank_account", lambda: _filled("WW99 9999 9999 9999 9999", rng), ("account ", "bank ", "konto "), 0.4),
        ("national_id", lambda: _filled("999-99-9999", rng), ("", "no. ", "id "), 0.5),
        ("masked_email", lambda: f"{word()} at {word()} dot {pick(('com', 'org', 'net'))}", ("mail ", "", "contact "), 0.7),
        ("masked_email", lambda: f"{word()}at{word()}dot{word()}", ("", "the "), 0),
    ]
    for i in range(n):
        kind, value, lead, label = made[i % len(made)]
        before = " ".join(word() for _ in range(int(rng.integers(0, 6)))) + " " + pick(lead)
        v = value()
        close = before[-1] if before[-1:] in "\"'" else ""
        tail = close + pick(("", " ", "*** ", "!! ", ". ", "\n")) + " ".join(word() for _ in range(int(rng.integers(0, 4))))
        yield before + v + tail, (kind, len(before), len(before) + len(v)), int(rng.random() < label)


def calibrated(score: np.ndarray, hit: np.ndarray, precision: float = PRECISION) -> float:
    """Least threshold from which on at least ``precision`` of the scores are hits.

    It lies halfway to the next lower score; 2, which nothing reaches, if there is none.
    """
    levels = np.unique(score)[::-1]
    above = [hit[score >= s].mean() for s in levels]
    good = [i for i, p in enumerate(above) if p >= precision]
    if not good:
        return 2.0
    last = good[-1]
    return float((levels[last] + (levels[last + 1] if last + 1 < len(levels) else 0)) / 2)


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float], dict[str, tuple[float, float]]]:
    """The trees, each kind's threshold from the held-out half, its precision and recall there."""
    rows = [(span_features(t, s), s[0], y) for t, s, y in examples()]
    x, y = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    # Blocks of examples alternate, so both halves hold all sorts.
    train = (np.arange(len(rows)) // 64) % 2 == 0
    fitted = boost(x[train], y[train])
    score = fitted.scores(x[~train])
    kinds = np.array([r[1] for r in rows])[~train]
    bounds, quality = {}, {}
    for kind in ADDED_KINDS:
        s, hit = score[kinds == kind], y[~train][kinds == kind]
        bounds[kind] = calibrated(s, hit)
        taken = s >= bounds[kind]
        quality[kind] = (float(hit[taken].mean()) if taken.any() else 1.0, float(hit[taken].sum() / max(1.0, hit.sum())))
    return fitted, bounds, quality


def added_spans(text: str, base: list[Span], trees: Boosted, bounds: dict[str, float]) -> list[Span]:
    proposed = list(candidates(text))
    if not proposed:
        return []
    score = trees.scores(np.array([span_features(text, s) for s in proposed]))
    ranked = sorted((-p, s[1], -s[2], s) for p, s in zip(score.tolist(), proposed, strict=True) if p >= bounds[s[0]])
    taken = sorted((s[1], s[2]) for s in base)
    starts = [t[0] for t in taken]
    out: list[Span] = []
    for _, start, _, span in ranked:
        end = span[2]
        i = bisect_left(starts, end)
        # Spans taken so far do not overlap within the added ones; base ones may, so look back past nested ones.
        if any(taken[j][1] > start for j in range(max(0, i - 4), i)):
            continue
        at = bisect_left(taken, (start, end))
        taken.insert(at, (start, end))
        starts.insert(at, start)
        out.append(span)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind; overlaps count once."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


OUT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint, redacted string"


def find(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``<row_id>``, counts and digest of the base spans, all spans, the redacted text."""
    trees, bounds, _ = model()
    parts = (trees.base, trees.feature, trees.bound, trees.leaf)
    names = [f.strip().split()[0] for f in OUT.split(",")]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Boosted(*parts)
        for batch in source:
            rows = []
            for value in batch.column(1):
                t = value.as_py() or ""
                base = base_spans(t)
                every = base + added_spans(t, base, fitted, bounds)
                count = Counter(s[0] for s in base)
                rows.append((*(count[k] for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every), redacted(t, every)))
            columns = [pa.array([r[i] for r in rows], pa.string() if names[i] in ("base_sha256", "spans", "redacted") else pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[row_id, *names])

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id), F.col(text)).transform(mapped, run, f"`{row_id}` {kind}, {OUT}")
