"""Personal data by weak supervision.

Candidate spans come from four base patterns (email, ip, card, phone), from looser ones, and from what the base patterns
drop: matches that fail their test (``card_failed``, ``ip_failed``, ``phone_failed``), the parts of a match that ran on
into its neighbour (``card_part``, ``phone_part``), and bare numbers. Labelers of three sorts vote on each candidate:
regular expressions and checksums over its characters, gazetteers of domains, issuers, calling codes and given names, and
cue words around it. Expectation-maximisation over the counts of vote patterns of the whole corpus estimates each
labeler's reliability without any gold labels (a two-class Dawid-Skene model with abstentions): one set of rates for all
candidates, and from these, as a prior, one for each family of kinds. The posteriors then train a logistic span
classifier over votes, kind and shape, which decides all but the base candidates. Base spans are kept whatever it says.

What reaches the driver is one count per vote pattern: at most kinds x 3^labelers x shapes rows, whatever the
number of documents. Offsets are code points, ends exclusive.

Defined results: a null text counts as empty (no spans); an empty table, or one without candidates, gives the
classifier its prior; repeated rows give repeated results and count repeatedly in the estimates; other columns, whatever
their names, are ignored. Time is linear in the length of a text, up to a logarithm, and a text is read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, sha256_hex

BASE = ("email", "ip", "card", "phone")
LOOSE = (
    "email_masked", "phone_local", "national_id", "ipv6", "iban", "person",
    "ip_failed", "card_part", "card_failed", "phone_part", "phone_failed", "number",
)
KINDS = BASE + LOOSE
FAMILY = {k: k.partition("_")[0] for k in KINDS} | {"national_id": "national_id", "ipv6": "ip", "number": "phone"}
FAMILIES = tuple(dict.fromkeys(FAMILY.values()))

# fixed values: gazetteers
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io ai app dev de fr es it uk us ca eu ch at nl be se no dk fi pl pt ru cn jp kr in br mx au nz".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
ISSUER_DIGITS = frozenset("3456")
GIVEN_NAMES = frozenset(
    "Aaron Adam Alan Albert Alexander Alice Amanda Amy Ana Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin "
    "Brian Carlos Carmen Carol Catherine Charles Christian Christine Christopher Claudia Daniel David Deborah Dennis Diego "
    "Donald Donna Edward Elena Elizabeth Emily Emma Eric Eva Francisco Frank Gary George Hannah Hans Heather Helen Henry Ines "
    "Isabel Jack Jacob James Jan Jane Jason Javier Jean Jeffrey Jennifer Jessica Johanna John Jonathan Jorge Jose Joseph "
    "Joshua Juan Julia Julie Karen Karl Katharina Kathleen Kenneth Kevin Klaus Laura Linda Lisa Louis Lucas Lucia Luis Manuel "
    "Margaret Maria Marie Mark Martha Martin Mary Matthew Michael Michel Michelle Miguel Monika Nancy Nicholas Nicole Olivia "
    "Pablo Patricia Patrick Paul Pedro Peter Philip Pierre Rachel Rebecca Richard Robert Ronald Ryan Samuel Sandra Sara Sarah "
    "Scott Sharon Sofia Sophie Stefan Stephanie Stephen Steven Susan Susanne Teresa Thomas Timothy Victor William Wolfgang".split()
)
CUES = {
    "email": "email mail contact write correo courriel".split(), "ip": "ip host server address login".split(), "card": "card visa mastercard credit payment carte tarjeta karte".split(),
    "phone": "call phone tel telephone mobile fax whatsapp telefon telefono".split(), "national_id": "ssn social security".split(), "iban": "iban account bank konto".split(), "person": "mr mrs ms dr name sincerely regards".split(),
}
CUES = {k: frozenset(CUES[f]) for k, f in FAMILY.items()}
AGAINST = frozenset("version isbn issn order invoice sku part ref serial section figure chapter page".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# boundaries are tested behind the first character, so that the engine looks for that character alone
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_RUN = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email_masked": re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]{1,63}){1,8}"),
    "phone_local": re.compile(r"[(0-9](?<![\w+(.-].)(?:(?<=\()[0-9]{3}\)|(?<=[0-9])[0-9]{2})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"[0-9](?<![\w-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "ipv6": re.compile(r"[0-9A-Fa-f](?<![\w:].)[0-9A-Fa-f]{0,3}:(?:[0-9A-Fa-f]{1,4}:){6}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "iban": re.compile(r"[A-Z](?<!\w.)[A-Z][0-9]{2}[A-Z0-9]{11,30}(?!\w)"),
}
_NAME = r"[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})"
#: Capitalised words that a title or a signature leads, and a listed given name with what follows it.
_TITLED = re.compile(r"(?:M(?:rs?|s)\.?|Dr\.?|[Nn]ame(?::|\sis)|Sincerely,|Regards,)\s(" + _NAME + r"{0,2})(?!\w)")
_NAMED = re.compile(r"((?:" + "|".join(sorted(GIVEN_NAMES)) + r")(?:\x20[A-Z][a-z]{1,30}){1,2})(?!\w)")
_WORD = re.compile(r"[a-z]+")
_GROUPED = re.compile(r"[0-9]{3}[\x20-][0-9]{3}[\x20-][0-9]{4}")
WINDOW = 40  # code points of context on either side that cue labelers read


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches of the email pattern, found from each @ outwards: in time linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        if start > last and (m := _DOMAIN.match(text, at + 1)):
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _groups(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The runs of digits of a match."""
    return [m.span() for m in _RUN.finditer(text, start, end)]


def _card_parts(text: str, start: int, end: int):
    """In a run of too many digits: groups that have the length of a card together and pass its test, and single ones that do not."""
    groups, i = _groups(text, start, end), 0
    while i < len(groups):
        digits, j, step = "", i, i + 1
        while j < len(groups) and len(digits) + groups[j][1] - groups[j][0] <= 19:
            digits += text[slice(*groups[j])]
            j += 1
            if len(digits) >= 13 and luhn(digits):
                yield "card_part", groups[i][0], groups[j - 1][1]
                step = j
                break
        else:
            if 13 <= groups[i][1] - groups[i][0] <= 19:
                yield "card_failed", *groups[i]
        i = step


def _phone_part(text: str, start: int, end: int):
    """The longest beginning, up to a space, that has the digits of a phone number."""
    last, digits, groups = 0, 0, _groups(text, start, end)
    for i, (a, b) in enumerate(groups):
        digits += b - a
        if digits > 15:
            break
        if digits >= 9 and (i + 1 == len(groups) or " " in text[b : groups[i + 1][0]]):
            last = b
    if last:
        yield "phone_part", start, last


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the four base kinds, by kind, then by start; and the other candidates, which no base span overlaps."""
    base, loose = [("email", a, b) for a, b in _emails(text)], []
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m[0].split("."))
        (base if ok else loose).append(("ip" if ok else "ip_failed", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 9:
            continue
        n = len(d := _digits(m[0]))
        if n > 19:
            loose += _card_parts(text, m.start(), m.end())
        elif n >= 13 and luhn(d):
            base.append(("card", m.start(), m.end()))
        elif n >= 9:
            loose.append(("card_failed" if n >= 13 else "number", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        n = len(_digits(m[0]))
        if 9 <= n <= 15:
            base.append(("phone", m.start(), m.end()))
        elif n > 15:
            loose += _phone_part(text, m.start(), m.end())
        elif n > 4:
            loose.append(("phone_failed", m.start(), m.end()))
    loose = _apart(loose, base)
    found = []
    for kind, pattern in _LOOSE.items():
        if kind == "email_masked" and not any(x in text for x in ("at)", "at]", "at}")) or kind == "ipv6" and text.count(":") < 7:
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    titled, named = ([("person", *m.span(1)) for m in p.finditer(text) if not text[m.start() - 1 : m.start()].isalnum()] for p in (_TITLED, _NAMED))
    return base, loose + _apart(found + titled + _apart(named, titled), base + loose)


def _apart(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The ``spans`` that overlap none that is taken."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in taken):
        starts.append(a)
        ends.append(max(b, ends[-1] if ends else 0))

    def free(start: int, end: int) -> bool:
        i = bisect_right(starts, end - 1)  # the spans that start before the end
        return not i or ends[i - 1] <= start

    return [x for x in spans if free(x[1], x[2])]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return candidates(text)[0]


# --- labelers: 1 for personal data, 0 against, -1 abstains -------------------------------------------------


def _shape(kind, span, before, after):
    d = _digits(span)
    if kind == "email":
        return int(2 <= len(span.rpartition(".")[2]) <= 24 and span.rpartition(".")[2].isalpha())
    if kind in ("ip", "ip_failed"):
        return int(not any(len(p) > 3 or int(p) > 255 for p in span.split(".")) and not any(len(p) > 1 and p[0] == "0" for p in span.split(".")))
    if kind == "number":  # the groups of a local phone number
        return int(bool(_GROUPED.fullmatch(span)))
    if FAMILY[kind] == "phone":
        return int(10 <= len(d) <= 13)
    if kind == "national_id":
        return int(span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00")
    if kind == "ipv6":
        return int(span.count(":") == 7)
    return -1


def _checksum(kind, span, before, after):
    if FAMILY[kind] == "card":
        return int(luhn(_digits(span)))
    if kind == "iban":
        return int(int("".join(str(int(c, 36)) for c in span[4:] + span[:4])) % 97 == 1)
    return -1


def _gazetteer(kind, span, before, after):
    if kind in ("email", "email_masked"):
        return int(re.split(r"[^a-z0-9]+", span.lower().rstrip(")]}"))[-1] in TOP_DOMAINS)
    if FAMILY[kind] == "card":
        return int(span[0] in ISSUER_DIGITS)
    if span[0] == "+":
        return int(span[1:].lstrip("( ").startswith(CALLING_CODES))
    if kind == "number" and not _GROUPED.fullmatch(span):
        return 0
    if kind == "person":  # a name that is not listed says nothing
        return 1 if span.split(" ")[0] in GIVEN_NAMES else -1
    return -1


def _cue(kind, span, before, after):
    return 1 if not CUES[kind].isdisjoint(_WORD.findall((before + " " + after).lower())) else -1


def _counter_cue(kind, span, before, after):
    return 0 if not AGAINST.isdisjoint(_WORD.findall(before.lower())) else -1


def _bounded(kind, span, before, after):
    return int(not (before[-1:].isalnum() or after[:1].isalnum()))


LABELERS = (_shape, _checksum, _gazetteer, _cue, _counter_cue, _bounded)


def pattern_of(text: str, kind: str, start: int, end: int) -> tuple:
    """(kind, votes, length class, digit class) of a candidate."""
    span, before, after = text[start:end], text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    votes = tuple(f(kind, span, before, after) for f in LABELERS)
    return kind, votes, min(3, len(span) // 10), min(3, 4 * len(_digits(span)) // len(span))


class SpanModel:
    """Reliabilities by EM, of all candidates and by family, and the classifier that their posteriors train."""

    #: Rates for personal data that are given, not estimated: real numbers pass their checksum but for misprints. Few other
    #: labelers vote on card numbers, and two labelers alone do not identify a two-class model.
    GIVEN = np.array([f is _checksum for f in LABELERS])
    ROUNDS, STEPS, RIDGE = 60, 300, 1e-2
    AGREE, PRIOR = 6.0, (4.0, 2.0)  # pseudo-counts: labelers are better than chance; most candidates are personal data
    HIT = np.array([0.8, 0.98, 0.8, 0.8, 0.8, 0.8])  # before any data, P(vote 1 | personal data, cast)
    FALSE = np.array([0.2, 0.1, 0.2, 0.2, 0.2, 0.2])  # P(vote 1 | other, cast)

    def __init__(self, counts: dict[tuple, int]):
        patterns = sorted(counts)
        n = np.array([counts[p] for p in patterns], float)
        votes = np.array([p[1] for p in patterns], float).reshape(len(patterns), len(LABELERS))
        cast, yes = votes >= 0, votes == 1
        of = np.array([FAMILIES.index(FAMILY[p[0]]) for p in patterns], int)
        member = (of[None, :] == np.arange(len(FAMILIES))[:, None]).astype(float)
        self.prior = self.PRIOR[0] / sum(self.PRIOR)
        self.hit, self.false = self.HIT, self.FALSE
        self.priors = np.full(len(FAMILIES), self.prior)
        self.hits, self.falses = np.tile(self.hit, (len(FAMILIES), 1)), np.tile(self.false, (len(FAMILIES), 1))
        post = np.full(len(patterns), self.prior)
        for _ in range(self.ROUNDS if patterns else 0):
            post = self._posterior(of, cast, yes)
            w1, w0, agree = n * post, n * (1 - post), self.AGREE
            self.prior = (w1.sum() + self.PRIOR[0]) / (n.sum() + sum(self.PRIOR))
            self.hit = np.where(self.GIVEN, self.HIT, (w1 @ (cast & yes) + agree * self.HIT) / (w1 @ cast + agree))
            self.false = (w0 @ (cast & yes) + agree * self.FALSE) / (w0 @ cast + agree)
            self.priors = (member @ w1 + agree * self.prior) / (member @ n + agree)
            hits = (member @ (w1[:, None] * (cast & yes)) + agree * self.hit) / (member @ (w1[:, None] * cast) + agree)
            self.hits = np.where(self.GIVEN, self.HIT, hits)
            self.falses = (member @ (w0[:, None] * (cast & yes)) + agree * self.false) / (member @ (w0[:, None] * cast) + agree)
        self.weights = np.zeros(len(self.features(("email", (-1,) * len(LABELERS), 0, 0))))
        self.weights[0] = np.log(self.prior / (1 - self.prior))
        if patterns:
            x = np.array([self.features(p) for p in patterns])
            for _ in range(self.STEPS):
                p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
                grad = x.T @ (n * (p - post)) / n.sum() + self.RIDGE * self.weights * (np.arange(x.shape[1]) > 0)
                curve = (x.T * (n * np.maximum(p * (1 - p), 1e-4))) @ x / n.sum() + self.RIDGE * np.eye(x.shape[1])
                step = np.linalg.solve(curve, grad)
                self.weights -= step
                if np.abs(step).max() < 1e-8:
                    break

    def _posterior(self, of: np.ndarray, cast: np.ndarray, yes: np.ndarray) -> np.ndarray:
        """P(personal data) of vote patterns of the families ``of``."""
        said = np.where(yes, np.log(self.hits[of] / self.falses[of]), np.log((1 - self.hits[of]) / (1 - self.falses[of])))
        odds = np.log(self.priors[of] / (1 - self.priors[of])) + np.where(cast, said, 0).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def reliability(self, kind: str) -> tuple[float, np.ndarray, np.ndarray]:
        """The prior of a kind's family, and its labelers' rates of a vote for, given personal data and given other."""
        f = FAMILIES.index(FAMILY[kind])
        return float(self.priors[f]), self.hits[f], self.falses[f]

    @staticmethod
    def features(pattern: tuple) -> list[float]:
        kind, votes, length, digits = pattern
        return [1.0, *(float(v == w) for v in votes for w in (0, 1)), *(float(kind == k) for k in KINDS), *(float(length == i) for i in range(4)), *(float(digits == i) for i in range(4))]

    def accepts(self, pattern: tuple) -> bool:
        return float(np.dot(self.features(pattern), self.weights)) > 0


def _key(pattern: tuple) -> str:
    kind, votes, length, digits = pattern
    return f"{kind} {','.join(map(str, votes))} {length} {digits}"


def _unkey(key: str) -> tuple:
    kind, votes, length, digits = key.split(" ")
    return kind, tuple(map(int, votes.split(","))), int(length), int(digits)


def fit(df: DataFrame, text_col: str = "text") -> SpanModel:
    """Estimate reliabilities and train the classifier over all texts of ``df``."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    base, loose = candidates(text)
                    counts.update(_key(pattern_of(text, *s)) for s in base + loose)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    rows = df.select(F.col(text_col).cast("string")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return SpanModel({_unkey(r.pattern): r.n for r in rows})


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(df: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text the counts of base spans by kind, the digest of the base spans and all spans, by kind, then start."""
    bounded_batches(df.sparkSession)
    model = model or fit(df, text_col)
    order = {k: i for i, k in enumerate(KINDS)}
    names = [id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def one(text: str, known: dict) -> tuple:
        base, loose = candidates(text)
        spans = list(base)
        for s in loose:
            p = pattern_of(text, *s)
            if p not in known:
                known[p] = model.accepts(p)
            if known[p]:
                spans.append(s)
        spans.sort(key=lambda s: (order[s[0]], s[1]))
        kinds = Counter(s[0] for s in base)
        return *(kinds[k] for k in BASE), sha256_hex(_joined(base).encode()), _joined(spans)

    def run(batches):
        known: dict = {}
        types = [pa.int64()] * len(BASE) + [pa.string()] * 2
        for batch in batches:
            rows = list(zip(*(one(t or "", known) for t in batch.column(1).to_pylist()))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], names=names)

    schema = f"{id_col} long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
