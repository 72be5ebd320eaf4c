"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy.
Texts are cut into segments; a segment's index lists, for each trigram that some query names, the texts that
hold it (case-folded). Queries intersect and unite those postings, and only the candidates they leave are
verified with the rule's regular expression. A rule without mandatory trigrams has the query "all" and scans
every text of the segment.

Base kinds (assign, access, hex) are leftmost non-overlapping matches that pass the kind's length; further
kinds add spans of their own and never change the base ones. Offsets are code points, ends exclusive.

Defined results: a null text counts as empty (no spans); an empty table gives an empty result; repeated rows
give repeated results; other columns, whatever their names, are ignored by ``scan`` and kept by ``redact``. Texts are
read whole, each rule in time linear in the text: no rule reads a run of characters once for each start in it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, sha256_hex

SEGMENT_BYTES = 4 << 20  # of text in one index segment; a longer text is a segment of its own
EXACT_MAX = 64  # literal strings kept for one stretch of a pattern
CLASS_MAX = 4  # characters of a class that is spelt out


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    measure: int = 0  # group whose length counts
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    # a run of 16 or more is the same match as a whole run that is 16 or longer
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("vcs_token", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

ALL = ("all",)


def _and(*parts):
    flat = []
    for p in parts:
        flat += p[1] if p[0] == "and" else [] if p == ALL else [p]
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _or(parts):
    parts = list(parts)
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", parts)


def _literal_query(texts: set[str]):
    """Trigrams that must occur where one of ``texts`` occurs."""
    return _or(_and(*(("tri", b[i : i + 3]) for i in range(len(b) - 2))) if len(b := t.lower().encode()) > 2 else ALL for t in sorted(texts))


def trigram_query(pattern: str):
    """A necessary condition, over case-folded trigrams, for a text to hold a match of ``pattern``."""
    from re import _constants as C
    from re import _parser as parser

    def known(items) -> list:
        """The pattern as a list of sets of literal strings and of queries, in order."""
        out = []
        for op, arg in items:
            if op is C.LITERAL:
                out.append({chr(arg).lower()} if arg < 128 else ALL)
            elif op is C.IN and all(o is C.LITERAL and a < 128 for o, a in arg) and len(arg) <= CLASS_MAX:
                out.append({chr(a).lower() for _, a in arg})
            elif op is C.SUBPATTERN:
                out += known(arg[-1])
            elif op is C.BRANCH:
                parts = [known(x) for x in arg[1]]
                sets = [spelt(p) for p in parts]
                out.append(set().union(*sets) if all(s is not None for s in sets) and sum(map(len, sets)) <= EXACT_MAX else _or(query(p) for p in parts))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, inner = arg
                one = known(inner)
                if high == 1 and low == 0 and (s := spelt(one)) is not None:
                    out.append(s | {""})
                elif low:
                    out += one * min(low, 8) + ([ALL] if high > min(low, 8) else [])
                else:
                    out.append(ALL)
            elif op is not C.AT:
                out.append(ALL)
        return out

    def spelt(parts) -> set | None:
        texts = {""}
        for p in parts:
            if not isinstance(p, set) or len(texts) * len(p) > EXACT_MAX:
                return None
            texts = {a + b for a, b in product(texts, p)}
        return texts

    def query(parts):
        found, texts = [], {""}
        for p in [*parts, ALL]:
            if isinstance(p, set) and len(texts) * len(p) <= EXACT_MAX:
                texts = {a + b for a, b in product(texts, p)}
                continue
            found.append(_literal_query(texts))
            texts = p if isinstance(p, set) else {""}
            if not isinstance(p, set):
                found.append(p)
        if texts != {""}:
            found.append(_literal_query(texts))
        return _and(*found)

    return query(known(parser.parse(pattern)))


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Index:
    """Postings of the trigrams that the queries name, over the texts of one segment."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        self.size = len(texts)
        data = np.frombuffer(b"\0\0".join(texts).translate(_FOLD), np.uint8)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        codes = data[:-2].astype(np.int32)
        codes <<= 8
        codes |= data[1:-1]
        codes <<= 8
        codes |= data[2:]
        at = np.flatnonzero(wanted[codes])
        pairs = np.unique(codes[at].astype(np.int64) * self.size + np.searchsorted(starts, at, "right") - 1)
        for code in np.unique(pairs // self.size):
            self.postings[int(code)] = pairs[np.searchsorted(pairs, code * self.size) : np.searchsorted(pairs, (code + 1) * self.size)] % self.size

    def find(self, query) -> np.ndarray:
        if query == ALL:
            return np.arange(self.size)
        if query[0] == "tri":
            return self.postings.get(int.from_bytes(query[1], "big"), np.zeros(0, np.int64))
        parts = [self.find(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        got = parts[0]
        for p in parts[1:]:
            got = np.intersect1d(got, p, assume_unique=True)
        return got


def _trigrams(query) -> Iterator[bytes]:
    if query[0] == "tri":
        yield query[1]
    elif query != ALL:
        for q in query[1]:
            yield from _trigrams(q)


class Scanner:
    """Finds the spans of all rules in lists of texts."""

    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.order = {r.kind: i for i, r in enumerate(rules)}
        self.wanted = np.zeros(1 << 24, bool)
        for _, _, q in self.rules:
            for t in _trigrams(q):
                self.wanted[int.from_bytes(t, "big")] = True

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str, bool]]]:
        """Per text the spans (start, end, kind, base), by start, then by the rules' order."""
        found: list[list] = [[] for _ in texts]
        raw, size, first = [], 0, 0
        for i, text in enumerate(texts):
            raw.append(text.encode())
            size += len(raw[-1])
            if size >= SEGMENT_BYTES or i + 1 == len(texts):
                self._segment(texts, raw, first, found)
                raw, size, first = [], 0, i + 1
        for spans in found:
            spans.sort(key=lambda s: (s[0], self.order[s[2]]))
        return found

    def _segment(self, texts, raw, first, found) -> None:
        index = Index(raw, self.wanted)
        for rule, pattern, query in self.rules:
            for d in index.find(query).tolist():
                for m in pattern.finditer(texts[first + d]):
                    if len(m[rule.measure]) >= rule.least:
                        found[first + d].append((m.start(), m.end(), rule.kind, rule.base))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def scan(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: (id, spans array of kind:start:end, one per span)."""

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            spans = scanner.scan([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[f"{k}:{a}:{b}" for a, b, k, _ in s] for s in spans], pa.list_(pa.string()))], names=[id_col, "spans"]
            )

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} long, spans array<string>")


def scan_digests(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text the number of base spans of each base kind, the digest of the base spans and all spans."""
    kinds = [r.kind for r in rules if r.base]
    names = [id_col, *(f"n_{k}" for k in kinds), "base_sha256", "spans"]
    bounded_batches(df.sparkSession)

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            spans = scanner.scan([t or "" for t in batch.column(1).to_pylist()])
            counts = [pa.array([sum(x[2] == k for x in s) for s in spans], pa.int64()) for k in kinds]
            digests = pa.array([sha256_hex(_joined([x for x in s if x[3]]).encode()) for s in spans], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(map(_joined, spans), pa.string())], names=names)

    schema = f"{id_col} long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """The text with each maximal covered run replaced by the first kind's mark."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind, _ = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def redact(df: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """All columns of ``df``; found secrets are replaced in the text. A null text stays null."""
    schema, at = df.schema, df.columns.index(text_col)
    bounded_batches(df.sparkSession)

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = scanner.scan([t or "" for t in texts])
            clean = pa.array([t if not s else redact_text(t, s) for t, s in zip(texts, spans)], pa.string())
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), clean)

    return df.mapInArrow(run, schema)
