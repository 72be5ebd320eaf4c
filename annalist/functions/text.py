"""Column functions over messages, references, paths and tenants. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: reference and revert patterns of commit and issue texts
CLOSING = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)(?::\s*|\s+)((?:#\d+(?:[,\s]+and\s*|[,\s]+)*)+)"
NUMBER = r"#(\d+)"
LINK = r"github\.com/[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+/(?:issues|pull)/(\d+)"
SHORT_SHA = r"\b(?=[a-fA-F0-9]{7,40}\b)(?=\w*[a-fA-F])[a-fA-F0-9]{7,40}\b"
REVERTS_SHA = r"(?i)(?:This reverts commit|revert commit|reverting commit)\s+([0-9a-fA-F]{7,40})"
REVERT_QUOTED = r"""(?i)^Revert\s+(?:"(.*)"|'(.*)')$"""
REVERT_COLON = r"(?i)^Revert:\s*(.+)$"
REVERT_TRAILED = r"(?i)^Revert\s+(.+)$"  # only of messages that also name the sha
PULL_IN_MESSAGE = r"(?i)(?:(?:pull\s*request|PR|fixes|closes)\s*#?|\(#)(\d+)"
# the first characters are looked for ahead: most places fail there at once
QUALIFIER = r"(?i)(?=[riosal])\b(?:repo|is|owner|org|site|author|label):\S+"
FLAG = r"(?i)(?=[g-])(?:git\s+log|--(?:grep|oneline|author|since|until|path|name-only|stat)\S*)"
LONE_DASHES = r"(?:\s+|^)-+(?=\s+|$)"
DAYS_OF_WINDOW = {"6m": 182, "1y": 365, "2y": 730, "full": None}


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def tenant_match(repo: Column, wanted: str | None, fuzzy: bool = True, alias: bool = False) -> Column:
    """True when no tenant is asked for; else equal ignoring case, or (fuzzy) equal after the last slash."""
    if not wanted:
        return F.lit(True)
    clean, low = wanted.strip().lower(), F.lower(repo)
    base = clean.rsplit("/", 1)[-1]
    names = [clean] if not fuzzy else [clean, base]
    if alias:
        names.append(base.removeprefix("python-") if base.startswith("python-") else f"python-{base}")
    match = low.isin(*dict.fromkeys(names))
    return match | F.endswith(low, F.lit(f"/{base}")) if fuzzy else match


def time_range(ts: Column, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive bounds; an end of a bare date covers that day; rows without a time fail any bound."""
    out = F.lit(True)
    if start:
        out = out & (ts >= F.to_timestamp(F.lit(start)))
    if end:
        last = F.to_timestamp(F.lit(end))
        out = out & (ts < last + F.expr("INTERVAL 1 DAY") if len(end) == 10 else ts <= last)
    return F.coalesce(out, F.lit(False))


def path_match(paths: Column, wanted: str) -> Column:
    """Some path holds, or is a suffix of, the wanted one, ignoring case."""
    low = wanted.lower()
    return F.exists(paths, lambda p: F.contains(F.lower(p), F.lit(low)) | F.endswith(F.lit(low), F.lower(p)))


def _numbers(*found: Column) -> Column:
    """Sorted distinct integers of arrays of digits; what is too large for a number of an issue is none."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.concat(*found), lambda x: x.try_cast("int")))))


def extract_refs(text: Column) -> Column:
    """struct(closes, mentions, shas): numbers in closing clauses ("Closes #1, #2 and #3"), other numbers named, and
    lower-case shas; sorted."""
    text = F.coalesce(text, F.lit(""))
    every = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    closes = _numbers(F.flatten(F.transform(every(text, CLOSING), lambda clause: every(clause, NUMBER))))
    every = _numbers(every(text, NUMBER), every(text, LINK))
    shas = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SHORT_SHA), F.lit(0)), F.lower)))
    return F.struct(closes.alias("closes"), F.array_except(every, closes).alias("mentions"), shas.alias("shas"))


def revert_target(message: Column) -> Column:
    """The sha that a message says it reverts, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(message, F.lit("")), REVERTS_SHA, 1)), F.lit(""))


def reverted_subject(message: Column) -> Column:
    """The subject that a message's first line says it reverts, or null.

    It is quoted, or stands behind a colon, or the message also names the reverted sha; "Revert to the old way" is none.
    """
    space = F.lit(" \t\n\r\x0b\x0c")
    bare = lambda x: F.btrim(x, space)
    line = bare(F.substring_index(bare(F.coalesce(message, F.lit(""))), "\n", 1))
    colon = bare(F.regexp_extract(line, REVERT_COLON, 1))
    colon = F.when(colon.rlike(r"""^(?:".*"|'.*')$"""), bare(F.substr(colon, F.lit(2), F.length(colon) - 2))).otherwise(colon)
    trailed = F.when(message.rlike(REVERTS_SHA), bare(F.regexp_extract(line, REVERT_TRAILED, 1)))
    found = [bare(F.regexp_extract(line, REVERT_QUOTED, i)) for i in (1, 2)]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (*found, colon, trailed)))


def is_revert(message: Column) -> Column:
    return revert_target(message).isNotNull() | reverted_subject(message).isNotNull()


def pulls_in_message(message: Column) -> Column:
    """The numbers that a message may name pulls with, in order, once each: "PR 7", "Fixes #12 (#34)"."""
    found = F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(PULL_IN_MESSAGE), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(found, lambda n: n.try_cast("int"))))


def node_key(kind: str, value: Column) -> Column:
    """Graph node ids: issue:#N, pr:#N, commit:<sha7>, symbol:<id>."""
    if kind == "commit":
        return F.concat(F.lit("commit:"), F.left(value, F.lit(7)))
    return F.concat(F.lit(f"{kind}:" if kind == "symbol" else f"{kind}:#"), value.cast("string"))


def code_tokens(text: Column) -> Column:
    """Lower-cased words; parts of snake_case and camelCase words follow their word."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def parts(w: Column) -> Column:
        snake = F.filter(F.split(F.lower(w), "_"), lambda p: p != "")
        marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2"), r"(\d+)", " $1 ")
        camel = F.filter(F.split(F.lower(F.translate(marked, "_", " ")), " +"), lambda p: p != "")
        own = F.array(F.lower(w))
        tail = F.substr(w, F.lit(2))  # letters have no parts if at most the first is a capital
        plain = (F.translate(w, "0123456789_", "") == w) & (F.lower(tail) == tail)
        out = F.when(F.contains(w, F.lit("_")), F.concat(own, snake)).otherwise(own)
        return F.when(plain, own).when(F.size(camel) > 1, F.concat(out, F.array_except(camel, out))).otherwise(out)

    return F.flatten(F.transform(words, parts))


def uuid5_url(key: Column) -> Column:
    """uuid5 in the URL namespace, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(key, "utf-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def token_count(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def truncate_tokens(text: Column, n: int) -> Column:
    return F.substring(text, 1, 4 * n)


def sanitize_query(q: Column) -> Column:
    """Without search qualifiers, git commands and flags, quotes and dashes that stand alone; an empty result gives the query back."""
    out = F.regexp_replace(F.regexp_replace(q, QUALIFIER, ""), FLAG, "")
    out = F.regexp_replace(F.translate(out, "\"'", "  "), LONE_DASHES, " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.transform(F.array(out), lambda o: F.when(o == "", q).otherwise(o))[0]  # made once


def lenient_timestamp(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.left(text, F.lit(10))))


def lenient_strings(text: Column) -> Column:
    """A JSON list of strings; malformed text is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def rename_target(path: Column) -> Column:
    """The new path of a numstat rename; quotes and leading slashes go."""
    path = F.translate(path, '"', "")
    brace = F.regexp_replace(F.regexp_replace(path, r"\{[^{}]*? => ([^{}]*)\}", "$1"), "//", "/")
    arrow = F.when(F.contains(brace, F.lit(" => ")), F.element_at(F.split(brace, " => "), -1)).otherwise(brace)
    return F.regexp_replace(F.trim(arrow), "^/+", "")
