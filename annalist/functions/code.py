"""Parsers that have no Spark form: diffs, symbols and code chunks as Python table functions, LCS and word overlap as pandas UDFs."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from annalist.functions import scanner

#: Definitions in text that is not of a known language, or is Python that does not parse.
DEFINITIONS = (
    ("class", re.compile(r"^\s*(?:(?:export|default|pub|public|private|protected|abstract|final)\s+)*(?:class|interface|struct|trait|enum|type)\s+([A-Za-z_]\w*)")),
    ("function", re.compile(r"^\s*(?:(?:export|default|pub|public|private|protected|static|async)\s+)*(?:function|func|fn|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(")),
)
NO_CODE = ("md", "json", "yml", "yaml", "txt", "rst", "toml", "lock")  # in which nothing is defined
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def unquoted(path: str) -> str:
    """A path as git prints it: in quotes, with C escapes and octal bytes, where it holds unusual characters."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    plain = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}

    def one(m) -> bytes:
        e = m[1].decode()
        return bytes([int(e, 8) if e[0].isdigit() else plain.get(e, ord(e[0]))])

    return re.sub(rb"\\([0-7]{1,3}|.)", one, path[1:-1].encode()).decode("utf-8", "replace")


def diff_lines(diff: str | None) -> list[tuple[str, str, int]]:
    """(path, side, line) of a unified diff: added lines by their new numbers, deleted ones by their old numbers."""

    def path_of(text: str) -> str | None:
        text = unquoted(text.split("\t")[0].strip())
        return None if text == "/dev/null" else text[2:] if text.startswith(("a/", "b/")) else text

    out, old_path, new_path, old, new, left_old, left_new = [], None, None, 0, 0, 0, 0
    for line in (diff or "").splitlines():
        if left_old > 0 or left_new > 0:
            if line.startswith("+"):
                if new_path or old_path:
                    out.append((new_path or old_path, "added", new))
                new, left_new = new + 1, left_new - 1
                continue
            if line.startswith("-"):
                if new_path or old_path:
                    out.append((old_path or new_path, "deleted", old))
                old, left_old = old + 1, left_old - 1
                continue
            if line.startswith(" ") or line == "":
                old, new, left_old, left_new = old + 1, new + 1, left_old - 1, left_new - 1
                continue
            if line.startswith("\\"):
                continue
            left_old = left_new = 0
        if line.startswith("--- "):
            old_path = path_of(line[4:])
        elif line.startswith("+++ "):
            new_path = path_of(line[4:])
        elif m := _HUNK.match(line):
            old, new = int(m[1]), int(m[3])
            left_old, left_new = int(m[2] or 1), int(m[4] or 1)
    return out


def python_symbols(code: str, path: str) -> list[tuple]:
    out = []
    stack = [(node, "") for node in reversed(ast.parse(code).body)]
    while stack:
        node, outer = stack.pop()
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            name = f"{outer}::{node.name}" if outer else node.name
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if outer else "function"
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append((f"{path}::{name}", node.name, kind, start, node.end_lineno))
            stack += [(child, name) for child in reversed(node.body)]
    return sorted(out, key=lambda s: (s[3], -s[4]))


def pattern_symbols(code: str, path: str) -> list[tuple]:
    """Definitions by pattern; scopes by braces, else by indent. A definition ends where its scope does."""
    lines = code.splitlines()
    out, open_scopes, depth = [], [], 0  # (index of the symbol, name, depth, indent)
    braces = any("{" in x for x in lines)
    for n, line in enumerate(lines, 1):
        text, indent = line.strip(), len(line) - len(line.lstrip())
        if not braces and text:
            while open_scopes and indent <= open_scopes[-1][3]:
                out[open_scopes.pop()[0]][4] = n - 1
        for kind, pattern in DEFINITIONS:
            if m := pattern.match(line):
                name = "::".join([*(s[1] for s in open_scopes), m[1]])
                out.append([f"{path}::{name}", m[1], "method" if open_scopes and kind != "class" else kind, n, None])
                open_scopes.append((len(out) - 1, m[1], depth, indent))
                break
        if braces:
            bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", line)
            depth += bare.count("{") - bare.count("}")
            while "}" in bare and open_scopes and depth <= open_scopes[-1][2]:
                out[open_scopes.pop()[0]][4] = n
    for i, *_ in open_scopes:
        out[i][4] = len(lines)
    return [tuple(s) for s in out]


def symbols_of(code: str | None, path: str) -> list[tuple]:
    """(symbol_id, name, kind, start_line, end_line): Python by its syntax tree, brace languages by the scanner, else by patterns."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if not code or suffix in NO_CODE:
        return []
    if suffix in scanner.LANGUAGES:
        return scanner.definitions(code, path, scanner.LANGUAGES[suffix])
    if path.endswith(".py"):
        try:
            return python_symbols(code, path)
        except (SyntaxError, ValueError, RecursionError):
            pass
    return pattern_symbols(code, path)


def code_chunks(code: str | None, path: str, class_tokens: int = 600, part_tokens: int = 500) -> list[tuple[str, str]]:
    """(symbol_id, text) of the top-level definitions of a Python file; a large class gives a header and its methods."""
    tokens = lambda t: -(-len(t) // 4)
    cut = lambda t, n: t[: 4 * n] if tokens(t) > n else t
    code = code or ""
    try:
        body = ast.parse(code).body
    except (SyntaxError, ValueError, RecursionError):
        body = []
    lines = code.splitlines()
    text_of = lambda node: "\n".join(lines[min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))]) - 1 : node.end_lineno])
    out = []
    for node in body:
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        text = text_of(node)
        if not isinstance(node, ast.ClassDef) or tokens(text) <= class_tokens:
            out.append((f"{path}::{node.name}", cut(text, part_tokens)))
            continue
        header, methods = [lines[node.lineno - 1]], []
        if (doc := ast.get_docstring(node)) is not None:
            header.append(doc)
        for child in node.body:
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                part = text_of(child)
                if child.name == "__init__":
                    header.append(cut(part, part_tokens if tokens(part) <= part_tokens else 400))
                elif tokens(part) < 20:
                    header.append(part)
                else:
                    methods.append((f"{path}::{node.name}::{child.name}", cut(part, part_tokens)))
            elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                header.append(text_of(child))
        out += [(f"{path}::{node.name}", cut("\n".join(header), part_tokens)), *methods]
    return out or ([(path, code[:1500])] if code.strip() else [])


@F.udtf(returnType="path string, side string, line_no int")
class DiffLines:
    def eval(self, diff: str):
        yield from diff_lines(diff)


@F.udtf(returnType="symbol_id string, symbol_name string, kind string, start_line int, end_line int")
class Symbols:
    def eval(self, code: str, path: str):
        yield from symbols_of(code, path)


@F.udtf(returnType="symbol_id string, text string")
class CodeChunks:
    def eval(self, code: str, path: str):
        yield from code_chunks(code, path)


def _applied(rows, keys: list[str], given: list[str], table_function, schema: str):
    """The ``keys`` of ``rows`` with the rows (``schema``) that a Python function makes of the columns ``given``, by Arrow batches."""
    import pyarrow as pa

    own = rows.select(*keys, *given)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[: len(keys)])
    made = [tuple(c.split()) for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            found = [table_function(*x) for x in zip(*(c.to_pylist() for c in batch.columns[len(keys) :]))]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            columns = list(zip(*(row for f in found for row in f))) or [()] * len(made)
            columns = [pa.array(c, pa.int32() if kind == "int" else pa.string()) for c, (_, kind) in zip(columns, made)]
            yield pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns[: len(keys)]] + columns, names=[*keys, *(n for n, _ in made)])

    return own.mapInArrow(run, f"{kept}, {schema}")


def with_lines(diffs, keys: list[str]):
    """(keys, path, side, line_no) of ``diffs`` (keys, diff)."""
    return _applied(diffs, keys, ["diff"], diff_lines, "path string, side string, line_no int")


def with_symbols(files, keys: list[str] | None = None):
    """(repo_id, file_path, symbol_id, symbol_name, kind, start_line, end_line) of ``files`` (repo_id, file_path, text), or with other ``keys``."""
    rows = files.withColumns({"_text": F.col("text"), "_path": F.col("file_path")})
    return _applied(rows, keys or ["repo_id", "file_path"], ["_text", "_path"], symbols_of, "symbol_id string, symbol_name string, kind string, start_line int, end_line int")


def with_chunks(files):
    """(repo_id, file_path, symbol_id, text): the definitions of the Python files among ``files``."""
    rows = files.withColumns({"_text": F.col("text"), "_path": F.col("file_path")})
    return _applied(rows, ["repo_id", "file_path"], ["_text", "_path"], code_chunks, "symbol_id string, text string")


def register(spark) -> None:
    """Name the table functions for SQL: diff_lines(diff), code_symbols(code, path), code_chunks(code, path)."""
    for name, f in (("diff_lines", DiffLines), ("code_symbols", Symbols), ("code_chunks", CodeChunks)):
        spark.udtf.register(name, f)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: one addition over len(b) bits a word of ``a``."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole  # a zero bit is a column where the row's lengths rise
    for x in a:
        if hit := row & places.get(x, 0):
            row = (row + hit | row - hit) & whole
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of lower-cased words."""

    def one(c, r):
        c, r = re.findall(r"\w+", (c or "").lower()), re.findall(r"\w+", (r or "").lower())
        n = lcs_length(c, r) if c and r else 0
        return 2 * n / (len(c) + len(r)) if n else 0.0

    return pd.Series([one(c, r) for c, r in zip(candidate, reference)])


@F.pandas_udf(DoubleType())
def word_overlap(answer: pd.Series, expected: pd.Series) -> pd.Series:
    """min(1, hits / (0.4 x words)) over the lower-cased words of ``expected`` of four ASCII word characters or more."""

    def one(a, e):
        a, words = (a or "").lower(), set(re.findall(r"\w{4,}", (e or "").lower(), re.A))
        return min(1.0, sum(w in a for w in words) / (0.4 * len(words))) if words else 0.0

    return pd.Series([one(a, e) for a, e in zip(answer, expected)])
