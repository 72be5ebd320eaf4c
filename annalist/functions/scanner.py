"""Definitions in the text of a brace language: a lexer that knows strings and comments, then scopes over its tokens.

``blanked`` is a state machine over the text: what is in comments, strings, templates, characters and regular expressions
becomes spaces, line breaks stay. ``definitions`` walks the tokens of what is left with a stack of braces; a definition
begins at its keyword (or, within a class, at a name with parameters and a body) and ends where its scope does.
"""

from __future__ import annotations

import re

LANGUAGES = {
    **dict.fromkeys(("js", "jsx", "mjs", "cjs", "ts", "tsx"), "js"), "go": "go", "rs": "rust",
    **dict.fromkeys(("java", "kt", "cs", "c", "h", "cc", "cpp", "hpp", "scala", "swift", "php"), "java"),
}
FAR = 60  # tokens within which a bracket of types, or a type, is to end; so that the time stays linear in hostile texts
DEEP = 20  # scopes that a name is qualified by
CLASSES = {"class", "struct", "interface", "trait", "enum", "record", "union"}
MODIFIERS = {"public", "private", "protected", "static", "final", "native", "synchronized", "abstract", "async", "override", "readonly", "get", "set", "virtual", "internal"}
NO_NAMES = {
    "if", "for", "while", "switch", "catch", "return", "function", "new", "do", "else", "try", "throw", "super", "this", "await", "typeof", "in", "case", "with",
    "synchronized", "yield", "delete", "void", "extends", "implements", "where", "sizeof", "foreach", "using", "lock", "assert",
}
_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|=>|::|->|\n|[^\s\w]")
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[+*%<>~^-]|=>|\b(?:return|typeof|case|in|of|void|delete|throw|else|do))\s*$")
_STOPS = {lang: re.compile(stops) for lang, stops in (("js", r"//|/\*|[\"'`/{}]"), ("go", r"//|/\*|[\"'`]"), ("java", r"//|/\*|\"\"\"|[\"']"), ("rust", r"//|/\*|\bb?r#*\"|[\"']"))}
_ENDS = {'"': re.compile(r"(?:\\.|[^\"\\\n])*\"?", re.S), "'": re.compile(r"(?:\\.|[^'\\\n])*'?", re.S)}
_RUST_STRING = re.compile(r"(?:\\.|[^\"\\])*\"?", re.S)
_REGEX = re.compile(r"(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_RUST_CHAR = re.compile(r"'(?:\\(?:u\{[0-9a-fA-F_]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'")


def _comment_end(code: str, at: int, nested: bool) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(code, at):
        depth += 1 if m[0] == "/*" else -1
        if m[0] == "/*" and not nested:
            depth = 1
        if depth == 0:
            return m.end()
    return len(code)


def blanked(code: str, language: str) -> str:
    """``code`` of the same length and lines, with spaces for what is no code."""
    out, at, held = [], 0, []  # held: for each open template, how many braces are open in its current expression
    stops, n = _STOPS[language], len(code)

    def hide(end: int) -> None:
        nonlocal at
        out.append(re.sub(r"[^\n]", " ", code[at:end]))
        at = end

    def template() -> None:
        """From behind a backtick, or behind the brace that ends an expression in one."""
        end = at
        while end < n and code[end] != "`" and not code.startswith("${", end):
            end += 2 if code[end] == "\\" else 1
        opens = code.startswith("${", end)
        hide(min(end + (2 if opens else 1), n))
        if opens:
            held.append(0)

    while m := stops.search(code, at):
        out.append(code[at : m.start()])
        at, mark = m.start(), m[0]
        if mark == "//":
            end = code.find("\n", at)
            hide(n if end < 0 else end)
        elif mark == "/*":
            hide(_comment_end(code, at, language == "rust"))
        elif mark == '"""' or mark == "`" and language == "go":
            end = code.find(mark, at + len(mark))
            hide(n if end < 0 else end + len(mark))
        elif mark == "`":
            hide(at + 1)
            template()
        elif mark in "{}":  # of js, where it may end an expression in a template
            if held and mark == "}" and held[-1] == 0:
                held.pop()
                hide(at + 1)
                template()
                continue
            if held:
                held[-1] += 1 if mark == "{" else -1
            out.append(mark)
            at += 1
        elif mark == "/":
            found = _REGEX.match(code, at + 1) if _BEFORE_REGEX.search("".join(out[-3:])[-40:]) else None
            if found:
                hide(found.end())
            else:
                out.append(mark)
                at += 1
        elif language == "rust" and mark == "'":
            found = _RUST_CHAR.match(code, at)
            hide(found.end() if found else at + 1)  # else a lifetime
        elif language == "rust" and "r" in mark:
            close = '"' + "#" * mark.count("#")
            end = code.find(close, m.end())
            hide(n if end < 0 else end + len(close))
        else:
            hide((_RUST_STRING if language == "rust" else _ENDS[mark]).match(code, at + 1).end())
    out.append(code[at:])
    return "".join(out)


class _Walk:
    """The tokens of a file, and the definitions that a pass over them finds."""

    def __init__(self, code: str, path: str, language: str):
        self.path, self.language, self.tokens, line = path, language, [], 1
        for m in _WORD.finditer(blanked(code, language)):
            if m[0] == "\n":
                line += 1
            self.tokens.append((m[0], line - (m[0] == "\n")))
        self.lines, self.found, self.scopes, self.parens, self.pending = max(line, 1), [], [], 0, None
        self.closes, opened = {}, []  # round brackets by the place of the one that opens
        for i, (t, _) in enumerate(self.tokens):
            if t == "(":
                opened.append(i)
            elif t == ")" and opened:
                self.closes[opened.pop()] = i

    def text(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def after(self, i: int, step: int = 1) -> int:
        """The place of the next (or last) token that is no line break."""
        i += step
        while self.text(i) == "\n":
            i += step
        return i

    def named(self, i: int) -> bool:
        t = self.text(i)
        return bool(t) and (t[0].isalpha() or t[0] in "_$") and t not in NO_NAMES

    def matching(self, i: int) -> int:
        """The place of the bracket that closes the round one at ``i``; behind the last token where none does."""
        return self.closes.get(i, len(self.tokens))

    def balanced(self, i: int, opens: str, closes: str) -> int:
        """The place behind the bracket that closes the one at ``i``, within FAR tokens; else that behind ``i``."""
        depth = 0
        for j in range(i, min(i + FAR, len(self.tokens))):
            depth += (self.text(j) == opens) - (self.text(j) == closes)
            if depth == 0:
                return j + 1
        return i + 1

    def angles(self, i: int) -> int:
        return self.balanced(i, "<", ">")

    def statement_end(self, i: int) -> int:
        """The line where the statement at ``i`` ends: at a semicolon, or a line break that nothing is open over."""
        depth, last = 0, self.tokens[i][1]
        for i in range(i, min(i + 10 * FAR, len(self.tokens))):
            t, line = self.tokens[i]
            depth += (t in "([{") - (t in ")]}")
            if depth < 0 or depth == 0 and t == ";":
                return last if depth < 0 else line
            if t == "\n" and depth == 0:
                before, behind = self.text(self.after(i, -1)), self.text(self.after(i))
                if before not in ("=", "|", "&", "=>", ",", "(", "+", ":", "?", ".") and behind not in ("|", "&", ".", "?", ":", "+", "=>", "="):
                    return line
            elif t != "\n":
                last = line
        return last

    def add(self, name: str, kind: str, line: int, end: int | None = None, outer: str | None = None, open_: bool = True) -> None:
        names = [outer] if outer else [s[0] for s in self.scopes[-DEEP:] if s[0]]
        if kind != "class":
            kind = "method" if names else "function"
        if self.pending is not None and self.found[self.pending[1]][4] is None:
            self.found[self.pending[1]][4] = self.found[self.pending[1]][3]
        self.pending = None
        self.found.append([f"{self.path}::{'::'.join([*names, name])}", name, kind, line, end])
        if open_ and end is None:
            self.pending = (name, len(self.found) - 1, self.parens)

    def in_class(self) -> bool:
        return bool(self.scopes) and self.scopes[-1][2] and self.parens == self.scopes[-1][3]

    def start_of(self, i: int) -> int:
        """The line where the modifiers before ``i`` begin."""
        line, j = self.tokens[i][1], self.after(i, -1)
        for _ in range(DEEP):
            if self.text(j) not in MODIFIERS and self.text(j) not in ("export", "default", "pub", "unsafe", "const", "extern", "sealed"):
                break
            line, j = self.tokens[j][1], self.after(j, -1)
        return line

    def run(self) -> list[tuple]:
        i = 0
        while i < len(self.tokens):
            i = self.step(i)
        for _, symbol, *_ in self.scopes:  # what is open at the end of the text
            if symbol is not None:
                symbol[4] = self.lines
        for f in self.found:
            f[4] = f[4] or f[3]
        return [tuple(f) for f in self.found]

    def step(self, i: int) -> int:
        t, line = self.tokens[i]
        if t == "{":
            self.open(i)
        elif t == "}":
            if self.scopes:
                _, symbol, _, self.parens = self.scopes.pop()
                if symbol is not None:
                    symbol[4] = line
        elif t in "([":
            self.parens += 1
        elif t in ")]":
            self.parens = max(self.parens - 1, 0)
        elif t == ";" or t == "\n" and self.language == "go":
            if self.pending is not None and self.parens == self.pending[2]:
                self.found[self.pending[1]][4] = line
                self.pending = None
        elif self.text(i - 1) != ".":
            return self.declaration(i)
        return i + 1

    def open(self, i: int) -> None:
        before = self.text(self.after(i, -1))
        if self.pending is not None and self.parens == self.pending[2]:
            name, number, _ = self.pending
            symbol = self.found[number]
            literal = symbol[2] != "class" and (before in (":", "|", "&") if self.language == "js" else before in ("interface", "struct") and self.language == "go")
            if not literal:
                self.scopes.append((name, symbol, symbol[2] == "class", self.parens))
                self.pending = None
                return
        self.scopes.append((None, None, False, self.parens))

    def declaration(self, i: int) -> int:
        t, line, nxt = self.text(i), self.start_of(i), self.after(i)
        name = self.text(nxt)
        if t in CLASSES and self.named(nxt) and self.text(self.after(i, -1)) not in ("type", ":") and name not in ("extends", "implements"):
            if t == "enum" and name in ("class", "struct"):
                nxt = self.after(nxt)
                name = self.text(nxt)
            self.add(name, "class", line)
            return nxt + 1
        if t == "type" and self.language in ("go", "js", "rust"):
            if self.named(nxt) and self.text(self.after(nxt)) not in (",", ")", ":", ".", "}"):
                self.type_(nxt, line)
                return nxt + 1
            if self.language == "go" and name == "(":
                return self.type_group(nxt)
        if t == "impl" and self.language == "rust":
            return self.impl(i)
        if t in ("function", "fn", "func", "def") and not (self.language == "go" and (self.scopes or self.parens)):
            return self.function(i, line)
        if t in ("const", "let", "var") and self.language == "js" and self.named(nxt):
            return self.arrow(nxt, line)
        if self.named(i) and self.language in ("js", "java"):
            return self.method(i)
        return i + 1

    def type_(self, at: int, line: int) -> None:
        j = self.after(at)
        if self.text(j) == "[" and self.language == "go":  # parameters of the type
            j = self.after(self.balanced(j, "[", "]") - 1)
        if self.language == "go" and self.text(j) in ("struct", "interface"):
            self.add(self.text(at), "class", line)
        elif self.language != "rust" or not self.scopes or self.scopes[-1][0] is None:  # associated types are no definitions
            self.add(self.text(at), "class", line, self.statement_end(at))

    def type_group(self, at: int) -> int:
        """Of Go: type ( A struct {...}; B int )."""
        end, depth, fresh = self.matching(at), 0, True
        for j in range(at + 1, min(end, len(self.tokens))):
            t = self.text(j)
            if fresh and depth == 0 and self.named(j):
                self.add(t, "class", self.tokens[j][1], self.statement_end(j))
            fresh = t == "\n" or fresh and t == ";"
            depth += (t in "([{") - (t in ")]}")
        return end + 1

    def impl(self, i: int) -> int:
        """Of Rust: the methods of an impl are its type's."""
        j = i + 1
        if self.text(j) == "<":
            j = self.angles(j)
        name = None
        while j < len(self.tokens) and self.text(j) not in ("{", ";", "where"):
            if self.text(j) == "for":
                name = None
            elif self.named(j) and (name is None or self.text(j - 1) == "::"):
                name = self.text(j)
            if self.text(j) == "<":
                j = self.angles(j)
            else:
                j += 1
        while j < len(self.tokens) and self.text(j) not in ("{", ";"):
            j += 1
        if self.text(j) == "{":
            self.scopes.append((name, None, True, self.parens))
        return j + 1

    def function(self, i: int, line: int) -> int:
        j, outer = self.after(i), None
        if self.text(j) == "*":
            j = self.after(j)
        if self.text(i) == "func" and self.text(j) == "(":  # the receiver: the last name outside brackets
            end = self.matching(j)
            inner = [self.text(k) for k in range(j + 1, end)]
            inner = inner[: inner.index("[")] if "[" in inner else inner
            names = [t for t in inner if t[0].isalpha() or t[0] == "_"]
            outer, j = (names[-1] if names else None), self.after(end)
        if not self.named(j):
            return j
        self.add(self.text(j), "function", line, outer=outer)
        return j + 1

    def arrow(self, at: int, line: int) -> int:
        """const name = (a, b) => ..., or = function ...; anything else is no definition."""
        j = self.after(at)
        if self.text(j) == ":":  # a type, up to the equals sign
            end = min(j + FAR, len(self.tokens))
            while j < end and self.text(j) not in ("=", ";"):
                j += 1
        if self.text(j) == "=" and self.is_function(self.after(j)):
            self.body(at, line, self.after(j))
        return at + 1

    def is_function(self, j: int) -> bool:
        j = self.after(j) if self.text(j) == "async" else j
        if self.text(j) == "function":
            return True
        if self.text(j) == "<":
            j = self.angles(j)
        if self.text(j) == "(":
            j = self.after(self.matching(j))
            if self.text(j) == ":":
                end = min(j + FAR, len(self.tokens))
                while j < end and self.text(j) not in ("=>", ";", "\n"):
                    j += 1
            return self.text(j) == "=>"
        return self.named(j) and self.text(self.after(j)) == "=>"

    def body(self, at: int, line: int, value: int) -> None:
        j = value
        end = min(j + FAR, len(self.tokens))
        while j < end and self.text(j) not in ("=>", "function"):
            j = self.matching(j) + 1 if self.text(j) == "(" else j + 1
        braces = self.text(j) == "function" or self.text(self.after(j)) == "{"
        self.add(self.text(at), "function", line, None if braces else self.statement_end(value))

    def method(self, i: int) -> int:
        """Within a class, a name with parameters and a body, or modifiers before it; elsewhere only behind modifiers or a type."""
        j = self.after(i)
        if self.text(j) in ("?", "!"):
            j = self.after(j)
        if self.text(j) == "<":
            k = self.angles(j)
            j = k if self.text(k) == "(" else j
        before = self.text(self.after(i, -1))
        if self.text(j) == "=" and self.in_class() and self.language == "js" and self.is_function(self.after(j)):
            self.body(i, self.start_of(i), self.after(j))
            return i + 1
        if self.text(j) != "(" or before in ("new", ".", "@", "return", "=", "(", ",", "function", "case", "throw", "await", "=>", "::", "->"):
            return i + 1
        k = self.after(self.matching(j))
        for _ in range(FAR):  # what is between the parameters and the body: a type, what is thrown
            if self.text(k) in ("{", ";", "}", "=", "=>", "(", ")", ""):
                break
            nxt = self.after(k)
            if self.text(k) in (":", "|", "&") and self.text(nxt) == "{":
                nxt = self.after(self.balanced(nxt, "{", "}") - 1)
            if self.text(k + 1) == "\n" and self.text(k) not in (":", "|", "&", ",", "throws", "->") and self.text(nxt) not in ("{", "throws", "|", "&", ","):
                break
            k = nxt
        has_body = self.text(k) == "{"
        modified = before in MODIFIERS or self.modified(i)
        typed = self.language == "java" and (before in ("*", ">", "]", "&") or self.named(self.after(i, -1)))
        if self.in_class() and (has_body or modified) or not self.in_class() and self.parens == 0 and has_body and (modified or typed and not self.scopes):
            self.add(self.text(i), "function", self.start_of(i))
        return i + 1

    def modified(self, i: int) -> bool:
        """Whether modifiers stand before the type of the name at ``i``, in its statement."""
        j = self.after(i, -1)
        for _ in range(FAR):
            if j < 0 or self.text(j) in (";", "{", "}", ")", "=", "("):
                break
            if self.text(j) in MODIFIERS:
                return True
            j = self.after(j, -1)
        return False


def definitions(code: str, path: str, language: str) -> list[tuple]:
    """(symbol_id, name, kind, start_line, end_line) in order of their starts; kind is class, function or method."""
    return _Walk(code, path, language).run()
