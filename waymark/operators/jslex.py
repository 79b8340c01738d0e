"""A linear scanner for script sources: constants, call sites with parameters, string literals.

Tokens are read once from left to right with a stack of open brackets and
template literals; a table of matching brackets then lets arguments and options
be split without looking at their inside again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# What the passes look for.
URL_NAMES = ("url", "api", "base", "endpoint", "host", "origin", "server")
CLIENTS = ("axios", "$http", "http", "api", "client", "request")
JQUERY_CALLS = ("ajax", "get", "post", "getJSON")
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
WITH_BODY = ("POST", "PUT", "PATCH")
URL_LITERAL = re.compile(r"(?:https?://[^\s'\"]+|/(?:api|v\d+|graphql|auth|admin|internal|ws)[/\w\-.{}:]*)\Z", re.ASCII)

_TOKEN = re.compile(r"""
    (?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
  | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<name>[A-Za-z_$\u0080-\U0010ffff][A-Za-z0-9_$\u0080-\U0010ffff]*)
  | (?P<number>[0-9][0-9A-Za-z_.]*)
  | (?P<sign>\|\||&&|\?\?|=>|[=!]==?|.)
""", re.VERBOSE | re.DOTALL)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"[^`\\$]+|\\.|`|\$\{|\$", re.DOTALL)
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "yield", "await"}
_STATEMENT = {"const", "let", "var", "function", "return", "if", "for", "while", "class", "import", "export", "throw", "try", "switch"}
_JOINS = {"+", "||", "??", "&&"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_ESCAPE = re.compile(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})")
_SLOT = re.compile(r"\$\{(\w+)\}")


@dataclass
class Token:
    kind: str
    start: int
    end: int
    text: str
    #: Number of the token after the matching bracket or the end of the template; else the next one.
    after: int


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)), text) if "\\" in text else text


def tokens(source: str) -> list[Token]:
    """Tokens without blanks and comments. Tokens inside a template's slots follow the template's own token."""
    out: list[Token] = []
    stack: list[tuple[str, int]] = []  # expected closing sign ("`" for a template) and number of the opening token
    at, size = 0, len(source)

    def template() -> None:
        """Reads on inside the innermost template, up to its end or its next slot."""
        nonlocal at
        while at < size:
            found = _TEMPLATE.match(source, at)
            at = found.end() if found else size
            if found and found.group() == "`":
                opened = out[stack.pop()[1]]
                opened.end, opened.after, opened.text = at, len(out), source[opened.start:at]
                return
            if found and found.group() == "${":
                stack.append(("${", len(out)))
                return

    while at < size:
        if source[at] == "`":
            stack.append(("`", len(out)))
            out.append(Token("template", at, size, source[at:at + 1], 0))
            at += 1
            template()
            continue
        if source[at] == "/" and (not out or out[-1].text in _BEFORE_REGEX or (out[-1].kind == "sign" and out[-1].text not in _CLOSE)):
            literal = _REGEX.match(source, at)
            if literal and not source.startswith(("//", "/*"), at):
                out.append(Token("regex", at, literal.end(), literal.group(), len(out) + 1))
                at = literal.end()
                continue
        found = _TOKEN.match(source, at)
        kind, text, start = found.lastgroup, found.group(), at
        at = found.end()
        if kind == "blank":
            continue
        if kind == "sign" and text == "}" and stack and stack[-1][0] == "${":
            stack.pop()
            template()
            continue
        out.append(Token(kind, start, at, text, len(out) + 1))
        if kind == "sign" and text in _OPEN:
            stack.append((_OPEN[text], len(out) - 1))
        elif kind == "sign" and text in _CLOSE and stack and stack[-1][0] == text:
            out[stack.pop()[1]].after = len(out)
    for _, number in stack:  # never closed: no call is read from there
        if number < len(out):
            out[number].after = len(out)
    return out


class Scan:
    """What one source holds. ``calls`` are (url, method, client, line, parameters as (name, place))."""

    def __init__(self, source: str):
        self.source, self.tokens = source, tokens(source)
        self.constants = self._constants()
        self._lines = [m.start() for m in re.finditer("\n", source)]
        self.calls = [c for i in range(len(self.tokens)) if (c := self._call(i)) and c[0]]

    def line(self, place: int) -> int:
        from bisect import bisect_left

        return bisect_left(self._lines, place) + 1

    def literals(self) -> list[tuple[str, int]]:
        """(text, line) of strings and templates that look like URLs or API paths, each once."""
        found: dict[str, int] = {}
        for t in self.tokens:
            if t.kind in ("string", "template") and URL_LITERAL.match(value := self._value(t)):
                found.setdefault(value, t.start)
        return [(value, self.line(start)) for value, start in found.items()]

    def _value(self, t: Token) -> str:
        if t.kind == "string":
            return unescape(t.text[1:-1])
        return unescape(_SLOT.sub(r"{\1}", t.text.strip("`"))) if t.kind == "template" else t.text

    def _is(self, i: int, text: str) -> bool:
        return i < len(self.tokens) and self.tokens[i].kind == "sign" and self.tokens[i].text == text

    def _constants(self) -> dict[str, str]:
        """Declared names that hold a URL; the last one of a name counts."""
        out, i = {}, 0
        while i < len(self.tokens):
            t = self.tokens[i]
            i += 1
            if t.kind != "name" or t.text not in ("const", "let", "var"):
                continue
            while i + 2 < len(self.tokens) and self.tokens[i].kind == "name":
                name, j = self.tokens[i], i + 1
                if self._is(j, "="):
                    value = self.tokens[j + 1]
                    alone = value.after >= len(self.tokens) or self.tokens[value.after].kind != "sign" or self.tokens[value.after].text in (",", ";", "}", ")", "]")
                    if value.kind in ("string", "template") and alone and any(k in name.text.lower() for k in URL_NAMES):
                        text = self._value(value)
                        if text.startswith(("http", "/")):
                            out[name.text] = text
                    j += 1
                # on to the next declarator
                while j < len(self.tokens) and not self._is(j, ",") and not self._is(j, ";") and self.tokens[j].text not in _CLOSE and self.tokens[j].text not in _STATEMENT:
                    j = max(self.tokens[j].after, j + 1) if self.tokens[j].text not in _OPEN or self.tokens[j].text == "(" or self.tokens[j].text == "[" else j + 1
                if not self._is(j, ","):
                    break
                i = j + 1
        return out

    def _split(self, start: int, end: int, sign: str = ",") -> list[tuple[int, int]]:
        """Ranges between top-level signs of tokens[start:end], without empty ones."""
        out, first, i = [], start, start
        while i < end:
            if self._is(i, sign):
                out.append((first, i))
                first = i + 1
            i = max(self.tokens[i].after, i + 1)
        return [r for r in [*out, (first, end)] if r[0] < r[1]]

    def _url(self, start: int, end: int) -> str:
        """Text of an argument: strings, templates, known constants, and those joined by operators."""
        parts, i, expect = [], start, True
        while i < end:
            t = self.tokens[i]
            after = max(t.after, i + 1)
            if expect:
                lone = after == end or (after < end and self.tokens[after].kind == "sign" and self.tokens[after].text in _JOINS)
                if t.kind in ("string", "template") and lone:
                    parts.append(self._value(t))
                elif t.kind == "name" and lone:
                    parts.append(self.constants.get(t.text, ""))
                else:  # something else up to the next operator
                    while after < end and not (self.tokens[after].kind == "sign" and self.tokens[after].text in _JOINS):
                        if self.tokens[after].text in ("?", "=>", "="):
                            return ""
                        after = max(self.tokens[after].after, after + 1)
                    if after == end and not parts and i == start:
                        return ""
            elif not (t.kind == "sign" and t.text in _JOINS):
                return ""
            expect, i = not expect, after
        known = [p for p in parts if p]
        url = known[0] if known else ""
        for more in known[1:]:
            url = url.rstrip("/") + "/" + more.lstrip("/")
        return url

    def _object(self, start: int, end: int) -> list[tuple[str, int, int]] | None:
        """(key, value range) of an object literal that fills tokens[start:end]."""
        if not self._is(start, "{") or self.tokens[start].after != end:
            return None
        pairs = []
        for a, b in self._split(start + 1, end - 1):
            colon = max(self.tokens[a].after, a + 1)
            if colon < b - 1 and self._is(colon, ":"):
                key = self.source[self.tokens[a].start:self.tokens[colon - 1].end].strip("'\"` ")
                pairs.append((key, colon + 1, b))
        return pairs

    def _text(self, start: int, end: int) -> str:
        """A string's content, or the source text of anything else."""
        t = self.tokens[start]
        return self._value(t) if end == max(t.after, start + 1) and t.kind in ("string", "template") else self.source[t.start:self.tokens[end - 1].end]

    def _names(self, start: int, end: int, place: str) -> list[tuple[str, str]]:
        return [(key, place) for key, _, _ in self._object(start, end) or [] if key]

    def _call(self, i: int) -> tuple | None:
        """The call whose callee begins at token ``i``."""
        t = self.tokens
        if t[i].kind != "name":
            return None
        inner = i > 0 and self._is(i - 1, ".")
        if t[i].text == "fetch" and not inner and self._is(i + 1, "("):
            return self._fetch(i, self._arguments(i + 1))
        if self._is(i + 1, ".") and i + 3 < len(t) and t[i + 2].kind == "name" and self._is(i + 3, "("):
            args, method, found = self._arguments(i + 3), t[i + 2].text, None
            if not inner and t[i].text in CLIENTS:
                found = self._client(i, method, args)
            elif not inner and t[i].text == "$" and method in JQUERY_CALLS:
                found = self._jquery(i, method, args)
            return found or self._open(i, method, args)
        if t[i].text == "open" and inner and self._is(i + 1, "(") and not (i > 1 and t[i - 2].kind == "name"):
            return self._open(i, "open", self._arguments(i + 1))  # on a call or an index
        return None

    def _arguments(self, bracket: int) -> list[tuple[int, int]]:
        after = self.tokens[bracket].after
        return self._split(bracket + 1, after - 1) if self._is(after - 1, ")") else []

    def _fetch(self, i: int, args) -> tuple | None:
        if not args:
            return None
        method, found = "GET", []
        for key, a, b in (self._object(*args[1]) or []) if len(args) > 1 else []:
            if key == "method":
                method = self._text(a, b).upper() or "GET"
            elif key == "body":
                found += self._names(a, b, "body")
            elif key == "headers":
                found += self._names(a, b, "header")
        return self._url(*args[0]), method, "fetch", self.line(self.tokens[i].start), found

    def _client(self, i: int, name: str, args) -> tuple | None:
        url = self._url(*args[0]) if args else ""
        if not url:
            return None
        method = name.upper() if name.lower() in VERBS else "GET"
        body = self._names(*args[1], "body") if len(args) > 1 and method in WITH_BODY else []
        return url, method, "axios", self.line(self.tokens[i].start), body

    def _jquery(self, i: int, name: str, args) -> tuple | None:
        options = self._object(*args[0]) if args and name == "ajax" else None
        if options is not None:
            url, method, body = "", "GET", []
            for key, a, b in options:
                if key == "url":
                    url = self._url(a, b)
                elif key in ("method", "type"):
                    method = self._text(a, b).upper() or "GET"
                elif key == "data":
                    body = self._names(a, b, "body")
        else:
            url, method = self._url(*args[0]) if args else "", "POST" if name == "post" else "GET"
            body = self._names(*args[1], "body") if len(args) > 1 else []
        return (url, method, "jquery", self.line(self.tokens[i].start), body) if url else None

    def _open(self, i: int, name: str, args) -> tuple | None:
        if name != "open" or len(args) < 2:
            return None
        method, url = self._text(*args[0]).upper(), self._url(*args[1])
        return (url, method, "xhr", self.line(self.tokens[i].start), []) if url and method else None
