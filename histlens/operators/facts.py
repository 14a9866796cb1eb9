"""Syntax facts of TypeScript and JavaScript text, by a tokenizer (D7; best effort).

A snapshot's file gives imports, functions, calls, bindings, accesses and
literals.  There is no parser behind it: brackets are matched, names before a
bracket are read backwards as chains, and types are taken for code.  Known gaps:
a regular expression after a closing parenthesis, JSX text, decorators with
arguments, overloads, and object-literal methods, which are no functions here.
Text whose brackets don't match gives no facts at all.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST_ARGUMENT, LONGEST_LITERAL = 200, 100
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<mark>=>|\?\.|\.\.\.|[^\s\w])""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
# Words that no chain starts with, and after which a slash starts a regular expression.
KEYWORDS = frozenset("if for while switch catch return function new typeof await async case in of else do try finally throw delete void yield class extends import export default const let var instanceof super".split())
PAIRS = {"(": ")", "[": "]", "{": "}"}

FACTS = """repo_id string, path string,
imports array<struct<specifier: string, bindings: array<struct<local: string, imported: string, kind: string>>, pos: int>>,
functions array<struct<name: string, start_line: int, end_line: int, exported: boolean>>,
calls array<struct<pos: int, chain: array<string>, line: int, fn: string, string_args: array<string>, arg_props: array<string>, number_args: array<double>>>,
bindings array<struct<name: string, kind: string, chain: array<string>, pos: int>>,
accesses array<struct<chain: array<string>, line: int, fn: string>>,
literals array<struct<value: string, line: int, fn: string, pos: int>>"""


@dataclass
class Token:
    kind: str
    text: str
    line: int
    mate: int = -1  # the other bracket


@dataclass
class Facts:
    imports: list = field(default_factory=list)
    functions: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    bindings: list = field(default_factory=list)
    accesses: list = field(default_factory=list)
    literals: list = field(default_factory=list)


def tokens(text: str) -> list[Token] | None:
    """Tokens with matched brackets; None if they don't match."""
    found: list[Token] = []
    breaks = [m.start() for m in re.finditer("\n", text)]
    at, open_at = 0, []
    while at < len(text):
        last = found[-1] if found else None
        value_before = last and (last.kind in ("text", "number") or last.kind == "name" and last.text not in KEYWORDS or last.text in (")", "]", "}"))
        m = None if value_before or text[at] != "/" else _REGEX.match(text, at)
        kind = "regex" if m else None
        m = m or _TOKEN.match(text, at)
        if m is None:
            return None
        kind = kind or m.lastgroup
        if kind != "skip":
            found.append(Token(kind, m[0], bisect_right(breaks, at) + 1))
            here = len(found) - 1
            if m[0] in PAIRS and kind == "mark":
                open_at.append(here)
            elif kind == "mark" and m[0] in PAIRS.values():
                if not open_at or PAIRS[found[open_at[-1]].text] != m[0]:
                    return None
                found[here].mate = open_at.pop()
                found[found[here].mate].mate = here
        at = m.end()
    return None if open_at else found


def _value(token: Token) -> str:
    return token.text[1:-1]


class Reader:
    def __init__(self, found: list[Token]) -> None:
        self.t, self.out, self.spans = found, Facts(), []
        self.owners: list[str | None] | None = None

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def chain_before(self, end: int) -> tuple[list[str], int]:
        """The chain whose last token is at `end`, and its first token; what can't be read becomes *."""
        parts: list[str] = []
        i = end
        while i >= 0:
            token = self.t[i]
            if token.kind == "name" and (self.text(i - 1) in (".", "?.") or token.text not in KEYWORDS):
                parts.append(token.text)
                if self.text(i - 1) in (".", "?."):
                    i -= 2
                    continue
                return parts[::-1], i
            if token.text == "]" and (self.is_name(token.mate - 1) or self.text(token.mate - 1) in (")", "]")):
                inner = self.t[token.mate + 1] if i - token.mate == 2 else None
                parts.append(_value(inner) if inner and inner.kind == "text" else "*")
                i = token.mate - 1
                continue
            parts.append("*")
            return parts[::-1], token.mate if token.mate >= 0 else i
        return parts[::-1], 0

    def function_spans(self) -> None:
        """(first token, last token, name) of function bodies, and their rows."""
        t = self.t
        for i, token in enumerate(t):
            if token.text != "{" or token.mate < i:
                continue
            name, first = self._function_name(i)
            if name:
                self.spans.append((first, token.mate, name))
                start = max(0, first - 1)
                exported = any(self.text(k) == "export" for k in range(max(0, first - 4), first + 1))
                self.out.functions.append({"name": name, "start_line": t[first].line, "end_line": t[token.mate].line, "exported": exported or self.text(start) == "export"})
        # Arrow functions without a block reach to the end of their expression.
        for i, token in enumerate(t):
            if token.text == "=>" and self.text(i + 1) != "{":
                first, name = self._arrow_head(i)
                end, depth = i + 1, 0
                while end < len(t) and not (depth == 0 and t[end].text in (",", ";", ")", "]", "}")):
                    if t[end].mate > end:
                        end = t[end].mate
                    end += 1
                self.spans.append((first, end - 1, name))
                self.out.functions.append({"name": name, "start_line": t[first].line, "end_line": t[min(end, len(t)) - 1].line, "exported": any(self.text(k) == "export" for k in range(max(0, first - 4), first))})

    def _arrow_head(self, arrow: int) -> tuple[int, str]:
        """First token of an arrow function's parameters and its name."""
        first = self.t[arrow - 1].mate if self.text(arrow - 1) == ")" else arrow - 1
        if self.text(first - 1) == "async":
            first -= 1
        if self.text(first - 1) == "=" and self.is_name(first - 2):
            return first, self.text(first - 2)
        return first, f"<anonymous:L{self.t[first].line}>"

    def _function_name(self, brace: int) -> tuple[str | None, int]:
        before = brace - 1
        if self.text(before) == "=>":
            first, name = self._arrow_head(before)
            return name, first
        # A return type between the parameters and the block.
        close = before
        for k in range(before, -1, -1):
            if self.text(k) == ")" or self.t[k].text in (";", "{", "}", "="):
                close = k
                break
        if self.text(close) != ")":
            return None, brace
        head = self.t[close].mate - 1
        if self.text(head) == "function":
            if self.text(head - 1) == "=" and self.is_name(head - 2):
                return self.text(head - 2), head
            return f"<anonymous:L{self.t[head].line}>", head
        if self.is_name(head) and self.text(head - 1) in ("function", "*"):
            return self.text(head), head - 1
        if self.is_name(head) and self.text(head) not in KEYWORDS:
            owner = self._class_of(head)
            if owner:
                return f"{owner}.{self.text(head)}", head
        return None, brace

    def _class_of(self, i: int) -> str | None:
        """The class in whose block, and not deeper, a token stands."""
        depth_start = i
        while depth_start >= 0:
            token = self.t[depth_start]
            if token.mate >= 0 and token.mate < depth_start:
                depth_start = token.mate
            elif token.text == "{":
                for k in range(depth_start - 1, -1, -1):
                    if self.text(k) == "class" and self.is_name(k + 1):
                        return self.text(k + 1)
                    if self.text(k) in (";", "}", ")"):
                        return None
                return None
            elif token.mate > depth_start:
                return None
            depth_start -= 1
        return None

    def owner(self, i: int) -> str | None:
        """The innermost function around a token."""
        if self.owners is None:
            self.owners = [None] * len(self.t)
            # Wider spans first, so that narrower ones are laid over them.
            for first, last, name in sorted(reversed(self.spans), key=lambda s: s[0] - s[1]):
                last = min(last, len(self.t) - 1)
                self.owners[first : last + 1] = [name] * (last + 1 - first)
        return self.owners[i]

    def _import_end(self, i: int) -> int | None:
        """The specifier of an import statement; braces are stepped over, and what can't be in its clause ends the search."""
        k = i + 1
        while k < len(self.t) and self.t[k].kind != "text":
            if self.text(k) == "{" and self.t[k].mate > k:
                k = self.t[k].mate
            elif not (self.is_name(k) or self.text(k) in (",", "*")):
                return None
            k += 1
        return k if k < len(self.t) else None

    def imports(self) -> set[int]:
        """Import rows; returns the tokens that belong to imports."""
        taken: set[int] = set()
        for i, token in enumerate(self.t):
            if token.text != "import" or token.kind != "name" or self.text(i + 1) in ("(", ".") or self.text(i - 1) == ".":
                continue
            end = self._import_end(i)
            if end is None:
                continue
            bindings, k = [], i + 1
            while k < end:
                if self.text(k) == "*" and self.text(k + 1) == "as":
                    bindings.append({"local": self.text(k + 2), "imported": "*", "kind": "namespace"})
                    k += 3
                elif self.text(k) == "{":
                    close, part = self.t[k].mate, k + 1
                    while part < close:
                        if self.text(part) == "type" and self.is_name(part + 1) and self.text(part + 1) != "as":
                            part += 1
                        if self.is_name(part):
                            renamed = self.text(part + 1) == "as"
                            bindings.append({"local": self.text(part + 2) if renamed else self.text(part), "imported": self.text(part), "kind": "named"})
                            part += 3 if renamed else 1
                        else:
                            part += 1
                    k = close + 1
                else:
                    if self.is_name(k) and self.text(k) not in ("from", "type"):
                        bindings.append({"local": self.text(k), "imported": "default", "kind": "default"})
                    k += 1
            self.out.imports.append({"specifier": _value(self.t[end]), "bindings": bindings, "pos": i})
            taken.update(range(i, end + 1))
        return taken

    def read(self) -> Facts:
        self.function_spans()
        taken = self.imports()
        chained: set[int] = set()
        for i, token in enumerate(self.t):
            if i in taken:
                continue
            if token.kind == "text" and len(_value(token)) <= LONGEST_LITERAL:
                self.out.literals.append({"value": _value(token), "line": token.line, "fn": self.owner(i), "pos": i})
            if token.text == "(" and token.mate > i and i and (self.is_name(i - 1) and (self.text(i - 1) not in KEYWORDS or self.text(i - 2) in (".", "?."))):
                self._call(i, chained)
        for i in range(len(self.t) - 1, -1, -1):
            if i not in taken and i not in chained and self.is_name(i) and self.text(i - 1) in (".", "?.") and self.text(i + 1) not in (".", "?.", "(", "["):
                chain, first = self.chain_before(i)
                if not chained & set(range(first, i + 1)):
                    self.out.accesses.append({"chain": chain, "line": self.t[first].line, "fn": self.owner(i)})
        self.out.accesses.reverse()
        self._bound(taken)
        return self.out

    def _call(self, at: int, chained: set[int]) -> None:
        chain, first = self.chain_before(at - 1)
        before = self.text(first - 1)
        if before in ("function", "class") or any(s[0] in (first, first - 1) and s[2].split(".")[-1] == chain[-1] and self.text(self.t[at].mate + 1) in ("{", ":") for s in self.spans):
            return  # a declaration
        chained.update(range(first, at))
        if before == "new":
            return
        strings, names, numbers = [], [], []
        k = at + 1
        while k < self.t[at].mate:
            token = self.t[k]
            if token.kind == "text":
                strings.append(_value(token)[:LONGEST_ARGUMENT])
            elif token.kind == "number":
                digits = re.match(r"\d+(\.\d+)?", token.text)
                numbers.append(float(digits[0]))
            elif token.text == "{" and self.text(k - 1) in ("(", ","):
                inner = k + 1
                while inner < token.mate:
                    if self.is_name(inner) and self.text(inner - 1) in ("{", ",") and self.text(inner + 1) in (":", ",", "}"):
                        names.append(self.text(inner))
                    inner = self.t[inner].mate if self.t[inner].mate > inner else inner + 1
            k = token.mate if token.mate > k else k + 1
        self.out.calls.append({"pos": at, "chain": chain, "line": self.t[first].line, "fn": self.owner(at), "string_args": strings, "arg_props": names, "number_args": numbers})

    def _bound(self, taken: set[int]) -> None:
        for i, token in enumerate(self.t):
            if token.text not in ("const", "let", "var") or i in taken or not self.is_name(i + 1):
                continue
            k = i + 2
            if self.text(k) == ":":
                while k < len(self.t) and self.t[k].text not in ("=", ";"):
                    k = self.t[k].mate + 1 if self.t[k].mate > k else k + 1
            if self.text(k) != "=":
                continue
            k += 1
            if self.text(k) == "await":
                k += 1
            made = self.text(k) == "new"
            k += made
            end = k
            while self.is_name(end) and self.text(end + 1) in (".", "?."):
                end += 2
            if self.is_name(end) and self.text(end) not in KEYWORDS:
                kind = "new" if made else "call" if self.text(end + 1) == "(" else "alias"
                self.out.bindings.append({"name": self.text(i + 1), "kind": kind, "chain": self.chain_before(end)[0], "pos": i})


def facts_of(text: str) -> Facts:
    found = tokens(text)
    return Facts() if found is None else Reader(found).read()


def extract(snapshot: DataFrame) -> DataFrame:
    """FACTS, one nested row for each file of snapshot(repo_id, path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [facts_of(c or "") for c in batch["content"]]
            yield pd.DataFrame({"repo_id": batch["repo_id"], "path": batch["path"]} | {name: [getattr(r, name) for r in rows] for name in ("imports", "functions", "calls", "bindings", "accesses", "literals")})

    return snapshot.select("repo_id", "path", "content").mapInPandas(read, FACTS)


def relation(facts: DataFrame, name: str) -> DataFrame:
    """One of the six nested lists as rows."""
    return facts.select("repo_id", "path", F.inline(name))
