"""Tokens of source code.

One pattern a family of languages cuts a text into comments, strings, words, line
breaks and signs.  What is left of a text is its *plain code*: all tokens but comments,
with one space after each, ``'`` for every string, and line breaks where the family
reads them.  Statements are then patterns over plain code, however they are laid out,
and nothing inside a comment or a string can look like one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

_QUOTED = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
_LONG = r'"""(?:[^\\]|\\.)*?"""' + r"|'''(?:[^\\]|\\.)*?'''"
_SLASHED = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
#: Comment, string and word of each family.
LANGUAGES = {
    "script": (_SLASHED, _QUOTED + r"|`(?:[^`\\]|\\.)*`", r"[\w$]+"),
    "python": (r"\#[^\n]*", _LONG + "|" + _QUOTED, r"\w+"),
    "go": (_SLASHED, r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|' + r"'(?:[^'\\\n]|\\.)*'", r"\w+"),
    "rust": (_SLASHED, r'r(?P<hashes>\#*)".*?"(?P=hashes)|"(?:[^"\\]|\\.)*"|' + r"'(?:\\[^\n']{1,10}|[^\\\n'])'", r"\w+"),
    "java": (_SLASHED, r'"""(?:[^\\]|\\.)*?"""|' + _QUOTED, r"\w+"),
    "csharp": (_SLASHED, r'\$?@\$?"(?:[^"]|"")*"|' + _QUOTED, r"\w+"),
    "c": (_SLASHED, _QUOTED, r"\w+"),
    "ruby": (r"\#[^\n]*|^=begin\b.*?(?:^=end\b[^\n]*|\Z)", _QUOTED, r"\w+[!?]?"),
    "php": (_SLASHED + r"|\#(?!\[)[^\n]*", r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'", r"[\w\\]+"),
}
#: Families whose statements end with their line (inside brackets lines go on).
BY_LINE = frozenset({"python", "go", "c", "ruby", "php"})
def _tokens(family: str) -> re.Pattern[str]:
    comment, string, word = (f"(?P<{kind}>{x})" for kind, x in zip(("comment", "string", "word"), LANGUAGES[family]))
    # most tokens are words; only Rust's strings may begin like one
    first = [comment, string, word] if family == "rust" else [word, comment, string]
    return re.compile("|".join([*first, r"(?P<line>\n)", r"(?P<sign>=>|::|->|\S)"]), re.DOTALL | re.MULTILINE)


_PATTERNS = {family: _tokens(family) for family in LANGUAGES}
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def family_of(lang: str | None, path: str | None) -> str:
    """The family of a language; that of C, Ruby and PHP is told by the path."""
    if lang in ("javascript", "typescript"):
        return "script"
    if lang in LANGUAGES:
        return lang
    ending = (path or "").rsplit(".", 1)[-1].lower()
    return {"rb": "ruby", "php": "php"}.get(ending, "c")


@dataclass
class Code:
    """Tokens in order: what each reads in plain code, its value, place and column, and the token that closes it."""

    plain: str = ""
    words: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)  # in plain code
    closing: dict[int, int] = field(default_factory=dict)
    breaks: list[int] = field(default_factory=list)

    def token(self, at: int) -> int:
        """The token that begins at or before a place of the plain code."""
        return bisect_right(self.starts, at) - 1

    def line(self, token: int) -> int:
        return bisect_right(self.breaks, self.places[token] - 1) + 1

    def column(self, token: int) -> int:
        """How far a token stands from the start of its line."""
        line = bisect_right(self.breaks, self.places[token] - 1)
        return self.places[token] - (self.breaks[line - 1] + 1 if line else 0)

    def leads(self, token: int) -> bool:
        """Whether a token is the first of its line."""
        return token == 0 or self.line(token) > self.line(token - 1)

    def text(self, start: int, end: int) -> str:
        """Tokens from one place of the plain code to another, strings as their values, without spaces."""
        return "".join(self.values[self.token(start) : self.token(max(end - 1, start)) + 1])

    def strings(self, start: int, end: int) -> list[str]:
        return [self.values[k] for k in range(self.token(start), self.token(max(end - 1, start)) + 1) if self.words[k] == "'"]


def read(text: str, family: str) -> Code:
    """The tokens of a text; a first line break stands before it where lines count."""
    by_line, open_at, closing = family in BY_LINE, [], {}
    words, places, told = (["\n"], [0], {0: ""}) if by_line else ([], [], {})
    for m in _PATTERNS[family].finditer(text):
        kind = m.lastgroup
        if kind == "word":
            words.append(m[0])
        elif kind == "sign":
            word = m[0]
            if word in _OPENS:
                open_at.append(len(words))
            elif word in _CLOSES:
                for k in range(len(open_at) - 1, -1, -1):
                    if _OPENS[words[open_at[k]]] == word:  # what was opened since and not closed is let go
                        closing[open_at[k]] = len(words)
                        del open_at[k:]
                        break
            words.append('"' if word == "'" else word)
        elif kind == "string":
            told[len(words)] = _value(m[0])
            words.append("'")
        elif kind == "line" and by_line and not any(words[k] != "{" for k in open_at):
            told[len(words)] = ""
            words.append("\n")
        else:
            continue
        places.append(m.start())
    values = words.copy()
    for k, value in told.items():
        values[k] = value
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))[:-1]
    return Code("".join([w + " " for w in words]), words, values, places, starts, closing, [m.start() for m in re.finditer("\n", text)])


def _value(string: str) -> str:
    for quote in ('"""', "'''"):
        if string.startswith(quote) and len(string) >= 6:
            return string[3:-3]
    body = string.lstrip("r@$#")
    return body[1:].rstrip("#")[:-1]
