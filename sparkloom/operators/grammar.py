"""Statements of eight families of languages as patterns over plain code.

A statement is a kind, a detail and a pattern.  Groups of the pattern say what it
yields: ``name`` (a name or the value of a string), ``names`` (a clause of imported
names), ``many`` (several names: strings of a block or a list with commas), ``marks``
(annotations before it), ``flag`` (a word that changes its detail), ``body`` (where
its body or parameters begin).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from sparkloom.functions.lexing import Code, family_of, read

#: Words that stand before a bracket without being called or declared.  Fixed values.
CONTROL = frozenset(
    "if for while switch catch return else do new typeof case throw delete void in of yield await function constructor class".split()
)
CONTROL_C = frozenset("if for while switch catch return sizeof do else".split())

_ROUND = r"\( (?:[^()]|\( (?:[^()]|\( [^()]*\) )*\) )*\) "
_NAME = r"(?P<name>[\w$]+) "
_DOTTED = r"(?P<name>(?:[\w.]+ )+)"
_JAVA_WORDS = r"(?:(?:public|private|protected|abstract|final|static|sealed|strictfp|internal|partial|readonly|unsafe|new) )*"


@dataclass(frozen=True)
class Statement:
    kind: str
    detail: str
    pattern: str
    leads: bool = False


def _s(kind: str, detail: str, pattern: str, leads: bool = False) -> Statement:
    return Statement(kind, detail, pattern, leads)


_IMPORTS = [
    _s("import", "from", r"(?:import|export) (?:type )?(?P<names>[\w$*{}, ]+?)from (?P<name>') "),
    _s("import", "bare", r"import (?P<name>') "),
    _s("import", "call", r"(?:require|import) \( (?P<name>') \) "),
]
_EXPORTS = [
    _s("export", "function", rf"export (?:async )?function (?:\* )?{_NAME}"), _s("export", "class", rf"export (?:abstract )?class {_NAME}"),
    _s("export", "const", rf"export (?:const|let|var) {_NAME}"), _s("export", "type", rf"export (?:interface|type|enum) {_NAME}"), _s("export", "default", r"export (?P<name>default) "),
]
_NAMED = [_s("export", "named", r"export (?:type )?\{ (?P<many>[^{}]*)\} ")]
GRAMMAR: dict[str, list[Statement]] = {
    "javascript": [
        *_IMPORTS, *_EXPORTS, _s("export", "const", rf"exports \. {_NAME}= (?!=)"), _s("export", "default", r"module \. (?P<name>exports) = (?!=)"), *_NAMED,
        _s("function", "function", rf"function (?:\* )?{_NAME}(?P<body>\() "),
        _s("function", "function", rf"(?:const|let|var) {_NAME}= (?:async )?function (?:\* )?(?:[\w$]+ )?(?P<body>\() "),
        _s("function", "arrow", rf"(?:const|let|var) {_NAME}= (?:async )?(?:{_ROUND}|[\w$]+ )(?P<body>=>) "),
        _s("function", "method", rf"(?:export )?(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set) )*{_NAME}(?={_ROUND}(?:: [^{{}};()]*)?\{{ )(?P<body>\() ", leads=True),
        _s("class", "class", rf"class (?!extends ){_NAME}"),
    ],
    "typescript": [
        *_IMPORTS, *_EXPORTS, *_NAMED, _s("function", "function", rf"function (?:\* )?{_NAME}"),
        _s("class", "class", rf"(?P<marks>(?:@ [\w$]+ (?:\. [\w$]+ )*(?:{_ROUND})?)*)(?:export )?(?:default )?(?:declare )?(?:abstract )?class (?!extends ){_NAME}(?P<generic>< (?:[^<>{{}}]|< [^<>{{}}]*> )*> )?"),
        _s("interface", "interface", rf"(?:interface|enum) {_NAME}"), _s("interface", "interface", rf"type {_NAME}(?=[=<] )"),
        _s("main", "", r"(?P<name>require) \. main = = = module |(?P<meta>import) \. meta \. main "),
    ],
    "python": [
        _s("import", "from", r"(?<=\n )from (?P<name>[. \w]+?)import (?P<names>\( [^()]*\) |[^\n;]*)"), _s("import", "import", r"(?<=\n )import (?P<many>[\w., ]+?)(?=\n|;|\Z)"),
        _s("function", "function", rf"(?<=\n )(?:async def|def) {_NAME}(?P<body>\() "), _s("class", "class", rf"(?<=\n )class {_NAME}"), _s("main", "", r"__name__ = = (?P<name>') "),
    ],
    "go": [
        _s("package", "", rf"(?<=\n )package {_NAME}"), _s("import", "", r"(?<=\n )import (?:[\w.]+ )?(?P<name>') "), _s("import", "", r"import \( (?P<many>[^()]*)\) "),
        _s("function", "function", rf"(?<=\n )func (?:\( (?P<owner>[^()]*)\) )?{_NAME}(?:\[ [^\[\]]*\] )?(?P<body>\() "),
    ],
    "rust": [
        _s("import", "", r"(?:use|mod) (?P<name>(?::: )?\w+ (?::: (?:\w+ )?)*)"), _s("function", "function", rf"(?P<flag>pub (?:(?:async|unsafe|const|extern) (?:' )?)*)?fn {_NAME}"),
        _s("class", "class", rf"(?P<flag>pub (?:unsafe )?)?(?:struct|enum|trait) {_NAME}"), _s("main", "", r"fn (?P<name>main) \( "),
    ],
    "java": [
        _s("package", "", rf"package {_DOTTED}; "), _s("import", "", rf"import (?P<flag>static )?{_DOTTED}"),
        _s("class", "class", rf"(?P<marks>(?:@ (?!interface )\w+ (?:\. \w+ )*(?:{_ROUND})?)*){_JAVA_WORDS}(?:class|interface|enum|record|@ interface) {_NAME}"), _s("main", "", r"public static void (?P<name>main) \( "),
    ],
    "csharp": [
        _s("package", "", rf"namespace {_DOTTED}[;{{] "), _s("import", "", rf"using (?P<flag>static )?{_DOTTED}; "),
        _s("class", "class", rf"(?P<marks>(?:\[ [^\[\]]*\] )*){_JAVA_WORDS}(?:class|interface|struct|record|enum) (?!struct |class ){_NAME}"), _s("main", "", r"static (?:async Task (?:< int > )?|void |int )(?P<name>Main) \( "),
    ],
    "c": [
        _s("import", "local", r"(?<=\n )\# include (?P<name>') "), _s("import", "system", r"(?<=\n )\# include < (?P<name>[^>\n]+)> "),
        _s("function", "function", rf"(?<=\n )(?:[\w*]+ )+?{_NAME}(?={_ROUND}(?:\n )*\{{ )(?P<body>\() "), _s("main", "", r"int (?P<name>main) \( "),
    ],
    "ruby": [
        _s("import", "require_relative", r"(?<=\n )require_relative (?:\( )?(?P<name>') "), _s("import", "require", r"(?<=\n )require (?:\( )?(?P<name>') "),
        _s("function", "function", r"(?<=\n )def (?:self \. )?(?P<name>[\w!?]+) "), _s("class", "class", r"(?<=\n )(?:class|module) (?P<name>\w+ (?::: \w+ )*)"),
    ],
    "php": [
        _s("import", "require", r"(?:require|include)(?:_once)? (?:\( )?(?P<name>') "), _s("import", "use", r"(?<=\n )use (?P<name>[\w\\]+) ; "),
        _s("function", "function", rf"function {_NAME}(?P<body>\() "), _s("class", "class", rf"class {_NAME}"),
    ],
}
_KEYWORDS = re.compile(r"(\(\?<=\\n \))?(?:\(\?:([A-Za-z_| ]+)\)|([A-Za-z_]+))(?= )")


def _compiled(pattern: str) -> re.Pattern[str]:
    """The pattern at the start of a token.

    Where it begins with keywords, what stands before is looked at after their first
    letter: a search then goes from letter to letter and does not try every place.
    """
    m = _KEYWORDS.match(pattern)
    if not m:
        return re.compile(rf"(?<!\S)(?:{pattern})")
    before = r"(?<=\n " if m[1] else r"(?<!\S"
    return re.compile("(?:" + "|".join(f"{w[0]}{before}{w[0]}){w[1:]}" for w in (m[2] or m[3]).split("|")) + ")" + pattern[m.end() :])


_COMPILED = {lang: [(s, _compiled(s.pattern)) for s in rules] for lang, rules in GRAMMAR.items()}
_CALL = re.compile(r"(?<!\S)([\w$]+) \( ")
#: What makes two imports of a file the same, by language (all others: name and line).
_SAME = {"go": ("name",), "java": ("name", "detail"), "generic": ("name", "detail"), "csharp": ("name", "detail", "at")}

Row = dict[str, object]


def clause_names(clause: str) -> list[str]:
    """Names of an import clause in plain code: ``default``, ``*`` and what stands in braces, by their first names."""
    outside, _, inside = clause.partition("{")
    first = outside.replace(",", " ").split()
    names = ["*"] if "*" in first else ["default"] if first and first != ["type"] else []
    listed = [part.split() for part in inside.partition("}")[0].split(",")]
    return names + [words[1] if words[0] == "type" and len(words) > 1 and words[1] != "as" else words[0] for words in listed if words]


def listed_names(clause: str) -> list[str]:
    """First names of a list with commas: ``a as b, c`` gives a and c."""
    return ["".join(part.split(" as ")[0].split()) for part in clause.strip("() \n").split(",") if part.split()]


def _last_names(clause: str) -> list[str]:
    """The names under which a list in braces is known outside."""
    words = [part.split() for part in clause.split(",")]
    return [w[-1] for w in words if w and w != ["type"]]


def body_end(code: Code, at: int, detail: str, indent: int | None) -> int | None:
    """The token after a function's body; ``at`` is its parameters' bracket or its arrow."""
    n = len(code.words)
    if indent is not None:  # by indentation: up to the next line that is not deeper
        for k in range(code.closing.get(at, at), n):
            if code.words[k] == "\n" and k + 1 < n and code.words[k + 1] != "\n" and code.column(k + 1) <= indent:
                return k
        return n
    k = at + 1
    if detail != "arrow":
        k = code.closing.get(at, at) + 1
        while k < n and code.words[k] not in ("{", ";", "}"):
            k = code.closing.get(k, k) + 1
    if k < n and code.words[k] == "{":
        return code.closing.get(k, n)
    if detail != "arrow":
        return None
    first = k
    while k < n and code.words[k] not in (";", ",", ")", "]", "}") and not (k > first and code.leads(k) and code.words[k] not in (".", "?", ":", "+", "-", "*", "/", "&", "|")):
        k = code.closing.get(k, k) + 1
    return k


def statements(path: str | None, lang: str | None, text: str) -> list[Row]:
    """Imports, exports, functions, classes, interfaces, packages, entry points and calls of a file."""
    family = family_of(lang, path)
    lang = lang if lang in GRAMMAR else family
    code, rows, seen = read(text, family), [], set()

    def add(kind: str, detail: str, name: str, token: int, names: list[str] | None = None, start: int | None = None, until: int | None = None, size: int | None = None) -> None:
        row: Row = {"kind": kind, "detail": detail, "name": name, "names": names or [], "line": code.line(token), "at": code.places[token]}
        row |= {"start": None if start is None else code.places[start], "until": None if until is None else code.places[until] if until < len(code.places) else len(text), "size": size}
        if kind == "import":
            key = (kind, *(row[k] for k in _SAME.get("generic" if family in ("c", "ruby", "php") else lang, ("name", "line"))))
        elif kind == "export":
            key = (kind, name)
        elif kind in ("package", "main"):
            key = (kind,)
        else:
            key = (kind, name, row["line"], row["at"] if kind == "call" or lang != "javascript" else 0)
        if name and key not in seen:
            seen.add(key)
            rows.append(row)

    for rule, pattern in _COMPILED[lang]:
        for m in pattern.finditer(code.plain):
            group = m.groupdict()
            token = code.token(m.start())
            if rule.leads and not code.leads(token):
                continue
            name = code.text(*m.span("name")) if group.get("name") else ""
            detail, names, start, until, size = rule.detail, [], None, None, None
            if group.get("many") is not None:
                if lang == "go":
                    found = code.strings(*m.span("many"))
                elif rule.kind == "export":
                    found = _last_names(group["many"])
                else:
                    found = listed_names(group["many"])
                for one in found:
                    add(rule.kind, detail, one, token)
                continue
            if group.get("flag"):
                detail = {"import": "static"}.get(rule.kind, "pub")
            if rule.kind == "import" and group.get("names"):
                names = clause_names(group["names"]) if family == "script" else listed_names(group["names"])
            if group.get("marks"):
                names = re.findall(r"@ ([\w$]+)" if "@" in group["marks"] else r"\[ (\w+)", group["marks"])
            if lang == "typescript" and rule.kind == "class":
                size = re.sub(r"< [^<>]*> ", "", group["generic"][2:]).count(",") + 1 if group.get("generic") else 0
            if rule.kind == "class" or rule.kind == "function":
                token = code.token(m.end("marks")) if group.get("marks") else token
            if rule.kind == "function":
                if name in (CONTROL if family == "script" else CONTROL_C if family == "c" else ()):
                    continue
                if family in ("c", "go") and code.column(token):
                    continue
                indent = code.column(token) if lang == "python" else None
                if lang == "python" and indent:
                    detail = "method"
                if group.get("owner") is not None:
                    detail, names = "method", [w for w in re.sub(r"[*\[].*|\*", " ", group["owner"].replace("* ", "")).split()][-1:]
                if group.get("body"):
                    start = code.token(m.start("body"))
                    until = body_end(code, start, detail, indent)
            if rule.kind == "main":
                if lang == "python" and name != "__main__":
                    continue
                name = "main"
            if rule.kind == "export" and name == "exports":
                name = "default"
            add(rule.kind, detail, name, token, names, start, until, size)
    if lang == "go" and any(r["kind"] == "package" and r["name"] == "main" for r in rows):
        for m in re.finditer(r"(?<=\n )func main \( \) ", code.plain):
            add("main", "", "main", code.token(m.start()))
    if lang in ("javascript", "python"):
        known = {r["name"] for r in rows if r["kind"] == "function"}
        for m in _CALL.finditer(code.plain):
            if m[1] in known:
                add("call", "", m[1], code.token(m.start()))
    return rows
