"""Text and code metrics as Columns; all states run inside one row by folds over its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_LANGS = ("python", "ruby", "yaml", "toml", "shell")
#: Words that open a decision, by language.  Fixed values.
DECISIONS = {
    "javascript": "if|for|while|case|catch|do|else if",
    "python": "if|elif|for|while|except",
    "go": "if|for|case|go|select",
    "": "if|elif|for|while|case|catch|except|switch",
}
#: Operators in the order in which they are tried.  Fixed values.
OPERATORS = ("+", "-", "*", "/", "=", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&&", "||", "!", "%", "**", "++", "--", "+=", "-=", "*=", "/=", "=>", "??", "?.", "...")
#: Words that are no operands.  Fixed values.
KEYWORDS = ("if", "else", "for", "while", "return", "function", "class", "import", "export", "var", "let", "const", "true", "false", "null")
OPERANDS = r"""\b[a-zA-Z_][a-zA-Z0-9_]*\b|\b\d+\b|['"][^'"]*['"]"""
BOOLEANS = r"&&|\|\||\?"


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries between ASCII word characters only, whatever the JVM's default."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def operator_pattern() -> str:
    escaped = ["".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in op) for op in OPERATORS]
    return "|".join(escaped)


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def code_stats(text: Column, lang: Column) -> Column:
    """Struct of lines, code, comment and blank; a block comment is carried from line to line."""
    hashed = lang.isin("python", "ruby", "yaml", "toml", "shell", "bash", "sh") | ((lang == "") & (F.contains(text, F.lit("#!")) | text.rlike(r"\b(def|import|class)\b")))

    # without a block comment lines don't depend on each other
    lines = F.split(text, "\n")
    trimmed = F.transform(lines, js_trim)
    count = lambda x, keep: F.size(F.filter(x, keep))
    plain = let(trimmed, lambda x: F.struct(F.size(x).alias("lines"), count(x, lambda y: y == "").alias("blank"), count(x, lambda y: y.startswith("//") | (hashed & y.startswith("#"))).alias("comment")))
    plain = let(plain, lambda r: F.struct(r["lines"], (r["lines"] - r["blank"] - r["comment"]).alias("code"), r["comment"], r["blank"]))

    def step(acc: Column, raw: Column) -> Column:
        line = js_trim(raw)
        close, opens = F.contains(line, F.lit("*/")), line.startswith("/*")
        kind = F.when(line == "", "blank").when(acc["open"] | line.startswith("//") | (hashed & line.startswith("#")) | opens, "comment").otherwise("code")
        still = F.when(line == "", acc["open"]).when(acc["open"], ~close).when(line.startswith("//") | (hashed & line.startswith("#")), F.lit(False)).otherwise(opens & ~close)
        one = lambda name: (acc[name] + F.when(kind == name, 1).otherwise(0)).alias(name)
        return F.struct(still.alias("open"), one("code"), one("comment"), one("blank"))

    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(0).alias("blank"))
    folded = F.aggregate(lines, start, step, lambda a: F.struct(F.size(lines).alias("lines"), a["code"], a["comment"], a["blank"]))
    return F.when(F.contains(text, F.lit("/*")), folded).otherwise(plain)


def _blanked(text: Column, opens: str, comment: str, rest: str) -> Column:
    """Every match of ``comment`` with spaces for all but its line breaks; ``rest`` matches what lies between."""
    pieces = F.regexp_extract_all(text, F.lit(f"{comment}|{rest}"), F.lit(0))
    blank = F.transform(pieces, lambda p: F.when(p.rlike(f"^(?:{comment})$"), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p))
    return F.when(F.contains(text, F.lit(opens)), F.array_join(blank, "")).otherwise(text)


def blank_comments(text: Column, lang: Column) -> Column:
    """The text with spaces in place of comments: offsets and line numbers stay as they are."""
    hashed = let(_blanked(text, "/*", r"/\*[\s\S]*?\*/", r"[^/]+|/"), lambda t: _blanked(t, "#", r"(?m)^[ \t]*#[^\n]*", r"[^\n]+|\n"))
    slashed = let(_blanked(text, "/*", r"/\*[\s\S]*?\*/", r"[^/]+|/"), lambda t: _blanked(t, "//", r"//[^\n]*", r"[^/]+|/"))
    return F.when(lang.isin(*HASH_LANGS), hashed).otherwise(slashed)


def complexity(text: Column, lang: Column) -> Column:
    """One, plus decision words of the language, plus boolean operators and question marks."""

    def of(clean: Column) -> Column:
        words = F.regexp_count(clean, F.lit(ascii_bounds(rf"\b({DECISIONS['']})\b")))
        for name, pattern in DECISIONS.items():
            if name:
                words = F.when(lang == name, F.regexp_count(clean, F.lit(ascii_bounds(rf"\b({pattern})\b")))).otherwise(words)
        return (1 + words + F.regexp_count(clean, F.lit(BOOLEANS))).cast("long")

    return let(blank_comments(text, lang), of)


def halstead(text: Column, lang: Column) -> Column:
    """Struct of distinct and total operators and operands, volume, difficulty and effort."""

    def of(clean: Column) -> Column:
        ops = F.regexp_extract_all(clean, F.lit(operator_pattern()), F.lit(0))
        names = F.filter(F.regexp_extract_all(clean, F.lit(ascii_bounds(OPERANDS)), F.lit(0)), lambda w: ~w.isin(*KEYWORDS))
        raw = F.struct(F.size(F.array_distinct(ops)).alias("n1"), F.size(F.array_distinct(names)).alias("n2"), F.size(ops).alias("t1"), F.size(names).alias("t2"))
        return let(raw, _halstead)

    return let(blank_comments(text, lang), of)


def _halstead(r: Column) -> Column:
    vocabulary, length = r["n1"] + r["n2"], r["t1"] + r["t2"]
    volume = F.when(vocabulary == 0, F.lit(0.0)).otherwise(length * F.log2(vocabulary.cast("double")))
    difficulty = F.when((r["n1"] == 0) | (r["n2"] == 0), F.lit(0.0)).otherwise(r["n1"] / 2.0 * (r["t2"] / r["n2"].cast("double")))
    return F.struct(r["n1"].alias("n1"), r["n2"].alias("n2"), r["t1"].alias("t1"), r["t2"].alias("t2"), volume.alias("volume"), difficulty.alias("difficulty"), (difficulty * volume).alias("effort"))


def cognitive(text: Column, lang: Column) -> Column:
    """Decisions weighted by the depth of braces before them; the depth never falls below zero."""

    def step(acc: Column, raw: Column) -> Column:
        opens, closes = F.contains(raw, F.lit("{")), F.contains(raw, F.lit("}"))
        block, loose = raw.rlike(ascii_bounds(r"\b(if|for|while|do|switch|catch)\b")), raw.rlike(ascii_bounds(r"\b(if|else if|for|while|do|catch)\b"))
        score = acc["score"] + F.when(opens & block, 1 + acc["depth"]).otherwise(0)
        depth = acc["depth"] + F.when(opens, 1).otherwise(0)
        depth = F.when(closes, F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        score = score + F.when(~opens & loose, 1 + depth).otherwise(0) + F.when(raw.rlike(ascii_bounds(r"\belse\b(?!\s+if)")), 1).otherwise(0)
        return F.struct((score + F.regexp_count(raw, F.lit(BOOLEANS))).alias("score"), depth.alias("depth"))

    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("depth"))
    return F.aggregate(F.split(blank_comments(text, lang), "\n"), start, step, lambda a: a["score"].cast("long"))


def maintainability(volume: Column, cx: Column, loc: Column) -> Column:
    raw = (171 - 5.2 * F.ln(volume) - 0.23 * cx - 16.2 * F.ln(loc.cast("double"))) * 100 / 171
    return F.when((volume == 0) | (loc == 0), F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def doc_ratio(comment: Column, code: Column) -> Column:
    return F.when(comment + code == 0, F.lit(0).cast("long")).otherwise(round_half_up(100.0 * comment / (comment + code)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII word characters, of two characters at least."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) > 1)


def html_text(html: Column, limit: int = 14_000) -> Column:
    """Readable text of a page: scripts, styles and tags go, six entities are decoded, blanks collapse, paragraphs stay."""
    x = F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", " ")
    x = F.regexp_replace(x, r"(?i)<style[\s\S]*?</style>", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))  # &amp; last, so nothing is decoded twice
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.left(js_trim(x), F.lit(limit))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def excerpt(line: Column, size: int = 90) -> Column:
    return F.left(js_trim(line), F.lit(size))


def clean_version(version: Column) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(version, r"^[~^>=< ]+", ""), " ", 1))


def mermaid_text(x: Column) -> Column:
    """A label without the characters that diagrams reserve, 80 characters at most."""
    return F.left(F.replace(F.regexp_replace(x, r"""["<>|{}\[\]()]""", ""), F.lit("&"), F.lit("and")), F.lit(80))


def short_name(name: Column, size: int = 34) -> Column:
    return F.when(F.length(name) > size, F.concat(F.left(name, F.lit(size - 1)), F.lit("…"))).otherwise(name)


SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def normalize_severity(word: Column) -> Column:
    w = F.lower(F.coalesce(word, F.lit("")))
    return (
        F.when(w == "critical", "critical").when(w.isin("error", "high"), "high")
        .when(w.isin("medium", "warning", "warn", "moderate"), "medium").when(w.isin("low", "note"), "low").otherwise("info")
    )


def line_of(text: Column, needle: str) -> Column:
    """1-based line of the first occurrence; zero if there is none."""
    at = F.instr(text, needle)
    before = F.left(text, at - 1)
    return F.when(at == 0, F.lit(0)).otherwise(F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def snippet_at(text: Column, place: Column, most: int = 120) -> Column:
    """The line of a place; of a longer one a stretch around the place, with a mark where it is cut off before."""
    place = F.greatest(place, F.lit(1))
    before = F.left(text, place - 1)
    column = F.length(F.substring_index(before, "\n", -1))
    line = F.concat(F.substring_index(before, "\n", -1), F.substring_index(F.substring(text, place, F.length(text)), "\n", 1))
    line = F.regexp_replace(line, r"\r$", "")
    begin = F.greatest(column - most // 3, F.lit(0))
    cut = F.concat(F.when(begin > 0, "…").otherwise(""), F.substring(line, begin + 1, F.lit(most - 2)))
    return js_trim(F.when(F.length(line) > most, cut).otherwise(line))


def snippet(text: Column, needle: str, around: int = 120) -> Column:
    """The surroundings of the first occurrence; empty if there is none."""
    return F.when(F.instr(text, needle) == 0, F.lit("")).otherwise(snippet_at(text, F.instr(text, needle), around))


#: Comments and quoted texts of scripts; one that is not closed goes on to the end.
_HIDDEN = "|".join([r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\z)", *(rf"{q}[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+(?:{q}|\\?\z)" for q in "'\"`")])


def js_code_mask(text: Column) -> Column:
    """The text of a script with spaces for comments and quoted texts: offsets and line numbers stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{_HIDDEN}|[^/'\"`]+|/"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^(?://|/\*|['\"`])"), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def brace_body(text: Column, at: Column) -> Column:
    """The text from the brace at a place (1 for the first character) to the brace that closes it, or to the end."""

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        done = acc["done"] | ((piece == "}") & (depth <= 0))
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["size"] + F.length(piece)).alias("size"), done.alias("done")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))
    rest = F.substring(text, at, F.length(text))
    return let(rest, lambda r: F.left(r, F.aggregate(F.regexp_extract_all(r, F.lit(r"[^{}]+|[{}]"), F.lit(0)), start, step, lambda a: a["size"])))


def calls_within(body: Column, names: Column) -> Column:
    """Which of the names (in their order, each once) are called in a text; ``$`` is a letter, ``a.b(`` calls b."""
    called = F.regexp_extract_all(body, F.lit(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\("), F.lit(1))
    return F.array_intersect(names, called)


def declaration_order(names: Column, declared: Column) -> Column:
    """The names in the order in which they were first declared."""
    return F.array_intersect(declared, names)
