"""The rule engine: findings by line, summaries, merges, and licences by text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import code as C


@dataclass(frozen=True)
class Rule:
    """A pattern that is looked for line by line; ``sql`` is the same pattern for engines without look-around."""

    id: str
    severity: str
    category: str
    pattern: str
    langs: tuple[str, ...] = ()
    ignore: str = ""
    sql: str = ""
    sql_ignore: str = ""


_JS, _PY, _GO = ("javascript",), ("python",), ("go",)
#: Fixed values.
RULES = (
    Rule("hardcoded-secret", "critical", "secret", r"""(?i)\b(api[_-]?key|apikey|secret|client[_-]?secret|password|passwd|access[_-]?token|auth[_-]?token|private[_-]?key)\b\s*[:=]\s*['"`][^'"`\s]{8,}['"`]"""),
    Rule("aws-key", "critical", "secret", r"\b(AKIA|ASIA)[0-9A-Z]{16}\b"),
    Rule("private-key-block", "critical", "secret", r"-----BEGIN (RSA|EC|DSA|OPENSSH|PGP) PRIVATE KEY-----"),
    Rule("eval", "high", "injection", r"\beval\s*\(", _JS),
    Rule("new-function", "high", "injection", r"\bnew Function\s*\(", _JS),
    Rule("child-exec", "high", "injection", r"\b(child_process\.(exec|spawn)|execSync|spawnSync)\s*\(", _JS),
    Rule("os-system", "high", "injection", r"\bos\.system\s*\(|shell\s*=\s*True", _PY),
    Rule("sql-concat", "high", "injection", r"""\b(execute|query|exec|raw)\s*\(\s*[^)]*(\+|\$\{|\.format\(|f["'])"""),
    Rule("innerhtml", "medium", "xss", r"\b(innerHTML|outerHTML)\s*=|dangerouslySetInnerHTML|document\.write\s*\(", _JS, r"""\b(innerHTML|outerHTML)\s*=\s*(['"`])\2\s*;?\s*$""", sql_ignore=r"""\b(innerHTML|outerHTML)\s*=\s*(''|""|``)\s*;?\s*$"""),
    Rule("weak-hash", "medium", "crypto", r"""\b(md5|sha1)\s*\(|createHash\(\s*['"](md5|sha1)['"]"""),
    Rule("math-random", "low", "crypto", r"\bMath\.random\s*\(", _JS),
    Rule("insecure-deser", "high", "deserialization", r"\b(pickle\.loads?|yaml\.load\s*\((?![^)]*SafeLoader)|unserialize\s*\(|ObjectInputStream)", sql=r"\b(pickle\.loads?|unserialize\s*\(|ObjectInputStream)"),
    Rule("open-redirect", "medium", "redirect", r"\b(res\.redirect|redirect)\s*\(\s*(req\.|request\.)"),
    Rule("localhost-url", "low", "config", r"""['"`](https?://(localhost|127\.0\.0\.1)|localhost:\d|127\.0\.0\.1)"""),
    Rule("debugger", "low", "debug", r"\bdebugger\s*;?", _JS),
    Rule("console-log", "info", "debug", r"\bconsole\.(log|debug|info)\s*\(", _JS),
    Rule("print-stmt", "info", "debug", r"^\s*print\s*\(", _PY),
    Rule("todo", "info", "quality", r"\b(TODO|FIXME|XXX|HACK)\b"),
    Rule("loose-eq", "low", "quality", r"[^=!<>]==[^=]", _JS),
    Rule("var-keyword", "low", "quality", r"\bvar\s+[A-Za-z_$]", _JS),
    Rule("empty-catch", "medium", "quality", r"(catch\s*\([^)]*\)\s*\{\s*\}|except\s*\w*\s*:\s*pass\b)"),
    Rule("jwt-secret", "critical", "secret", r"""['"`](eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})['"`]"""),
    Rule("subprocess-shell", "high", "injection", r"\bsubprocess\.(Popen|run|call|check_output|check_call)\s*\([^)]*shell\s*=\s*True", _PY),
    Rule("go-public-listen", "medium", "config", r"""(ListenAndServe|Listen|TLS\s*\.\s*Listen|ListenAndServeTLS)\s*\(\s*["'](:[0-9]+|0\.0\.0\.0(?::[0-9]+)?|::)["']""", _GO),
)
#: Two rules of our own, which match the lines of texts that are no code.
CORPUS_RULES = (
    Rule("corpus-mail", "medium", "privacy", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+"),
    Rule("corpus-licence", "info", "licence", r"(?i)licen[cs]ed? (under|by)|MIT License"),
)


#: Texts of which a match of each rule has one at least (lower case where the pattern ignores case): looked for before the pattern is tried.
NEEDS: dict[str, tuple[str, ...]] = {
    "hardcoded-secret": ("key", "secret", "passw", "token",),
    "aws-key": ("AKIA", "ASIA",),
    "private-key-block": ("-----BEGIN ",),
    "eval": ("eval",),
    "new-function": ("new Function",),
    "child-exec": ("child_process.", "execSync", "spawnSync",),
    "os-system": ("os.system", "shell",),
    "sql-concat": ("execute", "query", "exec", "raw",),
    "innerhtml": ("innerHTML", "outerHTML", "InnerHTML", "document.write",),
    "weak-hash": ("md5", "sha1",),
    "math-random": ("Math.random",),
    "insecure-deser": ("pickle.load", "yaml.load", "unserialize", "ObjectInputStream",),
    "open-redirect": ("redirect",),
    "localhost-url": ("localhost", "127.0.0.1",),
    "debugger": ("debugger",),
    "console-log": ("console.",),
    "print-stmt": ("print",),
    "todo": ("TODO", "FIXME", "XXX", "HACK",),
    "loose-eq": ("==",),
    "var-keyword": ("var",),
    "empty-catch": ("catch", "except",),
    "jwt-secret": ("eyJ",),
    "subprocess-shell": ("subprocess.",),
    "go-public-listen": ("Listen",),
    "corpus-mail": ("@",),
    "corpus-licence": ("licen", "mit license",),
}


def may_match(rule: Rule, text: Column, low: Column, lang: Column) -> Column:
    """False only where the rule surely doesn't match: by language and by plain texts that a match contains."""
    where = low if rule.pattern.startswith("(?i)") else text
    ok = F.lit(True)
    if rule.id in NEEDS:
        ok = F.lit(False)
        for x in NEEDS[rule.id]:
            ok = ok | F.contains(where, F.lit(x))
    return lang.isin(*rule.langs) & ok if rule.langs else ok


def scan(files: DataFrame, rules: tuple[Rule, ...] = RULES, extra: tuple[Rule, ...] = ()) -> DataFrame:
    """path, line, rule, severity, category, excerpt of every rule that a line trips; files: path, text, lang.

    All rules are tried in one pass over the lines of texts that may match one; only
    lines that trip one are exploded into findings.
    """
    asked = (*rules, *extra)
    maybe = F.lit(False)
    for r in asked:
        maybe = maybe | may_match(r, F.col("text"), F.col("low"), F.col("lang"))
    some = files.select("path", "lang", "text", F.lower("text").alias("low")).where(maybe)
    lines = some.select("path", "lang", F.posexplode(F.split("text", "\n")).alias("at", "l")).withColumn("low", F.lower("l"))

    def tried(r: Rule) -> Column:
        hit = may_match(r, F.col("l"), F.col("low"), F.col("lang")) & F.col("l").rlike(C.ascii_bounds(r.pattern))
        if r.ignore:
            hit = hit & ~F.col("l").rlike(C.ascii_bounds(r.ignore))
        return F.when(hit, F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category")))

    found = lines.withColumn("f", F.explode(F.array_compact(F.array(*map(tried, asked)))))
    return found.select("path", (F.col("at") + 1).cast("long").alias("line"), "f.rule", "f.severity", "f.category", C.excerpt(F.col("l")).alias("excerpt"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, score from 100 and grade."""
    counts = findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in reversed(C.SEVERITIES)), F.count(F.lit(1)).alias("total"))
    score = F.greatest(F.lit(0), 100 - 15 * F.col("critical") - 6 * F.col("high") - 2 * F.col("medium") - F.least(F.lit(10), F.col("low"))).cast("long")
    return counts.withColumn("score", score).withColumn("grade", grade(F.col("score"), (90, 75, 60, 45)))


def grade(score: Column, bars: tuple[int, int, int, int]) -> Column:
    a, b, c, d = bars
    return F.when(score >= a, "A").when(score >= b, "B").when(score >= c, "C").when(score >= d, "D").otherwise("F")


def worst_by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path").agg(F.max(C.severity_rank(F.col("severity"))).alias("worst_rank"), F.count(F.lit(1)).alias("n"))


def tabulate(findings: DataFrame) -> DataFrame:
    """Counts by severity, by tool, by category and in all, in one pass."""
    severity, tool, category = F.col("severity"), F.col("tool"), F.col("category")
    sets = findings.groupingSets([[severity], [tool], [category], []], severity, tool, category)
    by = F.when(F.grouping("severity") == 0, "severity").when(F.grouping("tool") == 0, "tool").when(F.grouping("category") == 0, "category").otherwise("all")
    counts = sets.agg(by.alias("by_"), F.count(F.lit(1)).alias("n"))
    return counts.select("by_", F.coalesce("severity", "tool", "category", F.lit("")).alias("value"), "n")


def matching(findings: DataFrame, severity: str | None = None, text: str = "") -> DataFrame:
    out = findings.where(F.col("severity") == severity) if severity else findings
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "path", "rule", "excerpt", "category")), F.lit(text.lower())))
    return out


def merge(own: DataFrame, outside: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of both, outside ones on known paths only; the first of a path, line and rule stays."""
    both = own.withColumn("source", F.lit("builtin")).unionByName(outside.join(known, "path", "left_semi").withColumn("source", F.lit("external")))
    first = Window.partitionBy("path", "line", "rule").orderBy("source", "severity")
    return both.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


#: Licence id and pattern, tried in order.  Fixed values.
LICENCES = (
    ("MIT", r"(?i)\bMIT\b|Permission is hereby granted, free of charge"),
    ("Apache-2.0", r"(?i)Apache License,\s*Version 2\.0|http://www\.apache\.org/licenses/LICENSE-2\.0"),
    ("BSD-3-Clause", r"(?i)Redistribution and use in source and binary forms[\s\S]*?Neither the name of[\s\S]*?nor the names of its contributors"),
    ("BSD-2-Clause", r"(?i)Redistribution and use in source and binary forms[\s\S]*?Redistributions in binary form must reproduce the above copyright"),
    ("ISC", r"(?i)Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("GPL-3.0", r"(?i)GNU GENERAL PUBLIC LICENSE\s+Version 3|GPL-3\.0"),
    ("GPL-2.0", r"(?i)GNU GENERAL PUBLIC LICENSE\s+Version 2|GPL-2\.0"),
    ("AGPL-3.0", r"(?i)GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("LGPL-3.0", r"(?i)GNU LESSER GENERAL PUBLIC LICENSE\s+Version 3"),
    ("MPL-2.0", r"(?i)Mozilla Public License,?\s*v\.?\s*2\.0"),
    ("Unlicense", r"(?i)This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", r"(?i)CC0 1\.0 Universal|Public Domain Dedication"),
)


def licence_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LICENCES):
        out = F.when(text.rlike(C.ascii_bounds(pattern)), name).otherwise(out)
    return out


def licence_kind(licence: Column) -> Column:
    up = F.upper(F.coalesce(licence, F.lit("")))
    return (
        F.when(up.isin("", "UNKNOWN"), "unknown").when(up.rlike("MIT|APACHE|BSD|ISC|UNLICENSE|CC0|ZLIB|WTFPL"), "permissive")
        .when(up.rlike("LGPL|MPL|EPL"), "weak-copyleft").when(up.rlike("GPL"), "copyleft").otherwise("custom")
    )
