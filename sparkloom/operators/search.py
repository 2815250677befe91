"""Search over documents (path, text): a query language, an index of terms, rankers of paths, texts and symbols, and marks.

A query is words, ``"phrases"``, ``/patterns/flags`` and filters: ``ext:js,ts``,
``path:part``, ``kind:class``, ``is:test``, ``is:source``, ``-word``.  ``parse`` reads
queries as Columns, so a table of them is parsed like one; ``compiled`` turns one into a
``Query``, which the rankers and gates make Columns of.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import code as C
from sparkloom.functions import paths as P
from sparkloom.functions.code import let, snippet_at
from sparkloom.storage import stage


@dataclass(frozen=True)
class Query:
    """What is asked for, in lower case unless ``case`` holds; all parts must be met.

    terms match loosely by path (a subsequence will do), phrases and texts literally,
    pattern is a regular expression, negatives must not occur in a path or a symbol's
    name, kinds name the kinds of symbols, exts and parts are of paths.
    """

    terms: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    pattern: str = ""
    negatives: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    exts: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    is_test: bool = False
    is_source: bool = False
    case: bool = False
    error: str = field(default="", compare=False)

    @property
    def empty(self) -> bool:
        return not (self.terms or self.phrases or self.pattern)

    @property
    def filters(self) -> bool:
        return bool(self.negatives or self.exts or self.parts or self.kinds or self.is_test or self.is_source)

    @property
    def advanced(self) -> bool:
        """Whether anything was decided (then it is enforced) or words are only to be ranked."""
        return self.filters or bool(self.phrases or self.pattern) or self.case

    def fold(self, x: Column) -> Column:
        return x if self.case else F.lower(x)


#: Longest pattern that is taken.  Fixed value.
MAX_PATTERN = 200
_PATTERN = r"^/([^\s/]+)/([gimsuy]*)$"


def parse(raw: Column, case: Column | bool = False) -> Column:
    """Struct of clauses (kind, raw, start, end, value, flags; places from 0) and error of a query.

    kind is phrase, regex, neg, ext, path, kind, is or term.  A filter without a value
    and an empty phrase are no clause; an unknown filter is a word.
    """
    case = F.lit(case) if isinstance(case, bool) else case
    pieces = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r'"[^"]*"|/[^\s/]+/[gimsuy]*|\S+|\s+'), F.lit(0))
    fold = lambda x: F.when(case, x).otherwise(F.lower(x))

    def kind_of(x: Column) -> Column:
        name, colon = F.lower(F.substring_index(x, ":", 1)), F.instr(x, ":")
        value = F.when(colon > 1, F.substring(x, colon + 1, F.length(x))).otherwise("")
        return (
            F.when(x.rlike(r"^\s") | x.rlike(r'^"\s*"$') | ((colon > 1) & (value == "") & ~x.startswith("-")), F.lit(None))
            .when(x.rlike('^"[^"]*"$'), "phrase").when(x.rlike(_PATTERN), F.when(F.length(F.regexp_extract(x, _PATTERN, 1)) <= MAX_PATTERN, "regex").otherwise("long"))
            .when(x.startswith("-") & (F.length(x) > 1), "neg").when(name.isin("ext", "exts", "type") & (value != ""), "ext").when(name.isin("path", "in") & (value != ""), "path")
            .when((name == "kind") & (value != ""), "kind").when((name == "is") & F.lower(value).isin("test", "tests", "source", "src"), "is").otherwise("term")
        )

    def clause(k: Column) -> Column:
        kind, x, start = k["kind"], k["raw"], k["start"]
        value = F.substring(x, F.instr(x, ":") + 1, F.length(x))  # of kinds that have one
        text = (
            F.when(kind == "phrase", fold(F.regexp_replace(x, r'^"\s*|\s*"$', ""))).when(kind == "regex", F.regexp_extract(x, _PATTERN, 1)).when(kind == "neg", fold(F.substring(x, 2, F.length(x))))
            .when(kind.isin("ext", "kind"), F.lower(value)).when(kind == "path", fold(value)).when(kind == "is", F.when(F.lower(value).startswith("t"), "test").otherwise("source")).otherwise(fold(x))
        )
        flags = F.when(kind == "regex", let(F.regexp_extract(x, _PATTERN, 2), lambda f: F.when((f == "") & ~case, "i").otherwise(f)))
        return F.struct(kind.alias("kind"), x.alias("raw"), start.alias("start"), (start + F.length(x)).alias("end"), text.alias("value"), flags.alias("flags"))

    def of(every: Column) -> Column:
        long = F.filter(every, lambda c: c["kind"] == "long")
        size = F.length(F.regexp_extract(F.get(long, F.lit(0))["raw"], _PATTERN, 1))
        error = F.when(F.size(long) > 0, F.concat(F.lit("Regex is too long ("), size.cast("string"), F.lit(f" > {MAX_PATTERN}).")))
        return F.struct(F.transform(F.filter(every, lambda c: c["kind"] != "long"), clause).alias("clauses"), error.alias("error"))

    # what later steps name more than once is computed once: pieces, their starts (running sums) and kinds
    def placed(p: Column) -> Column:
        first = F.array(F.lit(0))
        starts = F.aggregate(p, first, lambda n, x: F.concat(n, F.array(F.element_at(n, -1) + F.length(x))))
        return F.arrays_zip(p.alias("raw"), starts.alias("start"))

    def kinds(zipped: Column) -> Column:
        told = F.transform(zipped, lambda z: F.struct(kind_of(z["raw"]).alias("kind"), z["raw"].alias("raw"), z["start"].alias("start")))
        return F.filter(told, lambda c: c["kind"].isNotNull() & c["raw"].isNotNull())

    return let(pieces, lambda p: let(kinds(placed(p)), of))


def values(parsed: Column, kind: str) -> Column:
    """The values of all clauses of a kind; of extensions each of the list, without its dot."""
    found = F.transform(F.filter(parsed["clauses"], lambda c: c["kind"] == kind), lambda c: c["value"])
    if kind == "ext":
        return F.filter(F.transform(F.flatten(F.transform(found, lambda v: F.split(v, ","))), lambda e: F.regexp_replace(F.trim(e), r"^\.", "")), lambda e: e != "")
    return found


def flags(parsed: Column, case: Column | bool = False) -> Column:
    """Struct of empty (nothing asked), filters (something is filtered) and advanced (something is enforced)."""
    case = F.lit(case) if isinstance(case, bool) else case
    kinds = F.transform(parsed["clauses"], lambda c: c["kind"])
    some = lambda *names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    filters = some("neg", "path", "kind", "is") | (F.size(values(parsed, "ext")) > 0)
    return F.struct((~some("term", "phrase", "regex") & ~filters).alias("empty"), filters.alias("filters"), (filters | some("phrase", "regex") | case).alias("advanced"))


def without_clause(raw: Column, start: Column, end: Column) -> Column:
    """The query without what stands from one place to another, and one space in its place where both sides remain."""
    start = F.greatest(F.lit(0), F.least(F.coalesce(start, F.lit(0)), F.length(raw)))
    end = F.greatest(start, F.least(F.coalesce(end, start), F.length(raw)))
    head, tail = F.regexp_replace(F.left(raw, start), r"\s+$", ""), F.regexp_replace(F.substring(raw, end + 1, F.length(raw)), r"^\s+", "")
    return F.when((head != "") & (tail != ""), F.concat_ws(" ", head, tail)).otherwise(F.concat(head, tail))


def compiled(spark: SparkSession, raw: str, case: bool = False) -> Query:
    """One query; ``error`` tells of a pattern that is too long or can't be read."""
    row = spark.range(1).select(parse(F.lit(raw), case).alias("p")).first().p
    of = lambda *kinds: tuple(c.value for c in row.clauses if c.kind in kinds)
    exts = tuple(e.strip().removeprefix(".") for v in of("ext") for e in v.split(",") if e.strip().removeprefix("."))
    pattern, error = "", row.error or ""
    for c in row.clauses:
        if c.kind == "regex":
            pattern = "".join(f"(?{f})" for f in dict.fromkeys(c.flags) if f in "ims") + c.value
            try:
                spark.range(1).where(F.lit("x").rlike(pattern)).count()
            except PySparkException as e:
                pattern, error = "", f"Bad regex: {str(e).splitlines()[0]}"
    return Query(of("term"), of("phrase"), pattern, of("neg"), of("kind"), exts, of("path"), "test" in of("is"), "source" in of("is"), case, error)


def gate(path: Column, query: Query) -> Column:
    """Whether a path passes the filters; kinds say nothing about paths."""
    low, out = query.fold(path), F.lit(True)
    if query.exts:
        out = out & F.regexp_replace(P.ext_of(path), r"^\.", "").isin(*query.exts)
    for x in query.parts:
        out = out & F.contains(low, F.lit(x))
    for x in query.negatives:
        out = out & ~F.contains(low, F.lit(x))
    if query.is_test:
        out = out & P.is_test(path)
    if query.is_source:
        out = out & ~P.is_test(path)
    return out


#: Weights of a term in a name, a path, a symbol and a text, and of phrases in paths and texts.  Fixed values.
IN_NAME, IN_PATH, IN_SYMBOL, IN_TEXT, PHRASE_IN_PATH, PHRASE_IN_TEXT = 150.0, 70.0, 130.0, 60.0, 90.0, 120.0
#: Scores of a whole name, a whole symbol, a pattern by path and by text, and of a symbol without terms.  Fixed values.
WHOLE_NAME, WHOLE_SYMBOL, PATTERN_IN_PATH, PATTERN_IN_TEXT, ANY_SYMBOL = 320.0, 240.0, 80.0, 100.0, 60.0
#: Points of a matched letter, of each further one in a run, and of one at the start, after a mark, at a capital.  Fixed values.
LETTER, RUN, AT_START, AFTER_MARK, CAPITAL = 10.0, 6.0, 14.0, 12.0, 10.0


def occurrence(hay: Column, needle: str, weight: float) -> Column:
    """Score of the first occurrence, zero if there is none: earlier counts more, so does the start, a word's start, and the whole."""
    at = F.instr(hay, needle) - 1
    bonus = F.when(at == 0, 0.6 * weight).when(F.substring(hay, at, F.lit(1)).rlike("[^a-z0-9]"), 0.35 * weight).otherwise(0.0)
    return F.when(at < 0, F.lit(0.0)).otherwise(weight - at + bonus + F.when(hay == needle, 1.2 * weight).otherwise(0.0))


def fuzzy(hay: Column, needle: str, case: bool = False) -> Column:
    """Score of the needle as a subsequence of the name, letters taken as early as they come; zero if it is none.

    Runs, word starts and capitals count more, late and long names less, and a match at least one.
    """
    folded = hay if case else F.lower(hay)

    def step(acc: Column, c: Column) -> Column:
        at = F.call_function("locate", c, folded, acc["at"] + 1)
        run = F.when((acc["first"] > 0) & (at == acc["at"] + 1), acc["run"] + 1).otherwise(0)
        before = F.substring(hay, at - 1, F.lit(1))
        bonus = (
            F.when(at == 1, AT_START).when((before if case else F.lower(before)).rlike("[^a-z0-9]"), AFTER_MARK)
            .when(before.rlike("[a-z0-9]") & F.substring(hay, at, F.lit(1)).rlike("[A-Z]"), CAPITAL).otherwise(0.0)
        )
        lost = (at == 0) | acc["lost"]
        first = F.when(acc["first"] > 0, acc["first"]).otherwise(at)
        return F.struct(at.alias("at"), first.alias("first"), run.alias("run"), (acc["score"] + LETTER + RUN * run + bonus).alias("score"), lost.alias("lost"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("run"), F.lit(0.0).alias("score"), F.lit(False).alias("lost"))
    chars = F.array(*map(F.lit, needle if case else needle.lower()))
    longer = F.greatest(F.length(hay) - len(needle), F.lit(0)) * 0.4
    return F.aggregate(chars, start, step, lambda a: F.when(a["lost"], F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), a["score"] - (a["first"] - 1) - longer)))


def _first_hit(*scores: Column) -> Column:
    """The first score that is not zero, else zero; later ones are not computed."""
    return F.coalesce(*(F.nullif(x, F.lit(0.0)) for x in scores), F.lit(0.0))


def _all(scores: list[Column], total: Column) -> Column:
    """``total`` of the array of scores if none of them is zero, else zero; each is computed once."""
    return let(F.array(*scores), lambda xs: F.when(F.exists(xs, lambda x: x == 0), F.lit(0.0)).otherwise(total(xs)))


def path_score(path: Column, query: Query) -> Column:
    """How well a path answers; zero if any part of the query is not met.

    A term counts by the name, else by the path, else as a subsequence of either;
    deeper paths count a little less.
    """
    if query.empty:
        return F.lit(1.0)
    name, low_name, low = P.name_of(path), query.fold(P.name_of(path)), query.fold(path)
    met = [F.contains(low, F.lit(x)) for x in query.phrases]
    fixed = [occurrence(low, x, PHRASE_IN_PATH) for x in query.phrases]
    if query.pattern:
        met.append(path.rlike(query.pattern))
        fixed.append(F.lit(PATTERN_IN_PATH))
    base = sum(fixed, F.lit(0.0))
    owns = [
        F.when(low_name == t, F.lit(WHOLE_NAME)).otherwise(
            _first_hit(occurrence(low_name, t, IN_NAME), occurrence(low, t, IN_PATH), fuzzy(name, t, query.case), fuzzy(path, t, query.case))
        )
        for t in query.terms
    ]

    def total(xs: Column) -> Column:
        whole = base + F.aggregate(xs, F.lit(0.0), lambda n, x: n + x)
        return let(whole - 0.5 * F.size(F.split(path, "/")), lambda t: F.when(whole == 0, F.lit(0.0)).when(t > 0, t).otherwise(0.5))

    score = _all(owns, total) if owns else F.when(base == 0, F.lit(1.0)).otherwise(base)
    for m in met:
        score = F.when(m, score).otherwise(0.0)
    return score


def content_score(text: Column, query: Query) -> Column:
    """How well a text answers; zero if any part does not occur.  Negatives say nothing about texts."""
    if query.empty:
        return F.lit(0.0)
    low = query.fold(text)
    parts = [occurrence(low, x, PHRASE_IN_TEXT) for x in query.phrases]
    met = [F.contains(low, F.lit(x)) for x in (*query.phrases, *query.terms)]
    if query.pattern:
        parts.append(F.lit(PATTERN_IN_TEXT))
        met.append(text.rlike(query.pattern))
    parts += [occurrence(low, x, IN_TEXT) for x in query.terms]
    every = met[0]
    for m in met[1:]:
        every = every & m
    return F.when(every & (text != ""), sum(parts[1:], parts[0])).otherwise(0.0)


def content_place(text: Column, query: Query) -> Column:
    """Place (1 for the first character) of the first hit of any part; zero if there is none."""
    low = query.fold(text)
    places = [F.instr(low, x) for x in (*query.phrases, *query.terms)]
    if query.pattern:
        places.append(F.regexp_instr(text, F.lit(query.pattern)))
    return F.coalesce(F.array_min(F.filter(F.array(*places), lambda p: p > 0)), F.lit(0)) if places else F.lit(0)


def symbol_score(name: Column, kind: Column, query: Query) -> Column:
    """How well a symbol answers by its name and kind; zero if any part is not met."""
    low, low_kind = query.fold(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    ok = F.lit(True)
    if query.kinds:
        hit = F.lit(False)
        for k in query.kinds:
            hit = hit | F.contains(low_kind, F.lit(k)) | low.endswith(k)
        ok = ok & hit
    if query.pattern:
        ok = ok & F.coalesce(name, F.lit("")).rlike(query.pattern)
    for x in query.negatives:
        ok = ok & ~F.contains(low, F.lit(x))
    for x in query.phrases:
        ok = ok & F.contains(low, F.lit(x))
    if not query.terms:
        return F.when(ok & F.lit(bool(query.pattern or query.phrases or query.kinds)), F.lit(ANY_SYMBOL)).otherwise(0.0)
    owns = [F.when(low == t, F.lit(WHOLE_SYMBOL)).otherwise(_first_hit(occurrence(low, t, IN_SYMBOL), fuzzy(F.coalesce(name, F.lit("")), t, query.case))) for t in query.terms]
    return F.when(ok, _all(owns, lambda xs: F.aggregate(xs, F.lit(0.0), lambda n, x: n + x))).otherwise(0.0)


#: Most ranges that are marked in a text, as many as the views show.
MAX_RANGES = 400


def merge_ranges(ranges: Column) -> Column:
    """Ranges (start, stop) in order, touching and overlapping ones joined."""

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], r["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (r["start"] <= F.try_element_at(acc, F.lit(-1))["stop"]), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<start:int,stop:int>>"), step)


_RANGES = "array<struct<start:int,stop:int>>"
#: Characters that stand in no text (Unicode keeps them free): around hits, and in place of those two.
_LEFT, _RIGHT, _FREE = "\ufdd0", "\ufdd1", "\ufdd2"


def _places(marked: Column) -> Column:
    """Ranges between marks, in the text without them; the first ``MAX_RANGES`` that are not empty."""

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        hit = acc["inside"] & (piece != "") & (F.size(acc["found"]) < MAX_RANGES)
        grown = F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), end.alias("stop"))))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(hit, grown).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(_RANGES).alias("found"))
    return F.aggregate(F.split(marked, f"[{_LEFT}{_RIGHT}]"), start, step, lambda a: a["found"])


def highlight(text: Column, query: Query) -> Column:
    """Ranges of the text that pattern, phrases and terms of the query match, joined where they touch."""
    plain = F.translate(text, _LEFT + _RIGHT, _FREE * 2)
    mark = lambda hay, rx: _places(F.regexp_replace(hay, F.lit(rx), F.lit(f"{_LEFT}$0{_RIGHT}")))
    literal = lambda w: "".join("\\" + c if not (c.isalnum() or c.isspace()) else c for c in w)
    found = [mark(plain, query.pattern)] if query.pattern else []
    found += [mark(query.fold(plain), literal(w)) for w in (*query.phrases, *query.terms) if w]
    return merge_ranges(F.slice(F.flatten(F.array(*found)), 1, MAX_RANGES)) if found else F.array().cast(_RANGES)


def line_at(text: Column, place: Column) -> Column:
    """The line (1 for the first) of a place (1 for the first character); no place is the top."""
    before = F.left(text, F.greatest(place - 1, F.lit(0)))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (path, token, tf) and sizes (path, n_tokens), written once."""
    postings = documents.select("path", F.explode(C.tokens(F.col("text"))).alias("token")).groupBy("path", "token").agg(F.count(F.lit(1)).alias("tf"))
    postings = stage(postings, "postings")
    return postings, postings.groupBy("path").agg(F.sum("tf").alias("n_tokens"))


def tfidf(documents: DataFrame, terms: list[str], most: int = 10) -> DataFrame:
    """path, score: sum of tf over root length times ln(1 + N / df), scaled by the share of terms found.

    Only the asked terms' counts leave a document's row; no index is written.
    """
    asked = [t.lower() for t in dict.fromkeys(terms)]
    words = C.let(C.tokens(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.array(*(F.size(F.filter(w, lambda x: x == t)).cast("long") for t in asked)).alias("tf")))  # noqa: B023
    rows = stage(documents.select("path", words.alias("w")).select("path", F.col("w.n").alias("n_tokens"), "w.tf"), "hits")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("tf")[k] > 0).alias(f"df{k}") for k in range(len(asked))))
    sums, found = F.lit(0.0), F.lit(0)
    for k, t in enumerate(asked):
        hit = F.col("tf")[k] > 0
        sums = sums + F.when(hit, terms.count(t) * F.col("tf")[k] / F.sqrt("n_tokens") * F.ln(1 + F.try_divide(F.col("n"), F.col(f"df{k}")))).otherwise(0.0)
        found = found + F.when(hit, terms.count(t)).otherwise(0)
    scored = rows.join(F.broadcast(facts)).where(F.exists("tf", lambda x: x > 0))
    return scored.select("path", F.round(sums * found / len(terms), 6).alias("score")).orderBy(F.desc("score"), "path").limit(most)


def strict(documents: DataFrame, gate: Column, query: Query, most: int | None = 50) -> DataFrame:
    """Documents through the gate whose text or path answers, by the sum of both scores; all of them without ``most``."""
    path, content = path_score(F.col("path"), query), content_score(F.col("text"), query)
    place = content_place(F.col("text"), query)
    out = documents.where(gate).select("path", "text", F.round(path, 4).alias("path_score"), F.round(content, 4).alias("content_score"))
    out = out.where((F.col("path_score") != 0) | (F.col("content_score") != 0)).withColumn("score", F.round(F.col("path_score") + F.col("content_score"), 4))
    if most is not None:
        out = out.orderBy(F.desc("score"), "path").limit(most)
    at = F.when(F.col("content_score") != 0, place).otherwise(0)
    return out.select("path", "path_score", "content_score", "score", line_at(F.col("text"), at).alias("line"), snippet_at(F.col("text"), at).alias("snippet"))


def search(documents: DataFrame, query: Query, most: int = 15) -> DataFrame:
    """path, score, line, snippet of the best ``most`` documents (a report).

    Words alone are ranked by tf-idf and need not all occur; whatever else is asked for
    is enforced.  An empty query, a query with an error, and one for kinds of symbols
    alone have no answer among texts.
    """
    nothing = documents.sparkSession.createDataFrame([], "path string, score double, line long, snippet string")
    if query.error or (query.empty and not query.filters) or (query.empty and query.kinds):
        return nothing
    if query.advanced:
        return strict(documents, gate(F.col("path"), query), query, most).select("path", "score", "line", "snippet")
    ranked = stage(tfidf(documents, list(query.terms), most), "ranked")
    place = content_place(F.col("text"), query)
    shown = documents.join(F.broadcast(ranked), "path").select("path", "score", "text", place.alias("place"))  # at most ``most`` rows
    whole = C.js_trim(F.get(F.split("text", "\n"), (line_at(F.col("text"), F.col("place")) - 1).cast("int")))
    snippet = F.when(F.col("place") == 0, "").when(F.length(whole) > 120, F.concat(F.left(whole, F.lit(117)), F.lit("…"))).otherwise(whole)
    return shown.select("path", "score", line_at(F.col("text"), F.col("place")).alias("line"), snippet.alias("snippet"))


def search_total(documents: DataFrame, query: Query) -> DataFrame:
    """total: how many documents answer an enforced query, however many are shown."""
    if query.error or not query.advanced or (query.empty and query.kinds):
        return documents.sparkSession.createDataFrame([(0,)], "total long")
    return strict(documents, gate(F.col("path"), query), query, None).agg(F.count(F.lit(1)).alias("total"))


def symbols_of(found: DataFrame) -> DataFrame:
    """path, name, symbol, kind, line: each name of a file once.

    Declarations with a line win over exports; classes come before functions, whose
    shown name ends in brackets.  found: rows of statements.
    """
    own = found.where("kind in ('class', 'function', 'export')")
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).otherwise(2)
    kind = F.when(F.col("kind") == "export", F.concat(F.lit("export "), "detail")).when(F.col("kind") == "function", F.when(F.col("detail") == "pub", "function").otherwise(F.col("detail"))).otherwise("class")
    line = F.when(F.col("kind") != "export", F.col("line"))
    shown = F.when(F.col("kind") == "function", F.concat("name", F.lit("()"))).otherwise(F.col("name"))
    first = own.select("path", F.col("name").alias("symbol"), F.struct(rank.alias("rank"), F.col("at").alias("at"), shown.alias("name"), kind.alias("kind"), line.alias("line")).alias("s"))
    return first.groupBy("path", "symbol").agg(F.min("s").alias("s")).select("path", "s.name", "symbol", "s.kind", "s.line")


def palette(files: DataFrame, symbols: DataFrame, query: Query) -> DataFrame:
    """type, path, name, score, line of all files and symbols that answer, of files through the gate."""
    if query.error or (query.empty and not query.filters):
        return files.sparkSession.createDataFrame([], "type string, path string, name string, score double, line int")
    through = files.where(gate(F.col("path"), query)).select("path")
    named = through.select(F.lit("file").alias("type"), "path", F.lit("").alias("name"), path_score(F.col("path"), query).alias("score"), F.lit(None).cast("int").alias("line"))
    declared = symbols.where(gate(F.col("path"), query)).select(F.lit("symbol").alias("type"), "path", "name", symbol_score(F.col("name"), F.col("kind"), query).alias("score"), "line")
    return named.unionByName(declared).where("score > 0").withColumn("score", F.round("score", 4))
