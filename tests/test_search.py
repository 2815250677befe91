"""Search scores by plain computation of the same rules."""

import re

from pyspark.sql import functions as F

from sparkloom.operators import search as S


def occurrence(hay, needle, weight):
    at = hay.find(needle)
    if at < 0:
        return 0.0
    bonus = 0.6 * weight if at == 0 else 0.35 * weight if re.match("[^a-z0-9]", hay[at - 1]) else 0.0
    return weight - at + bonus + (1.2 * weight if hay == needle else 0.0)


def fuzzy(needle, raw):
    low, at, run, first, score = raw.lower(), 0, 0, None, 0.0
    for k, c in enumerate(needle):
        found = low.find(c, at)
        if found < 0:
            return 0.0
        first = found if first is None else first
        run = run + 1 if k and found == at else 0
        score += 10 + 6 * run
        if found == 0:
            score += 14
        elif re.match("[^a-z0-9]", low[found - 1]):
            score += 12
        elif re.match("[a-z0-9]", raw[found - 1]) and re.match("[A-Z]", raw[found]):
            score += 10
        at = found + 1
    return max(1.0, score - first - 0.4 * max(0, len(raw) - len(needle)))


PATHS = ["src/router.js", "src/pages/reductionTable.js", "lib/myRouter.ts", "router.js", "a/b/c/rt", "x", "src/deep/er/Readme.md", "rOuTer"]


def test_fuzzy(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    for needle in ("rt", "router.js", "srt", "z", "r", "mr"):
        got = {r.p: r.s for r in df.select("p", S.fuzzy(F.col("p"), needle).alias("s")).collect()}
        assert all(abs(got[p] - fuzzy(needle, p)) < 1e-9 for p in PATHS), needle


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")

    def plain(path, q):
        low, base, score = path.lower(), path.split("/")[-1], 0.0
        for x in q.phrases:
            if x not in low:
                return 0.0
            score += occurrence(low, x, 90.0)
        if q.pattern:
            if not re.search(q.pattern, path):
                return 0.0
            score += 80
        for t in q.terms:
            own = 320.0 if base.lower() == t else occurrence(base.lower(), t, 150.0) or occurrence(low, t, 70.0) or fuzzy(t, base) or fuzzy(t, path)
            if not own:
                return 0.0
            score += own
        if not q.terms:
            return score or 1.0
        adjusted = score - 0.5 * len(path.split("/"))
        return (adjusted if adjusted > 0 else 0.5) if score else 0.0

    for q in (S.Query(), S.Query(("rt",)), S.Query(("router.js",)), S.Query(("src", "rt")), S.Query(phrases=("src/",)), S.Query(("r",), ("r",), r"\.js$"), S.Query(pattern="^src")):
        got = {r.p: r.s for r in df.select("p", S.path_score(F.col("p"), q).alias("s")).collect()}
        assert all(abs(got[p] - plain(p, q)) < 1e-9 for p in PATHS), (q, got)


def test_texts_and_symbols(spark):
    df = spark.createDataFrame([("The cat sat.", "theCat", "function"), ("dog", "Dog", "class"), ("", None, None)], "text string, name string, kind string")
    text = lambda q: [r.s for r in df.select(S.content_score(F.col("text"), q).alias("s")).collect()]
    assert text(S.Query(("cat",))) == [occurrence("the cat sat.", "cat", 60.0), 0.0, 0.0]
    assert text(S.Query(("cat", "zebra"))) == [0.0, 0.0, 0.0] and text(S.Query(pattern="d.g")) == [0.0, 100.0, 0.0]
    symbol = lambda q: [r.s for r in df.select(S.symbol_score(F.col("name"), F.col("kind"), q).alias("s")).collect()]
    assert symbol(S.Query(("dog",))) == [0.0, 240.0, 0.0] and symbol(S.Query(kinds=("func",))) == [60.0, 0.0, 0.0]
    assert symbol(S.Query(("tc",)))[0] == fuzzy("tc", "theCat") and symbol(S.Query(("cat",), negatives=("the",))) == [0.0, 0.0, 0.0] and symbol(S.Query()) == [0.0, 0.0, 0.0]


def test_marks(spark):
    df = spark.createDataFrame([("abc ABCabc x",), ("",), ("none",)], "t string")
    got = [[tuple(m) for m in r.m] for r in df.select(S.highlight(F.col("t"), S.Query(("abc", "c x"), ("b",))).alias("m")).collect()]
    assert got == [[(0, 3), (4, 12)], [], []]
