"""Documentation rows and texts from facts, and texts of the agreed form back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.code import js_trim, let

#: A file with so many importers is a hub.  Fixed value.
HUB = 5


def doc_rows(facts: DataFrame) -> DataFrame:
    """node, name, fan_in, fan_out, role (entry, hub, module) and functions of every file; facts may lack functions."""
    names = F.col("functions") if "functions" in facts.columns else F.array().cast("array<string>")
    role = F.when(F.col("is_entry"), "entry").when(F.col("fan_in") >= HUB, "hub").otherwise("module")
    return facts.select("node", "name", "fan_in", "fan_out", role.alias("role"), F.coalesce(names, F.array().cast("array<string>")).alias("functions"))


def facts_line(facts: DataFrame, looped: DataFrame) -> DataFrame:
    """node, line: what is worth knowing in a line; looped: nodes of cycles."""
    f = doc_rows(facts).join(looped.select("node", F.lit(True).alias("loop")), "node", "left")
    n = F.size("functions")
    line = F.concat_ws(
        " · ", F.when(F.col("role") == "entry", "entry"), F.when(F.col("fan_in") >= HUB, "hub"), F.when(F.col("loop"), "in a cycle"),
        F.concat(F.col("fan_in").cast("string"), F.lit(" in, "), F.col("fan_out").cast("string"), F.lit(" out")), F.when(n > 0, F.concat(n.cast("string"), F.lit(" functions"))),
    )
    return f.select("node", line.alias("line"))


def _counted(n: Column, what: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + what), F.when(n == 1, "").otherwise("s"))


def file_doc(facts: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """node, text: a sentence about a file's place, and its functions; hubs name their first ``most`` importers."""
    first = Window.partitionBy("dst").orderBy("src")
    near = edges.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).groupBy(F.col("dst").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ", ").alias("by"))
    f = doc_rows(facts).join(near, "node", "left")
    fin, fout = F.col("fan_in"), F.col("fan_out")
    place = (
        F.when(F.col("role") == "entry", F.concat(F.lit(" is an entry point with "), _counted(fout, "import"))).when(fin >= HUB, F.concat(F.lit(" carries "), _counted(fin, "importer"), F.lit(", such as "), "by"))
        .when((fin == 0) & (fout == 0), F.lit(" has no links")).when(fout == 0, F.concat(F.lit(" is a leaf with "), _counted(fin, "importer"))).when(fin == 0, F.concat(F.lit(" has "), _counted(fout, "import"), F.lit(" and no importer")))
        .otherwise(F.concat(F.lit(" has "), _counted(fout, "import"), F.lit(" and "), _counted(fin, "importer")))
    )
    n = F.size("functions")
    made = F.when(n > 0, F.concat(F.lit(" Functions: "), F.array_join(F.slice("functions", 1, 4), ", "), F.when(n > 4, F.concat(F.lit(" and "), (n - 4).cast("string"), F.lit(" more"))).otherwise(""), F.lit("."))).otherwise("")
    return f.select("node", F.concat("name", place, F.lit("."), made).alias("text"))


def folder_doc(facts: DataFrame, least: int = 3) -> DataFrame:
    """folder, text: how many files a folder holds, which of them most import (from ``least`` importers on), and its entries."""
    top = F.max_by(F.struct("name", "fan_in"), F.struct("fan_in", (-F.col("node")).alias("low")))
    out = facts.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), top.alias("top"), F.array_sort(F.collect_list(F.when(F.col("is_entry"), F.struct("node", "name")))).alias("ways"))
    text = F.concat_ws(
        " ", F.concat(_counted(F.col("n"), "file"), F.lit(".")), F.when(F.col("top.fan_in") >= least, F.concat(F.lit("Most imported: "), "top.name", F.lit(" ("), F.col("top.fan_in").cast("string"), F.lit(")."))),
        F.when(F.size("ways") > 0, F.concat(F.lit("Entries: "), F.array_join(F.transform("ways", lambda w: w["name"]), ", "), F.lit("."))),
    )
    return out.select("folder", text.alias("text"))


def write_doc(brief: Column, files: Column) -> Column:
    """The agreed text: a line for the folder and one for each file (array of name and text)."""
    one = lambda x: js_trim(F.regexp_replace(x, r"\s+", " "))
    lines = F.transform(F.filter(files, lambda f: one(f["text"]) != ""), lambda f: F.concat(F.lit("FILE: "), one(f["name"]), F.lit(": "), one(f["text"])))
    return F.array_join(F.concat(F.when(one(brief) != "", F.array(F.concat(F.lit("FOLDER: "), one(brief)))).otherwise(F.array().cast("array<string>")), lines), "\n")


def parse_doc(text: Column) -> Column:
    """Struct of brief and files (name, text) of such a text, in any case and with other lines between.

    Without a line for the folder the first two lines that are none of a file tell of it; of two lines for one file the later counts.
    """
    folder, file = r"(?i)^FOLDER:\s*(.+)$", r"(?i)^FILE:\s*([^:]+?):\s+(.+)$"
    def last_of(found: Column) -> Column:
        """The later of two lines for one file, in the place of the first: sorted by name, so no file is compared with all."""
        numbered = F.transform(found, lambda f, i: F.struct(f["name"].alias("name"), i.alias("i"), f["text"].alias("text")))

        def ends(s: Column) -> Column:
            first = F.filter(s, lambda f, i: (i == 0) | (f["name"] != F.get(s, i - 1)["name"]))
            last = F.filter(s, lambda f, i: (i == F.size(s) - 1) | (f["name"] != F.get(s, i + 1)["name"]))
            both = F.zip_with(first, last, lambda x, y: F.struct(x["i"].alias("i"), y["name"].alias("name"), y["text"].alias("text")))
            return F.transform(F.array_sort(both), lambda f: F.struct(f["name"].alias("name"), f["text"].alias("text")))

        return let(F.array_sort(numbered), ends)

    def of(lines: Column) -> Column:
        told = F.array_join(F.transform(F.filter(lines, lambda x: x.rlike(folder)), lambda x: F.trim(F.regexp_extract(x, folder, 1))), " ")
        rest = F.filter(lines, lambda x: ~x.rlike(folder) & ~x.rlike(file))
        found = F.transform(F.filter(lines, lambda x: ~x.rlike(folder) & x.rlike(file)), lambda x: F.struct(F.trim(F.regexp_extract(x, file, 1)).alias("name"), F.trim(F.regexp_extract(x, file, 2)).alias("text")))
        brief = let(told, lambda t: F.when(t != "", t).otherwise(F.array_join(F.slice(rest, 1, 2), " ")))
        return F.struct(brief.alias("brief"), last_of(found).alias("files"))

    return let(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), js_trim), lambda x: x != ""), of)
