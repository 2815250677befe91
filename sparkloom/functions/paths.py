"""Path algebra as Columns: forward slashes, no slash at either end, binary order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A path names a test if one of its parts, bounded by separators, is one of these words.  Fixed values.
TEST_PATH = r"(?i)(^|[._\-/])(test|tests|spec|specs|__tests__|__test__)([._\-/]|$)"
#: Directories that are never walked.  Fixed values.
SKIP_DIRS = (
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "out", ".next", ".nuxt", "target", "vendor", "__pycache__", ".venv", "venv", "env",
    ".idea", ".vscode", "coverage", ".cache", ".turbo", "tmp", "temp", "DerivedData", "Pods", ".gradle", "bin", "obj",
)
#: Files that are no source.  Fixed values.
SKIP_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "Cargo.lock", "poetry.lock", ".DS_Store")
#: Extensions that are no source.  Fixed values.
SKIP_EXTS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".icns", ".svg", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp4", ".mov", ".mp3",
    ".wav", ".zip", ".gz", ".tar", ".rar", ".7z", ".pdf", ".jar", ".war", ".class", ".o", ".a", ".so", ".dylib", ".dll", ".exe", ".pyc", ".wasm",
    ".min.js", ".min.css", ".map", ".lock", ".bin", ".db", ".sqlite",
)
#: Language of an extension.  Fixed values.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp",
    ".c": "generic", ".h": "generic", ".cpp": "generic", ".hpp": "generic", ".cc": "generic", ".rb": "generic", ".php": "generic",
}


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext_of(path: Column) -> Column:
    """Last suffix with its dot, in lower case; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]*)$", 1))


def depth_of(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def top_folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit("(root)")).otherwise(F.substring_index(path, "/", 1))


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def normalize(path: Column) -> Column:
    """Folds ``.`` and ``..``; a path never climbs above its root."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.get(F.map_values(F.create_map(*pairs)), F.array_position(F.map_keys(F.create_map(*pairs)), ext_of(path)).cast("int") - 1)


def skip_reason(path: Column, size: Column, max_size: int = 200 * 1024) -> Column:
    """Why a file is left out of a scan, or null; the first reason in the order of a scan."""
    parts = F.split(dir_of(path), "/")
    vendor = F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRS))) | F.exists(parts, lambda p: p.startswith("."))
    source = name_of(path).isin(*SKIP_FILES) | ext_of(path).isin(*SKIP_EXTS) | name_of(path).rlike(r"(?i)\.min\.(js|css)$")
    return F.when(vendor, "vendorDir").when(source, "notSource").when(language_of(path).isNull(), "notCode").when(size > max_size, "tooLarge")


def ancestors(path: Column) -> Column:
    """Every directory above a path, the root (empty) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def keeps(path: Column, text: str = "", tests: bool = True) -> Column:
    """Stage filter: a part of the path, tests or not."""
    out = F.lit(True) if tests else ~is_test(path)
    needle = text.strip().lower()
    return out & F.contains(F.lower(path), F.lit(needle)) if needle else out


def inside(path: Column) -> Column:
    """The folded path, or null if it climbs above its root on the way."""
    step = lambda acc, p: (
        F.when((p == "") | (p == ".") | (acc["depth"] < 0), acc)
        .when(p == "..", F.struct((acc["depth"] - 1).alias("depth"))).otherwise(F.struct((acc["depth"] + 1).alias("depth")))
    )
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("depth")), step, lambda a: a["depth"])
    return F.when(depth >= 0, normalize(path))
