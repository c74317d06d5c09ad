"""Project and chat files: scans with ignore rules and overrides, routing to topics, and proposed topics.

A listing has rows (path, length, modificationTime, content) as Spark's binaryFile source gives them, with path relative
to the project's root. Every rule is a column or a join, so a listing of any size is filtered where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.text import occurrences
from loreweave.operators.store import basename, stem

MOST_BYTES = 10 * 1024 * 1024
# Folders and files that hold no text of the project's own, and what is read.
SKIP_FOLDERS = [
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage", ".ruff_cache", ".mypy_cache",
    ".pytest_cache", ".cache", ".tox", ".nox", ".idea", ".vscode", ".ipynb_checkpoints", ".eggs", "htmlcov", "target",
]
SKIP_FILES = [".gitignore", "package-lock.json"]
READABLE = [".txt", ".md", ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".html", ".css", ".java", ".go", ".rs", ".rb", ".sh", ".csv", ".sql", ".toml"]
PROSE = [".txt", ".md", ".rst", ".csv"]
CHATS = [".txt", ".md", ".json", ".jsonl"]


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """The files below a folder, with paths relative to it. Links are what the file system says they are: Spark lists no link's target twice."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    root = F.lit(folder.rstrip("/").removeprefix("file://") + "/")
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.withColumn("path", F.when(path.startswith(root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def folders(path: Column) -> Column:
    """Every folder above a file, from the root's first one down."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def _glob(part: str) -> str:
    """One path part of an ignore rule as a regular expression."""
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "[" and "]" in part[i + 2 :]:
            end = part.index("]", i + 2)
            inside = part[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return out


def ignore_rules(text: str) -> list[tuple[int, str, bool, bool]]:
    """(position, regular expression over a path below the rule's folder, for folders only, takes back) of each rule of an ignore file."""
    rules = []
    for position, raw in enumerate(text.split("\n")):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        line = line[1:] if line[:2] in ("\\#", "\\!") else line
        back, line = line.startswith("!"), line.removeprefix("!")
        rooted, line = line.startswith("/"), line.lstrip("/")
        only_folders, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        parts = ["(?:[^/]+/)*" if p == "**" else _glob(p) + "/" for p in line.split("/")]
        # a rule with a slash is read from its folder on; any other holds for every part of a path
        start = "^" if rooted or "/" in line else "^(?:[^/]+/)*"
        rules.append((position, start + "".join(parts), only_folders, back))
    return rules


RULES = "base string, position int, pattern string, only_folders boolean, back boolean"


def rule_table(ignore_files: DataFrame) -> DataFrame:
    """(base, position, pattern, only_folders, back) of ignore files (path, content); base is their folder."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p.rpartition("/")[0], *rule) for p, c in zip(batch["path"], batch["content"], strict=True) for rule in ignore_rules(c or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RULES.split(", ")])

    return ignore_files.select("path", F.col("content").cast("string").alias("content")).mapInPandas(read, RULES)


def ignored_targets(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Those targets(target, is_folder) that the last matching rule of the folders above them ignores; deeper folders speak later."""
    above = targets.withColumn("base", F.explode(F.concat(F.array(F.lit("")), folders(F.col("target")))))
    below = F.when(F.col("base") == "", F.col("target")).otherwise(F.substring(F.col("target"), F.length("base") + 2, F.length("target")))
    parent = F.regexp_replace(below, "[^/]*$", "")
    # a rule for folders sees a file's folders only; a trailing slash ends every part
    seen = F.when(F.col("only_folders") & ~F.col("is_folder"), parent).otherwise(F.concat(below, F.lit("/")))
    hits = above.join(rules, "base").filter(F.regexp_like(seen, F.col("pattern")))
    verdict = hits.groupBy("target", "is_folder").agg(F.max_by("back", F.struct(F.length("base"), F.col("position"))).alias("back"))
    return verdict.filter(~F.col("back")).select("target", "is_folder")


def overrides(include: list[str]) -> list[str]:
    return sorted({p.strip().strip("/") for p in include if p.strip().strip("/")})


def forced(path: Column, include: list[str]) -> Column:
    """A path that is included, or lies below or above an included one."""
    kept = overrides(include)
    hit = [(path == p) | path.startswith(p + "/") | F.lit(p).startswith(F.concat(path, F.lit("/"))) for p in kept]
    return F.coalesce(*[F.when(h, True) for h in hit], F.lit(False))


def scan(files: DataFrame, rules: DataFrame | None = None, include: list[str] | None = None, suffixes: list[str] = READABLE) -> DataFrame:
    """The files of a listing that a project's miner reads: right suffix, not too large, in no skipped or ignored folder, not ignored.

    A file below a folder that is left out is out, whatever a deeper rule says. Included paths overrule all but the size;
    an included file itself needs no known suffix.
    """
    include, path = include or [], F.col("path")
    exact = path.isin(overrides(include) or [""])
    above = folders(path)
    unwanted = lambda f: basename(f).isin(SKIP_FOLDERS) | basename(f).endswith(".egg-info")
    out_of_way = F.exists(above, lambda f: ~forced(f, include) & unwanted(f))
    kept = files.filter((suffix(path).isin(suffixes) | exact) & (F.col("length") <= MOST_BYTES) & ~out_of_way & (forced(path, include) | ~basename(path).isin(SKIP_FILES)))
    if rules is None:
        return kept
    targets = kept.select(path.alias("target"), F.lit(False).alias("is_folder")).unionByName(kept.select(F.explode(above).alias("target"), F.lit(True).alias("is_folder"))).distinct()
    gone = ignored_targets(targets.filter(~forced(F.col("target"), include)), rules)
    files_of = kept.select("path", F.explode(F.concat(F.transform(above, lambda f: F.struct(f.alias("target"), F.lit(True).alias("is_folder"))), F.array(F.struct(path.alias("target"), F.lit(False).alias("is_folder"))))).alias("t")).select("path", "t.*")
    lost = files_of.join(gone, ["target", "is_folder"], "left_semi").select("path").distinct()
    return kept.join(lost, "path", "left_anti")


def scan_chats(files: DataFrame) -> DataFrame:
    """The files that may hold conversations."""
    path = F.col("path")
    clear = ~F.exists(folders(path), lambda f: basename(f).isin(SKIP_FOLDERS))
    return files.filter(suffix(path).isin(CHATS) & ~path.endswith(".meta.json") & (F.col("length") <= MOST_BYTES) & clear)


def samples(files: DataFrame, most: int = 10, characters: int = 5000, enough: int = 3) -> DataFrame:
    """path, sample: the first characters of up to `most` prose files, by path; with fewer than `enough` of them other readable files follow."""
    rows = files.withColumn("kind", F.when(suffix(F.col("path")).isin(PROSE), 0).when(suffix(F.col("path")).isin(READABLE), 1)).filter("kind is not null")
    rows = rows.filter(~F.exists(folders(F.col("path")), lambda f: basename(f).isin(SKIP_FOLDERS)))
    prose = rows.agg(F.count_if(F.col("kind") == 0).alias("prose"))
    usable = rows.join(F.broadcast(prose)).filter((F.col("kind") == 0) | (F.col("prose") < enough))
    return usable.orderBy("kind", "path").limit(most).select("path", F.substring(F.col("content").cast("string"), 1, characters).alias("sample"))


def route(path: Column, content: Column, rooms: list[tuple[str, list[str]]], first: int = 2000) -> Column:
    """The topic of a file: by a folder that equals, holds or is part of a topic's name or keyword, folder by folder; else by the file's
    name; else the topic whose name and keywords occur most in the first characters, the first declared on a tie; else 'general'."""
    low = F.lower(path)
    parts = F.split(low, "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    keys = [(name, [name.lower(), *[k.lower() for k in words]]) for name, words in rooms]
    alike = lambda p, c: p.contains(c) | F.lit(c).contains(p)

    def by_part(p: Column) -> Column:
        return F.coalesce(*[F.when(F.coalesce(*[F.when(alike(p, c), True) for c in cs], F.lit(False)), F.lit(n)) for n, cs in keys], F.lit(None).cast("string"))

    folder = F.get(F.array_compact(F.transform(above, by_part)), F.lit(0))
    name = F.lower(stem(path))
    by_name = F.coalesce(*[F.when(alike(name, n.lower()), F.lit(n)) for n, _ in rooms], F.lit(None).cast("string"))
    text = F.lower(F.substring(content, 1, first))
    scores = [(n, sum((occurrences(text, k.lower()) for k in [*words, n]), F.lit(0).cast("bigint"))) for n, words in rooms]
    top = F.greatest(*[s for _, s in scores], F.lit(0).cast("bigint"))
    by_text = F.when(top > 0, F.coalesce(*[F.when(s == top, F.lit(n)) for n, s in scores]))
    return F.coalesce(folder, by_name, by_text, F.lit("general"))


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[- ]", "_")


def rooms_of_folders(files: DataFrame, known: dict[str, str]) -> DataFrame:
    """name, folder: topics proposed by folders of the first two levels; those of the first level that aren't known give their own name.

    Of several folders for one topic the first level's, then the least, is named; 'general' is always proposed.
    """
    parts = F.split("path", "/")
    level = lambda i: files.filter(F.size(parts) > i + 1).select(F.get(parts, F.lit(i)).alias("folder"), F.get(parts, F.lit(0)).alias("top"), F.lit(i).alias("level")).distinct()
    rows = level(0).unionByName(level(1)).filter(~F.col("folder").isin(SKIP_FOLDERS) & ~F.col("top").isin(SKIP_FOLDERS))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.try_element_at(table, F.regexp_replace(F.lower("folder"), "-", "_"))
    own = F.when((F.col("level") == 0) & (F.length("folder") > 2) & F.col("folder").rlike("^[A-Za-z]"), _plain(F.col("folder")))
    rows = rows.select(F.coalesce(found, own).alias("name"), "folder", "level").filter("name is not null")
    best = rows.groupBy("name").agg(F.min(F.struct("level", "folder")).alias("b")).select("name", F.col("b.folder").alias("folder"))
    general = files.sparkSession.createDataFrame([("general", "")], "name string, folder string")
    return best.unionByName(general.join(best.select("name"), "name", "left_anti"))


def rooms_of_names(files: DataFrame, known: dict[str, str], least: int = 2, most: int = 6) -> DataFrame:
    """name, n: topics whose keywords occur in `least` file names or more, the most frequent first; each keyword counts."""
    plain = _plain(basename(F.col("path")))
    hits = F.array_compact(F.array(*[F.when(plain.contains(k), F.lit(r)) for k, r in known.items()]))
    counts = files.select(F.explode(hits).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(most)
