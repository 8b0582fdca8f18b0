"""Files as tables: text files with their bytes looked at, transcripts, golden sets."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bytes looked at, and the share of them (in a thousand) that may be unprintable.
PROBE, UNPRINTABLE = 8192, 300


#: Files, in any folder, that list what is passed over below it; the second one's word counts more.
IGNORE_FILES = (".gitignore", ".kbignore")


class Rule:
    """A line of an ignore file: * within a name, ** across folders; from its folder on if it has a slash, else anywhere below; folders only if it ends with one; ! takes back."""

    def __init__(self, line: str, folder: str):
        self.folder, self.takes_back = folder, line.startswith("!")
        body = line.removeprefix("!")
        self.folders_only = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        glob = re.escape(body.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        self.regex = re.compile(f"{re.escape(folder)}{'' if anchored else '(?:.*/)?'}{glob}")

    def fits(self, path: str, is_folder: bool) -> bool:
        return (is_folder or not self.folders_only) and self.regex.fullmatch(path) is not None


class Ignored:
    """Which paths ignore files pass over: of the rules that fit a path the last one counts, deeper folders after the ones above; what is in a folder that is passed over can't be taken back."""

    def __init__(self, lines: list[tuple[str, str, str]]):
        """lines: name of the ignore file, its folder below the root ("" or ending in a slash), and the line, in order."""
        rules = [(name, Rule(line, folder)) for name, folder, line in sorted(lines, key=lambda x: x[1].count("/"))]
        self.ranked = [[r for n, r in reversed(rules) if n == name] for name in reversed(IGNORE_FILES)]
        self.known: dict[str, bool] = {"": False}

    def _says(self, path: str, is_folder: bool) -> bool:
        hit = next((r for rules in self.ranked for r in rules if path.startswith(r.folder) and r.fits(path, is_folder)), None)
        return hit is not None and not hit.takes_back

    def _folder(self, folder: str) -> bool:
        if folder not in self.known:
            self.known[folder] = self._folder(folder.rpartition("/")[0]) or self._says(folder, True)
        return self.known[folder]

    def __call__(self, path: str) -> bool:
        return self._folder(path.rpartition("/")[0]) or self._says(path, False)


def ignore_lines(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """Name, folder and lines of all ignore files at a root and below; comments and empty lines are left out."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    found: list[tuple[str, str, str]] = []
    files = fs.listFiles(top, True)  # Spark's readers pass over hidden files
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() in IGNORE_FILES:
            stream = fs.open(path)
            lines = [x.strip() for x in jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()]
            stream.close()
            folder = path.toUri().getPath().removeprefix(base).rpartition("/")[0]
            found += [(path.getName(), f"{folder}/" if folder else "", x) for x in lines if x and not x.startswith("#")]
    return found


def walk(spark: SparkSession, root: str, glob: str = "*", ignore: list[str] = (), recursive: bool = True) -> DataFrame:
    """path, content, length of all files below root but hidden ones, those that the ignore files of its folders pass over, and those whose path below root fits an ignore pattern that is given (* and **)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(root)
    below = F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/').split('://')[-1])}/", "")
    found = files.select(below.alias("path"), "content", "length", "modificationTime").where(~F.col("path").rlike(r"(?:^|/)\."))
    for pattern in ignore:
        found = found.where(~F.col("path").rlike(_pattern(pattern)))
    lines = ignore_lines(spark, root)
    if not lines:
        return found

    def passed_over(paths: pd.Series) -> pd.Series:
        return paths.map(Ignored(lines))

    return found.where(~F.pandas_udf(passed_over, BooleanType())(F.col("path")))


def _pattern(glob: str) -> str:
    """A glob as in ignore files as a regular expression: * within a name, ** across folders; from the root only if it begins with a slash."""
    body = re.escape(glob.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*")
    return f"(?:^{'' if glob.startswith('/') else '|/'}){body}(?:/|$)"


def repository_files(files: DataFrame, url: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """source_id, revision_id, stable_location, path of the text files of a repository (path, content) that fit one of the globs to include (none: all) and none to exclude.

    A file's id hangs on the repository's address and its path, a revision's on the bytes.
    """
    kept = files.where(looks_like_text(F.col("content")))
    if include:
        kept = kept.where(F.col("path").rlike("|".join(map(_pattern, include))))
    for glob in exclude:
        kept = kept.where(~F.col("path").rlike(_pattern(glob)))
    location = F.concat(F.lit(f"git+{url}#"), "path")
    short = lambda prefix, c: F.concat(F.lit(prefix), F.left(F.sha2(c, 256), F.lit(12)))
    return kept.select(short("src-", location).alias("source_id"), short("rev-", F.col("content")).alias("revision_id"), location.alias("stable_location"), "path")


def looks_like_text(content: Column) -> Column:
    """No NUL, valid UTF-8 (a character cut at the probe's end aside), and not too much that can't be printed, in the first 8 KiB."""
    probe = F.substring(content, 1, PROBE)
    cut = F.octet_length(content) > PROBE
    whole = [F.is_valid_utf8(F.substring(probe, F.lit(1), F.octet_length(probe) - k).cast("string")) for k in range(4)]
    valid = whole[0] | (cut & (whole[1] | whole[2] | whole[3]))
    odd = F.length(F.regexp_replace(F.decode(probe, "ISO-8859-1"), r"[\t\n\f\r\x20-\x7e\x80-\xff]", ""))
    return (F.octet_length(content) == 0) | (~F.contains(F.decode(probe, "ISO-8859-1"), F.lit("\x00")) & valid & (odd * 1000 <= UNPRINTABLE * F.octet_length(probe)))


def markdown_pages(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """page_id (path below root) and body of all Markdown files; of those in the root alone if not recursive."""
    return walk(spark, root, "*.md", recursive=recursive).select(F.col("path").alias("page_id"), F.decode("content", "UTF-8").alias("body"))


def transcript_turns(bodies: DataFrame) -> DataFrame:
    """doc, turn, speaker, start_s, end_s, text of transcripts (doc, body) with headings ``## @id [HH:MM:SS → HH:MM:SS]``; notes in > [...] are left out."""
    rows = bodies.select("doc", F.posexplode(F.split("body", r"\r?\n")).alias("line", "text"))
    head = r"^## @([A-Za-z0-9_-]+) \[(\d{2}):(\d{2}):(\d{2}) (?:→|->) (\d{2}):(\d{2}):(\d{2})\]\s*$"
    order = Window.partitionBy("doc").orderBy("line")
    marked = rows.withColumn("_head", F.col("text").rlike(head)).withColumn("turn", F.sum(F.col("_head").cast("int")).over(order)).where("turn > 0 AND NOT text RLIKE '^> \\\\[.*\\\\]$'")
    part = lambda g: F.regexp_extract("text", head, g)
    seconds = lambda a: (part(a).cast("int") * 3600 + part(a + 1).cast("int") * 60 + part(a + 2).cast("int"))
    when = lambda c: F.max(F.when(F.col("_head"), c))
    safe = marked.withColumn("_speaker", F.when(F.col("_head"), part(1))).withColumn("_start", F.when(F.col("_head"), seconds(2))).withColumn("_end", F.when(F.col("_head"), seconds(5)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    return safe.groupBy("doc", "turn").agg(when(F.col("_speaker")).alias("speaker"), when(F.col("_start")).alias("start_s"), when(F.col("_end")).alias("end_s"), F.trim(F.regexp_replace(said, r"^\s+|\s+$", "")).alias("text"))


def roster(bodies: DataFrame) -> DataFrame:
    """doc, speaker, name, role of the lines ``- @id: Name (role)``."""
    rows = bodies.select("doc", F.explode(F.split("body", r"\r?\n")).alias("text"))
    line = r"^- @([A-Za-z0-9_-]+): (.*?)(?: \(([^)]*)\))?\s*$"
    return rows.where(F.col("text").rlike(line)).select("doc", F.regexp_extract("text", line, 1).alias("speaker"), F.regexp_extract("text", line, 2).alias("name"), F.nullif(F.regexp_extract("text", line, 3), F.lit("")).alias("role"))


def golden_set(spark: SparkSession, toml: str) -> DataFrame:
    """query_id, query, expected of a golden set; ids must differ, no query may be empty, each must expect something."""
    rows = [(q["id"], q["query"], [*q.get("expected_sources", []), *q.get("expected_concepts", [])]) for q in tomllib.loads(toml).get("query", [])]
    if not rows or len({r[0] for r in rows}) < len(rows) or any(not r[0].strip() or not r[1].strip() or not r[2] for r in rows):
        raise ValueError("a golden set needs queries with different ids, a text and something expected")
    return spark.createDataFrame(rows, "query_id string, query string, expected array<string>")
