"""Documents from files: whole files, directory walks with filters, and large files by line."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.find import is_binary

#: Named sets of file names.
TYPES = {
    "c": ("*.c", "*.h"), "cpp": ("*.cc", "*.cpp", "*.cxx", "*.hpp", "*.hh"), "csv": ("*.csv",), "go": ("*.go",), "html": ("*.html", "*.htm"),
    "java": ("*.java",), "js": ("*.js", "*.mjs"), "json": ("*.json", "*.jsonl"), "md": ("*.md", "*.markdown"), "py": ("*.py", "*.pyi"),
    "rust": ("*.rs",), "sh": ("*.sh", "*.bash"), "sql": ("*.sql",), "toml": ("*.toml",), "ts": ("*.ts", "*.tsx"), "txt": ("*.txt",), "xml": ("*.xml",), "yaml": ("*.yaml", "*.yml"),
}


def path_pattern(glob: str) -> str:
    """A pattern, for Java and Python, of the paths that a glob means: ``*`` and ``?`` stay in one part, ``**`` is any parts.

    A backslash takes the next character as it is; a set that isn't closed is a bracket.
    """
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif glob.startswith("**", k) and k + 2 == len(glob) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + ".+", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := glob.find("]", k + 2 + (glob[k + 1 : k + 2] in ("!", "^")))) > 0:
            inside = glob[k + 1 : end]
            negated = inside[:1] in ("!", "^")
            inside = re.sub(r"([\[\]\\^&])", r"\\\1", inside[negated:])
            out, k = out + f"(?!/)[{'^' if negated else ''}{inside}]", end + 1
        else:
            if c == "\\" and k + 1 < len(glob):
                k, c = k + 1, glob[k + 1]
            out, k = out + (c if c.isalnum() or c in "/_" else re.escape(c)), k + 1
    return out


def read_files(spark: SparkSession, path, globs: list[str] | None = None, types: list[str] | None = None, binary: bool = True, as_bytes: bool = False) -> DataFrame:
    """doc (path), text, content, bytes of each file under a path or list of paths, hidden ones left out.

    Globs match a file name, or with a slash the end of a path; a leading ! excludes; types are named sets. They
    choose among what lies under a folder: a file that ``path`` itself names is always read. Without ``binary`` a file
    with a NUL in its first 8 KiB is skipped. Names are filtered in the listing, before anything is read. With ``as_bytes``
    text is the content itself, and all line operators keep its bytes, be they UTF-8 or not.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = lambda p: re.sub("^[a-z]+:/*", "/", p)
    place = F.regexp_replace("path", "^[a-z]+:/*", "/")
    named = place.isin([plain(p) for p in ([path] if isinstance(path, str) else path)])
    keep = F.lit(True)
    for exclude in (False, True):
        own = [g.removeprefix("!") for g in globs or [] if g.startswith("!") == exclude]
        for t in [] if exclude else types or []:
            if t not in TYPES:
                raise ValueError(f"unknown type {t!r}; there are {sorted(TYPES)}")
            own += TYPES[t]
        if own:
            hit = F.lit(False)
            for g in own:
                hit = hit | F.rlike(place, F.lit(f"(?s)/{path_pattern(g.lstrip('/'))}$"))
            keep = keep & (~hit if exclude else hit)
    files = files.filter(keep | named)
    if not binary:
        files = files.filter(~is_binary(F.col("content")))
    return files.select(F.col("path").alias("doc"), (F.col("content") if as_bytes else F.col("content").cast("string")).alias("text"), "content", F.col("length").alias("bytes"))


def walk(root: str, max_depth: int | None = None, hidden: bool = False, ignore: bool = True, follow: bool = False) -> list[str]:
    """Paths of files under a local root in sorted order, for ``read_files``.

    ``ignore`` honours .gitignore files on the way; that needs the driver to list, and so local paths.
    """
    out: list[str] = []

    def down(folder: str, depth: int, rules: list[tuple[str, str]]) -> None:
        if ignore and os.path.isfile(f"{folder}/.gitignore"):
            with open(f"{folder}/.gitignore", encoding="utf-8", errors="replace") as f:
                rules = rules + [(folder, x) for x in (re.sub(r"(?<!\\)\s+$", "", y.rstrip("\r\n")) for y in f) if x and not x.startswith("#")]
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            if (not hidden and e.name.startswith(".")) or (e.is_symlink() and not follow) or _ignored(e, rules):
                continue
            if e.is_dir(follow_symlinks=follow):
                if max_depth is None or depth < max_depth:
                    down(e.path, depth + 1, rules)
            elif e.is_file(follow_symlinks=follow):
                out.append(e.path)

    if os.path.isfile(root):
        return [root]
    down(root, 1, [])
    return out


def _ignored(entry: os.DirEntry, rules: list[tuple[str, str]]) -> bool:
    """Whether the last rule that matches an entry ignores it. A rule with a slash within it starts at its own folder."""
    found = False
    for base, rule in rules:
        keep, rule = rule.startswith("!"), rule.removeprefix("!")
        folder_only, rule = rule.endswith("/"), rule.rstrip("/")
        if folder_only and not entry.is_dir():
            continue
        relative = os.path.relpath(entry.path, base)
        hit = re.fullmatch(path_pattern(rule.lstrip("/")), relative, re.S) if "/" in rule else re.fullmatch(path_pattern(rule), entry.name, re.S)
        found = not keep if hit else found
    return found


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc, text of each LF line, for files too large to be one value; splits follow the file system's blocks.

    The text source decompresses .gz, .bz2 and .zst by name. A CR stays on its line.
    """
    return spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
