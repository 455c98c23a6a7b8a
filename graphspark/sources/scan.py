"""Scans of source trees: languages, ignore rules, hashes, size caps.

A scan is a table of entries (path, kind, size, modified_at and, for files, content) that rules
are applied to by joins: a folder that is ignored takes everything below it with it, and a line
of an ignore file is joined to what lies below its folder.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, by name and by interpreter.
EXTENSIONS = {
    "go": ".go .mod .sum",
    "javascript": ".js .jsx .mjs .cjs .ejs",
    "typescript": ".ts .tsx .mts .cts",
    "swift": ".swift",
    "python": ".py",
    "java": ".java",
    "kotlin": ".kt .kts",
    "scala": ".scala .sc",
    "rust": ".rs",
    "ruby": ".rb .podspec",
    "php": ".php",
    "c": ".c .h",
    "cpp": ".cc .cpp .hpp .hh",
    "csharp": ".cs",
    "fsharp": ".fs .fsx",
    "visual-basic": ".vb",
    "dart": ".dart",
    "elixir": ".ex .exs",
    "erlang": ".erl .hrl",
    "clojure": ".clj .cljs .cljc",
    "lua": ".lua .luau",
    "r": ".r",
    "objective-c": ".m .mm",
    "perl": ".pl .pm",
    "groovy": ".groovy .gradle",
    "solidity": ".sol",
    "shell": ".sh .bash .zsh",
    "powershell": ".ps1 .psm1",
    "sql": ".sql",
    "yaml": ".yaml .yml",
    "json": ".json",
    "toml": ".toml",
    "xml": ".xml",
    "html": ".html .htm",
    "vue": ".vue",
    "astro": ".astro",
    "svelte": ".svelte",
    "css": ".css .scss .sass",
    "markdown": ".md .mdx",
    "documentation": ".rst .adoc .asciidoc",
    "text": ".txt",
    "pdf": ".pdf",
    "document": ".docx .odt .rtf",
    "terraform": ".tf .tfvars .hcl",
    "protobuf": ".proto",
    "graphql": ".graphql .gql",
}
BASENAMES = {"Dockerfile": "dockerfile", "Makefile": "make", "Brewfile": "ruby"}
INTERPRETERS = {
    "javascript": "node nodejs deno bun",
    "shell": "sh bash zsh dash ksh fish",
    "ruby": "ruby",
    "php": "php",
    "perl": "perl",
    "powershell": "pwsh powershell",
    "lua": "lua luajit",
    "elixir": "elixir",
}
ENV_ARGUMENT = ("-u", "--unset", "-C", "--chdir", "-P", "--path")
# Folders and files that are never read.
IGNORED_DIRS = (
    ".git", "node_modules", "vendor", "Pods", "DerivedData", ".build", "dist", "coverage", ".next", ".nuxt", "target", ".idea", ".vscode",
    "venv", ".venv", "env", ".env", "__pycache__", "out", "site-packages", "lib64", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs",
    "lcov-report", "visual-tests", "visual-test", "__snapshots__", "storybook-static", "dist-protected",
    ".turbo", ".angular", ".cache", ".parcel-cache", ".svelte-kit", ".terraform", ".serverless", ".worktrees",
)
SENSITIVE_DIRS = (".ssh", ".aws", ".gcloud", "secrets", "credentials")
SENSITIVE_WORDS = ("credential", "credentials", "secret", "secrets", "apitoken", "accesstoken", "privatekey")
SENSITIVE_PAIRS = ("api token", "access token", "private key")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "poetry.lock", "gemfile.lock", "composer.lock", "go.sum", "go.work.sum")
KEY_FILES = (".pem", ".key", ".p8", ".der", ".crt", ".cer", ".p12", ".pfx", ".jks", ".keystore")
ENDINGS = {
    "binary image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico"),
    "binary video": (".mp4", ".mov", ".avi"),
    "archive": (".zip", ".tar", ".gz", ".tgz"),
    "database file": (".sqlite", ".db"),
}
#: Ignore files of a folder, in the order they are read.
IGNORE_FILES = (".gitignore", ".graphignore")
IGNORE_FILE_BYTES = 1 << 20

ENTRIES = "path string, kind string, size long, modified_at timestamp"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    flat = {word: name for name, words in table.items() for word in words.split()}
    return F.element_at(F.create_map(*[F.lit(x) for pair in flat.items() for x in pair]), key)


def shebang(content: Column) -> Column:
    """The language of the interpreter that the first line names."""
    line = F.regexp_extract(F.substring(content, 1, 256), r"\A#!([^\n]*)", 1)
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    # Behind env: flags, settings and the arguments of some flags are passed over.
    start = F.struct(F.lit("").alias("found"), F.lit(False).alias("skip"))

    def step(state: Column, word: Column) -> Column:
        passed = word.startswith("-") | word.contains("=")
        taken = (state["found"] == "") & ~state["skip"] & ~passed
        return F.struct(F.when(taken, word).otherwise(state["found"]).alias("found"), ((state["found"] == "") & ~state["skip"] & word.isin(*ENV_ARGUMENT)).alias("skip"))

    first = basename(F.coalesce(F.get(words, F.lit(0)), F.lit("")))
    behind = F.aggregate(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), start, step)["found"]
    program = F.regexp_replace(F.when((first == "env") & (behind != ""), basename(behind)).otherwise(first), r"""^["']+|["']+$""", "")
    return F.when(program.startswith("python"), "python").otherwise(_lookup(INTERPRETERS, program))


def language(path: Column, content: Column | None = None) -> Column:
    """By extension, then name, then the interpreter of the first line; null where none is known."""
    name = basename(path)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    found = [_lookup(EXTENSIONS, extension), F.element_at(F.create_map(*[F.lit(x) for pair in BASENAMES.items() for x in pair]), name)]
    return F.coalesce(*found, *([shebang(content)] if content is not None else []))


def ignored_dir(path: Column) -> Column:
    """Why a folder is not entered, by its name and its parent's; null if it is."""
    name = basename(path)
    parent = F.when(F.size(F.split(path, "/")) > 1, F.element_at(F.split(path, "/"), -2)).otherwise("")
    return (
        F.when(F.lower(name).isin(*SENSITIVE_DIRS), "sensitive credential directory")
        .when(name.isin(*IGNORED_DIRS) | name.endswith("_venv") | name.endswith("_env") | name.endswith(".egg-info"), "default ignored directory")
        .when((name == "worktrees") & parent.startswith("."), "default ignored directory")
        .when(name.startswith(".") & name.endswith("_cache"), "cache directory")
    )


def sensitive(path: Column) -> Column:
    """Whether a file's name speaks of keys or secrets, as words or pairs of words."""
    words = F.filter(F.split(F.lower(basename(path)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.exists(words, lambda w: w.isin(*SENSITIVE_WORDS)) | F.exists(pairs, lambda p: p.isin(*SENSITIVE_PAIRS))


def ignored_file(path: Column) -> Column:
    """Why a file is not read, by its name; null if it is."""
    name = F.lower(basename(path))
    any_end = lambda ends: F.substring_index(name, ".", -1).isin(*[e[1:] for e in ends]) & name.contains(".")
    reason = (
        F.when((name == ".env") | name.startswith(".env."), "secret-like environment file")
        .when(name.isin(*LOCK_FILES), "generated dependency lockfile")
        .when(any_end(KEY_FILES), "secret-like key material")
        .when(sensitive(path), "sensitive credential filename")
        .when(name.endswith(".min.js"), "minified generated file")
        .when(name.endswith(".lock"), "lock file")
    )
    for why, ends in ENDINGS.items():
        reason = reason.when(any_end(ends), why)
    return reason


def glob_pattern(line: str) -> tuple[str, bool, bool] | None:
    """(pattern over paths below the file's folder, keep, folders only) of a line; None for blanks and comments."""
    text = line.removesuffix("\r").strip()
    if not text or text[0] == "#":
        return None
    literal = text[:2] in (r"\#", r"\!")
    keep = not literal and text[0] == "!"
    text = text[1:] if literal or keep else text
    folders = text.endswith("/")
    text = text.removesuffix("/")
    whole = "/" in text
    text = text.removeprefix("/")
    if not text:
        return None
    out = ""
    for part in re.findall(r"\*\*+/|\*\*+|\*|\?|\[[^\]]*\]|\\.|.", text, re.DOTALL):
        if part.startswith("**"):
            out += "(?:.*/)?" if part.endswith("/") else ".*"
        elif part in ("*", "?"):
            out += "[^/]*" if part == "*" else "[^/]"
        elif part[0] == "[" and len(part) > 1:
            out += "[" + re.sub(r"^!", "^", part[1:-1]) + "]"
        else:
            out += re.escape(part[-1])
    return ("^" if whole else "(?:^|/)") + out + "$", keep, folders


RULES = "base string, pattern string, keep boolean, folders boolean, rank string"


def ignore_rules(files: DataFrame) -> DataFrame:
    """Rules from ignore files (path, content): the folder they hold below, the pattern, and their rank.

    Of the rules that match, the last one read decides: those of deeper folders are read later.
    """

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                base, _, name = path.rpartition("/")
                for i, line in enumerate((content or "").split("\n")):
                    if (rule := glob_pattern(line)) is not None:
                        rows.append((base, *rule, f"{base.count('/') + bool(base):06d}/{IGNORE_FILES.index(name):02d}/{i:09d}"))
            yield pd.DataFrame(rows, columns=["base", "pattern", "keep", "folders", "rank"])

    own = files.filter(basename(F.col("path")).isin(*IGNORE_FILES)).filter(F.coalesce(F.length("content"), F.lit(0)) <= IGNORE_FILE_BYTES)
    return own.select("path", "content").mapInPandas(kernel, RULES)


def ancestors(path: Column) -> Column:
    """The folders above a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def git_ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths of entries (path, kind) that the last rule that matches them ignores."""
    below = entries.select("path", "kind", F.explode(ancestors(F.col("path"))).alias("base"))
    rest = F.when(F.col("base") == "", F.col("path")).otherwise(F.expr("substring(path, length(base) + 2)"))
    hit = below.join(rules, "base").filter(~F.col("folders") | (F.col("kind") == "dir")).filter(F.regexp_like(rest, F.col("pattern")))
    return hit.groupBy("path").agg(F.max_by("keep", "rank").alias("keep")).filter("NOT keep").select("path")


def within_total(files: DataFrame, most: int) -> DataFrame:
    """Files in walk order while their sizes fit; one too large is passed over, later ones may fit.

    Where all fit, which a sum tells, none is looked at.  Else one task streams over sizes in order.
    """
    if files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= most:
        return files

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = 0
        for frame in frames:
            fits = []
            for size in frame["size"]:
                fits.append(used + size <= most)
                used += size if fits[-1] else 0
            yield frame.loc[fits, ["path"]]

    order = files.select("path", "size", F.split("path", "/").alias("_order")).repartition(1).sortWithinPartitions("_order").select("path", "size")
    return files.join(order.mapInPandas(kernel, "path string"), "path", "left_semi")


def judge(entries: DataFrame, most_file: int = 1 << 20, most_total: int = 1 << 62) -> tuple[DataFrame, DataFrame]:
    """(files, ignored) from entries: path, kind (dir, file, link), size, modified_at, content.

    files: path, language, size, hash, modified_at.  ignored: path (folders end in a slash), reason.
    What lies in an ignored folder is in neither.
    """
    text = F.decode(F.col("content"), "ISO-8859-1") if dict(entries.dtypes)["content"] == "binary" else F.col("content")
    rules = ignore_rules(entries.filter("kind = 'file'").select("path", text.alias("content")))
    flagged = entries.join(git_ignored(entries, rules).withColumn("_git", F.lit(True)), "path", "left")
    by_name = F.when(F.col("kind") == "link", "symbolic link").when(F.col("kind") == "dir", ignored_dir(F.col("path"))).otherwise(ignored_file(F.col("path")))
    judged = flagged.withColumn("reason", F.coalesce(by_name, F.when(F.col("_git"), "gitignored"))).withColumn("language", language(F.col("path"), text))
    late = F.when(F.col("language").isNull(), "unsupported file type").when(F.col("size") > most_file, "over max file size")
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(F.col("kind") == "file", late)))
    shut = judged.filter("kind = 'dir' AND reason IS NOT NULL").select(F.col("path").alias("_above"))
    hidden = judged.select("path", F.explode(ancestors(F.col("path"))).alias("_above")).join(shut, "_above").select("path").distinct()
    seen = judged.join(hidden, "path", "left_anti")
    files = seen.filter("kind = 'file' AND reason IS NULL").select("path", "language", "size", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "modified_at")
    kept = within_total(files, most_total)
    named = F.when(F.col("kind") == "dir", F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    ignored = seen.filter("reason IS NOT NULL").select(named.alias("path"), "reason")
    over = files.join(kept.select("path"), "path", "left_anti").select("path", F.lit("over max total size").alias("reason"))
    return kept, ignored.unionByName(over)


def entries_of(spark: SparkSession, root: str) -> DataFrame:
    """The entries of a tree on a file system that all executors see, hidden ones too; contents are read by the executors."""
    top, rows = root.removeprefix("file://").rstrip("/"), []
    for folder, folders, names in os.walk(top):
        for name in (*folders, *names):
            whole = os.path.join(folder, name)
            info = os.lstat(whole)
            kind = "link" if os.path.islink(whole) else "dir" if name in folders else "file"
            rows.append((os.path.relpath(whole, top), kind, info.st_size, datetime.fromtimestamp(info.st_mtime, UTC)))

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(len(frame)):
                one = frame.iloc[i : i + 1].copy()
                content = None
                if one["kind"].iloc[0] == "file":
                    with open(os.path.join(top, one["path"].iloc[0]), "rb") as f:
                        content = f.read()
                one["content"] = pd.Series([content], index=one.index, dtype=object)
                yield one

    return spark.createDataFrame(rows, ENTRIES).mapInPandas(kernel, ENTRIES + ", content binary")


def scan(spark: SparkSession, root: str, most_file: int = 1 << 20, most_total: int = 1 << 62) -> tuple[DataFrame, DataFrame]:
    """(files, ignored) of a tree; a tree inside a folder of credentials is not read at all."""
    held = [p for p in root.removeprefix("file://").split("/") if p.lower() in SENSITIVE_DIRS]
    if held:
        none = spark.createDataFrame([], ENTRIES + ", content binary")
        return judge(none, most_file)[0], spark.createDataFrame([(".", "inside sensitive credential directory")], "path string, reason string")
    return judge(entries_of(spark, root), most_file, most_total)


def reuse_hashes(found: DataFrame, before: DataFrame) -> DataFrame:
    """(path, size, modified_at, hash): the earlier hash where size and time are the same, null where content must be read."""
    old = before.select("path", F.col("size").alias("_s"), F.col("modified_at").alias("_m"), F.col("hash").alias("_h"))
    same = (F.col("size") == F.col("_s")) & (F.col("modified_at") == F.col("_m"))
    return found.join(old, "path", "left").select("path", "size", "modified_at", F.when(same, F.col("_h")).alias("hash"))
