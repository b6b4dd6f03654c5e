"""File scans, manifests and what changed between two of them; text sources of graph nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import checked_broadcast

#: Extensions of each language, of documents and of configuration: fixed values. Configuration may have a language too.
LANGUAGES = {
    "rust": "rs", "python": "py pyw", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "go": "go", "java": "java", "c": "c h",
    "cpp": "cpp cc cxx hpp hxx", "csharp": "cs", "hcl": "tf tfvars hcl", "yaml": "yml yaml", "ruby": "rb", "php": "php", "swift": "swift",
    "scala": "scala", "lua": "lua luau", "zig": "zig", "dart": "dart", "groovy": "groovy gradle", "elixir": "ex exs", "erlang": "erl hrl",
    "haskell": "hs", "julia": "jl", "bash": "sh bash", "r": "r", "powershell": "ps1 psm1", "fortran": "f f90 f95 f03 f08", "verilog": "v", "systemverilog": "sv",
}
DOCUMENTS = "md mdx qmd txt rst"
CONFIGURATION = "json yaml yml toml ini"
SKIPPED = r"(^|/)(\.git|node_modules|target|dist|build|__pycache__|\.venv|\.ssh|\.gnupg|\.aws)(/|$)"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, mtime, size, content_hash) below a folder, without skipped parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(~F.col("path").rlike(SKIPPED)).select(F.col("path").alias("file_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


def classified(files: DataFrame) -> DataFrame:
    """file_type (code, document, config or other) and language by extension, whatever its case; no known extension is other."""
    ext = F.lower(F.regexp_extract(F.element_at(F.split("file_path", "/"), -1), r"[^.]\.([A-Za-z0-9]+)$", 1))
    of = {e: language for language, own in LANGUAGES.items() for e in own.split()}
    language = F.try_element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), ext)
    kind = F.when(ext.isin(DOCUMENTS.split()), "document").when(ext.isin(CONFIGURATION.split()), "config").when(language.isNotNull(), "code").otherwise("other")
    return files.withColumn("file_type", F.coalesce(kind, F.lit("other"))).withColumn("language", language)


def ignore_rules(lines: DataFrame) -> DataFrame:
    """(folder, position, pattern, negated, only_folders) from the lines (folder, position, line) of ignore files.

    ``folder`` is where the file stands ('' for the root). Blank lines and comments are no rules. A pattern with a slash before its
    end holds from its folder, any other at every depth below; ``**`` spans folders, ``*`` and ``?`` don't. The
    pattern is a regular expression over a path below the folder.
    """
    line = F.regexp_replace(F.regexp_replace("line", r"\r$", ""), r"(?<!\\)\s+$", "")
    rows = lines.select("folder", "position", line.alias("l")).where("l != '' AND NOT startswith(l, '#')")
    rows = rows.select("folder", "position", F.startswith("l", F.lit("!")).alias("negated"), F.regexp_replace("l", r"^!|^\\(?=[#!])", "").alias("l"))
    rows = rows.select("folder", "position", "negated", F.endswith("l", F.lit("/")).alias("only_folders"), F.regexp_replace("l", "/$", "").alias("l")).where("l != ''")
    body = F.regexp_replace(F.regexp_replace("l", "^/", ""), r"([.+(){}^$|])", r"\\$1")
    for glob, regex in ((r"\*\*/", "\u0001"), (r"/\*\*$", "/\u0002"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".+")):
        body = F.regexp_replace(body, glob, regex)
    body = F.regexp_replace(body, r"\[!", "[^")
    start = F.when(F.contains("l", F.lit("/")), "^").otherwise("^(?:.*/)?")
    return rows.select("folder", "position", F.concat(start, body, F.lit("$")).alias("pattern"), "negated", "only_folders")


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (file_path and others, paths relative to the root) without those that ``rules`` leave out.

    Of the rules that fit a path the one of the deepest folder decides, in one file the last; a negated rule lets it in again. What
    lies in a folder that is left out stays out, whatever rules say of it. A path meets the rules of the folders above it
    only, by an equi-join on the folder.
    """
    parts = F.split("file_path", "/")
    depth = F.sequence(F.lit(1), F.size(parts))
    each = files.select("file_path").distinct().select("file_path", F.explode(F.transform(depth, lambda n: F.struct(n.alias("n"), (n < F.size(parts)).alias("is_folder")))).alias("x"))
    each = each.select("file_path", "x.n", "x.is_folder", F.slice(F.split("file_path", "/"), F.lit(1), F.col("x.n")).alias("p"))
    above = each.select("file_path", "n", "is_folder", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("p", F.lit(1), k), "/").alias("folder"), F.array_join(F.slice("p", k + 1, F.col("n") - k), "/").alias("rest")))).alias("y"))
    fits = above.select("file_path", "n", "is_folder", "y.*").join(checked_broadcast(rules), "folder").where(F.regexp_like("rest", F.col("pattern")) & (F.col("is_folder") | ~F.col("only_folders")))
    last = fits.groupBy("file_path", "n").agg(F.max_by("negated", F.struct("k", "position")).alias("negated"))
    out = last.where("NOT negated").select("file_path").distinct()
    return files.join(out, "file_path", "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str = "file_path", content: str = "content_hash") -> DataFrame:
    """(key, change): new, changed, unchanged or deleted."""
    o, n = old.select(key, F.col(content).alias("old"), F.lit(True).alias("before")), new.select(key, F.col(content).alias("new"), F.lit(True).alias("after"))
    kind = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("unchanged")
    return o.join(n, key, "full").select(key, kind.alias("change"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change) from manifests (file_path, size, mtime, content_hash): equal size and mtime are unchanged, else the hash decides.

    A null proves nothing: only values that both sides have can be equal.
    """
    o = old.select("file_path", F.struct("size", "mtime").alias("o"), F.col("content_hash").alias("oh"), F.lit(True).alias("before"))
    n = new.select("file_path", F.struct("size", "mtime").alias("n"), F.col("content_hash").alias("nh"), F.lit(True).alias("after"))
    equal = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    same = (equal("o.size", "n.size") & equal("o.mtime", "n.mtime")) | equal("oh", "nh")
    kind = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return o.join(n, "file_path", "full").select("file_path", kind.alias("change"))


def upserted(manifest: DataFrame, rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """The manifest (file_path and others) after rows took the place of those with their paths and deleted paths went."""
    keys = rows.select("file_path").union(deleted.select("file_path")).distinct()
    return manifest.join(keys, "file_path", "left_anti").unionByName(rows.join(deleted, "file_path", "left_anti"))


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line, level, title) of Markdown headings."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    found = F.regexp_extract("l", r"^(#{1,6})\s+(.*)$", 1)
    return lines.select("doc_id", "line", F.length(found).alias("level"), F.trim(F.regexp_extract("l", r"^(#{1,6})\s+(.*)$", 2)).alias("title")).where("level > 0")


def commit_refs(log: DataFrame) -> DataFrame:
    """(commit, issue, kind) from commit messages: fixes / closes / resolves, or a mention."""
    pattern = r"(?i)(?:(fix(?:es|ed)?|close[sd]?|resolve[sd]?)\s+)?#([0-9]+)"
    each = log.select("commit", F.explode(F.arrays_zip(F.regexp_extract_all("message", F.lit(pattern), 1).alias("verb"), F.regexp_extract_all("message", F.lit(pattern), 2).alias("issue"))).alias("x"))
    return each.select("commit", F.col("x.issue").cast("long").alias("issue"), F.when(F.col("x.verb") == "", "mentions").otherwise("resolves").alias("kind")).distinct()


def links(pages: DataFrame) -> DataFrame:
    """Distinct (page_id, target) of href attributes."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("target")).distinct()
