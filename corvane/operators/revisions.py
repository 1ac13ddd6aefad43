"""Two revisions of files: change lists, what differs, rendered patches; refs and stored objects."""

from __future__ import annotations

import difflib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.filters import is_binary_blob
from corvane.operators.select import changed_lines

#: Most lines of a difference that are shown (fixed value).
SHOWN_LINES = 5000
#: NUL-separated records (fixed formats): a rename or a copy has two paths. Each record begins where the last one ended.
_STATUS_RECORD = r"\G[\s\x00]*([RC][^\x00]*\x00[^\x00]+\x00[^\x00]+|[^RC\s\x00][^\x00]*\x00[^\x00]+)(?:\x00|$)"
_NUMSTAT_RECORD = r"\G[\s\x00]*([^\t\x00]*\t[^\t\x00]*\t(?:[^\x00]+|\x00[^\x00]*\x00[^\x00]+))(?:\x00|$)"


def parse_name_status(raw: DataFrame) -> DataFrame:
    """(commit, value) of NUL-separated status records -> (commit, path, old_path, status); old_path is null but for renames and copies.

    A record that the end of the value cuts is left out.
    """
    each = raw.select("commit", F.explode(F.regexp_extract_all("value", F.lit(_STATUS_RECORD), F.lit(1))).alias("record"))
    part = F.split("record", r"\x00")
    moved = F.size(part) == 3
    return each.select("commit", F.element_at(part, -1).alias("path"), F.when(moved, part[1]).alias("old_path"), part[0].alias("status"))


def parse_numstat_records(raw: DataFrame) -> DataFrame:
    """(commit, value) of NUL-separated numstat records -> (commit, path, added, deleted, binary), by the path after the change.

    Counts that are no numbers are 0; a dash in either place means binary.
    """
    each = raw.select("commit", F.explode(F.regexp_extract_all("value", F.lit(_NUMSTAT_RECORD), F.lit(1))).alias("record"))
    part = F.split("record", "\t", 3)
    path = F.when(part[2].startswith("\x00"), F.element_at(F.split(part[2], r"\x00"), -1)).otherwise(part[2])
    count = [F.coalesce(part[k].try_cast("int"), F.lit(0)).cast("long") for k in (0, 1)]
    return each.select("commit", path.alias("path"), count[0].alias("added"), count[1].alias("deleted"), ((part[0] == "-") | (part[1] == "-")).alias("binary"))


def changed_between(names: DataFrame, stats: DataFrame) -> DataFrame:
    """Parsed status records with the counts of their paths: 0 and not binary where there are none."""
    both = names.join(stats, ["commit", "path"], "left")
    filled = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("added", "deleted")} | {"binary": F.coalesce("binary", F.lit(False))}
    return both.withColumns(filled).select("commit", "path", "old_path", "status", "added", "deleted", "binary")


def change_totals(changes: DataFrame) -> DataFrame:
    """Changed files -> (commit, files, added, deleted, binary)."""
    return changes.groupBy("commit").agg(
        F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count_if("binary").alias("binary")
    )


def revision_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, body) at two revisions -> (path, added, deleted, binary, no_change, before, after).

    A NUL in the first 8000 bytes of either side makes a file binary; equal bytes of a binary file don't count as no change.
    """
    both = before.select("path", F.col("body").alias("before")).join(after.select("path", F.col("body").alias("after")), "path", "full_outer")
    binary = F.coalesce(is_binary_blob(F.col("before").cast("binary")), F.lit(False)) | F.coalesce(is_binary_blob(F.col("after").cast("binary")), F.lit(False))
    return both.select(
        "path", F.col("before").isNull().alias("added"), F.col("after").isNull().alias("deleted"), binary.alias("binary"),
        (~binary & F.col("before").eqNullSafe(F.col("after"))).alias("no_change"), "before", "after",
    )


def shown_lines(differences: DataFrame, most: int = SHOWN_LINES) -> DataFrame:
    """Differences of texts -> (path, n, op, text, truncated): the first `most` lines of each script, and whether there are more."""
    lines = changed_lines(differences.where("not binary and not no_change").select("path", "before", "after"))
    whole = F.max("n").over(Window.partitionBy("path"))
    return lines.withColumn("truncated", whole > most).where(F.col("n") <= most)


def patch_entries(names: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Status records of one pair of revisions and (path, body) at both -> (path, old_path, status, before, after, added, deleted, binary)."""
    old = before.select(F.col("path").alias("was"), F.col("body").alias("before"))
    new = after.select("path", F.col("body").alias("after"))
    both = names.withColumn("was", F.coalesce("old_path", "path")).join(old, "was", "left").join(new, "path", "left")
    binary = F.coalesce(is_binary_blob(F.col("before").cast("binary")), F.lit(False)) | F.coalesce(is_binary_blob(F.col("after").cast("binary")), F.lit(False))
    return both.select("path", "old_path", "status", "before", "after", F.col("status").startswith("A").alias("added"), F.col("status").startswith("D").alias("deleted"), binary.alias("binary"))


def with_patch(entries: DataFrame, around: int = 3) -> DataFrame:
    """entries with `patch`: a unified difference with that many lines of context; both texts of a file meet in a task."""

    @F.pandas_udf("string")
    def patch(path: pd.Series, was: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for p, w, a, b in zip(path, was, before, after, strict=True):
            old, new = ("/dev/null" if a is None else f"a/{w or p}"), ("/dev/null" if b is None else f"b/{p}")
            pair = [re.findall(r"[^\n]*\n|[^\n]+", x or "") for x in (a, b)]
            lines = difflib.unified_diff(*pair, old, new, n=around)
            out.append("".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in lines))
        return pd.Series(out, dtype=object)

    return entries.withColumn("patch", patch("path", "old_path", "before", "after"))


def render_differences(entries: DataFrame, layout: str = "sequential", before: str = "", after: str = "") -> DataFrame:
    """entries -> (path, text): fenced texts one after the other, in a table side by side, or the patch (unified).

    `before` and `after` name the revisions. Binary files have one line in any layout.
    """
    path = F.col("path")
    title = F.concat(F.lit("### "), path, F.lit("\n\n"))

    def closed(body, empty_too: bool = False):
        done = body.endswith("\n") if empty_too else body.endswith("\n") | (body == "")
        return F.when(done, body).otherwise(F.concat(body, F.lit("\n")))

    def fenced(body):
        return F.concat(F.lit("```"), T.language(path), F.lit("\n"), closed(F.coalesce(body, F.lit(""))), F.lit("```\n"))

    none = F.lit("")
    if layout == "unified":
        text = F.concat(F.lit("```diff\n"), closed(F.col("patch"), True), F.lit("```\n\n"))
    elif layout == "side-by-side":
        left = F.when(F.col("added"), none).otherwise(F.concat(F.lit("\n"), fenced(F.col("before"))))
        right = F.when(F.col("deleted"), none).otherwise(F.concat(F.lit("\n"), fenced(F.col("after"))))
        head = F.lit("<table>\n<tr><th>Before</th><th>After</th></tr>\n<tr><td>\n")
        text = F.concat(title, head, left, F.lit("\n</td><td>\n"), right, F.lit("\n</td></tr>\n</table>\n\n"))
    elif layout == "sequential":
        first = F.when(F.col("added"), none).otherwise(F.concat(F.lit(f"**Before** (commit {before}):\n"), fenced(F.col("before")), F.lit("\n")))
        second = F.when(F.col("deleted"), none).otherwise(F.concat(F.lit(f"**After** (commit {after}):\n"), fenced(F.col("after")), F.lit("\n")))
        text = F.concat(title, first, second)
    else:
        raise ValueError(f"no layout {layout}")
    return entries.select("path", F.when(F.col("binary"), F.concat(title, F.lit("binary file changed\n\n"))).otherwise(text).alias("text"))


def parse_refs(raw: DataFrame) -> DataFrame:
    """Lines of a ref listing with unit separators (value: full name, object, epoch, ahead, behind, subject) -> (kind, name, commit, at, ahead, behind, subject).

    Kinds are branch, remote and tag; other refs are left out. Counts that are no numbers are null.
    """
    part = F.split("value", "\x1f")
    kind = F.when(part[0].startswith("refs/heads/"), "branch").when(part[0].startswith("refs/remotes/"), "remote").when(part[0].startswith("refs/tags/"), "tag")
    return raw.where(F.size(part) >= 6).select(
        kind.alias("kind"), F.regexp_replace(part[0], "^refs/(?:heads|remotes|tags)/", "").alias("name"), part[1].alias("commit"), part[2].try_cast("long").alias("at"),
        part[3].try_cast("int").alias("ahead"), part[4].try_cast("int").alias("behind"), part[5].alias("subject"),
    ).where("kind is not null")


def loose_objects(blobs: DataFrame) -> DataFrame:
    """(path, content) of a store's loose objects -> (oid, kind, body): inflated, parted from their header; what can't be inflated is left out."""

    def inflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    head, mark, body = zlib.decompress(content).partition(b"\x00")
                except zlib.error:
                    continue
                if mark:
                    rows.append(("".join(path.split("/")[-2:]), head.split(b" ")[0].decode("ascii", "replace"), body))
            yield pd.DataFrame(rows, columns=["oid", "kind", "body"])

    return blobs.select("path", "content").mapInPandas(inflate, "oid string, kind string, body binary")


def tree_entries(objects: DataFrame) -> DataFrame:
    """Objects -> (tree, mode, name, oid) of every entry of every tree."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tree, body in zip(batch["oid"], batch["body"], strict=True):
                at = 0
                while (end := body.find(b"\x00", at)) >= 0:
                    mode, _, name = body[at:end].partition(b" ")
                    rows.append((tree, mode.decode("ascii", "replace"), name.decode("utf-8", "replace"), body[end + 1 : end + 21].hex()))
                    at = end + 21
            yield pd.DataFrame(rows, columns=["tree", "mode", "name", "oid"])

    return objects.where("kind = 'tree'").select("oid", "body").mapInPandas(entries, "tree string, mode string, name string, oid string")


def commit_trees(objects: DataFrame) -> DataFrame:
    """Objects -> (commit, tree, parents): the header of each commit."""
    header = F.substring_index(F.decode("body", "utf-8"), "\n\n", 1)
    rows = objects.where("kind = 'commit'").select(F.col("oid").alias("commit"), header.alias("h"))
    return rows.select("commit", F.regexp_extract("h", "^tree ([0-9a-f]+)", 1).alias("tree"), F.regexp_extract_all("h", F.lit(r"(?m)^parent ([0-9a-f]+)"), F.lit(1)).alias("parents"))


def commit_paths(objects: DataFrame, depth: int = 32) -> DataFrame:
    """Objects -> (commit, path, oid) of every file of every commit: one join a folder level, `depth` of them at most.

    Entries of a level that has no folders end the walk; a tree deeper than `depth` is an error, not a shorter result.
    """
    entries = tree_entries(objects)
    level = commit_trees(objects).select("commit", "tree", F.lit("").alias("folder"))
    found = None
    for _ in range(depth):
        here = level.join(entries, "tree").select("commit", "mode", "oid", F.concat("folder", "name").alias("path"))
        files = here.where("mode not in ('40000', '160000')").select("commit", "path", "oid")
        found = files if found is None else found.unionAll(files)
        level = here.where("mode = '40000'").select("commit", F.col("oid").alias("tree"), F.concat("path", F.lit("/")).alias("folder"))
        if level.isEmpty():
            return found
    raise ValueError(f"folders deeper than {depth}")
