"""Ignore rules, globs and path filters, compiled on the driver into one expression."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Folders of dependencies (fixed values).
DEPENDENCY_FOLDERS = (".git", "node_modules", "vendor", "dist", "build", "target", "coverage", ".venv", "venv", "__pycache__", ".next", ".cache")
#: Names and endings that hold secrets (fixed values).
SECRET_NAMES = (".env", "id_rsa", "id_ed25519", ".npmrc", ".netrc", "credentials")
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".keystore")
#: Folders that packs never walk (fixed values).
PACK_SKIPPED = (".git", "node_modules", "dist", "coverage", "target")
#: Folders that the walk for imports skips (fixed values).
IMPORT_SKIPPED = (".git", "node_modules", "dist", "coverage")
#: What packs ignore without being told (fixed values).
PACK_IGNORED = ("node_modules/**", "dist/**", "coverage/**", "*.lock", ".git/**")
#: Endings of files whose public interface can be shown alone (fixed values).
API_ENDINGS = (".go", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py")
#: Hex of one, two or three bytes that begin a longer UTF-8 character (fixed values).
CUT_CHARACTERS = (
    "^(?:C[2-9A-F]|D.|E.|F[0-4])$", "^(?:E0[AB].|E[1-9A-CEF][89AB].|ED[89].|F0[9AB].|F[1-3][89AB].|F48.)$", "^(?:F0[9AB].|F[1-3][89AB].|F48.)[89AB].$",
)


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """An ignore line -> (pattern over slash paths, negated); None for blank lines and comments.

    `*` stays in a segment, `**` spans segments, `?` is itself, a leading slash or an inner one with a starred file anchors,
    and what matches a folder matches all below it.
    """
    rule = line.rstrip("\r").strip(" ")
    if not rule or line.startswith("#"):  # an indented mark opens a pattern
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    rule = rule[1:] if rule[:1] in ("#", "!") else rule
    if re.search(r"([^/+])/.*\*\.", rule) and not rule.startswith("/"):
        rule = "/" + rule
    anchored = rule.startswith("/")
    rule = rule.removeprefix("/").removeprefix("**/") if rule.startswith("/**/") else rule.removeprefix("/")
    out, k = "(?:.*/)?" if anchored and line.lstrip("!").strip().startswith("/**/") else "", 0
    while k < len(rule):
        if rule.startswith("/**/", k):
            out, k = out + "(?:/|/.+/)", k + 4
        elif rule.startswith("**/", k):
            out, k = out + "(?:|.*/)", k + 3
        elif rule.startswith("/**", k):
            out, k = out + "(?:|/.*)", k + 3
        elif rule.startswith(r"\*", k):
            out, k = out + r"\*", k + 2
        elif rule[k] == "*":
            out, k = out + "[^/]*", k + 1
        else:
            c = rule[k]
            out, k = out + ("\\" + c if c in ".?+^$(){}|" else c), k + 1
    tail = "(?:|.*)$" if rule.endswith("/") else "(?:|/.*)$"
    return ("^(?:|/)" if anchored else "^(?:|.*/)") + out + tail, negated


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the rules, in order, ignore the path or a folder above it: a match ignores, a negated match clears.

    A folder that is ignored is never entered, so nothing below it comes back.
    """
    parts = F.split(path, "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.when(k < F.size(parts), "/").otherwise("")))
    compiled = [r for r in map(ignore_rule, rules) if r]

    def fold(p: Column) -> Column:
        state = F.lit(False)
        for pattern, negated in compiled:
            state = F.when(p.rlike(pattern), not negated).otherwise(state)
        return state

    return F.exists(chain, fold)


def drop_ignored(files: DataFrame, rules: list[str], more: list[str] = (), no_dependencies: bool = False) -> DataFrame:
    """files that neither rule set ignores, nor, if asked, a dependency folder holds."""
    path = F.col("path")
    kept = files.where(~ignored(path, list(rules)))
    if more:
        kept = kept.where(~ignored(path, list(more)))
    if no_dependencies:
        kept = kept.where(~path.rlike("(?:^|/)(?:" + "|".join(map(re.escape, DEPENDENCY_FOLDERS)) + ")/"))
    return kept


def braces(glob: str, most: int = 256) -> list[str]:
    """`a{b,c}` -> `ab`, `ac`; at most 256."""
    m = re.search(r"\{([^{}]*)\}", glob)
    if not m:
        return [glob]
    out = [x for part in m[1].split(",") for x in braces(glob[: m.start()] + part + glob[m.end() :], most)]
    if len(out) > most:
        raise ValueError("too many alternatives")
    return out


def glob_pattern(glob: str) -> str:
    """A glob over paths: without a slash it fits any segment; what it fits includes all below."""
    g = glob.strip().removeprefix("./").rstrip("/")
    out, k = "", 0
    while k < len(g):
        if g.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif g.startswith("**", k):
            out, k = out + ".*", k + 2
        elif g[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif g[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(g[k]), k + 1
    return ("(?:^|.*/)" if "/" not in g else "^") + out + "(?:/.*)?$"


def allowed(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """An include glob fits, if there is any, and no exclude glob does."""
    def any_of(globs: list[str]) -> Column:
        return path.rlike("|".join(f"(?:{glob_pattern(x)})" for g in globs for x in braces(g)))

    fits = any_of(list(include)) if include else F.lit(True)
    return fits & ~any_of(list(exclude)) if exclude else fits


def is_binary(head: Column) -> Column:
    """A NUL in the first 512 bytes, or bytes there that are no UTF-8; a character that the 512th byte cuts is no such evidence."""
    start = F.substring(head, 1, 512)
    valid = F.is_valid_utf8(start)
    for k, opened in enumerate(CUT_CHARACTERS, 1):
        end = F.hex(F.substring(start, F.octet_length(start) - k + 1, F.lit(k)))
        valid = valid | ((F.octet_length(start) >= k) & end.rlike(opened) & F.is_valid_utf8(F.substring(start, F.lit(1), F.octet_length(start) - k)))
    return has_nul(start) | ~valid


def has_nul(data: Column) -> Column:
    return F.contains(data.cast("string"), F.char(F.lit(0)))


def is_binary_blob(data: Column) -> Column:
    """A NUL in the first 8000 bytes, as for stored revisions."""
    return has_nul(F.substring(data, 1, 8000))


def pack_ignored(path: Column, patterns: list[str]) -> Column:
    """The simpler ignore lists of packs, over files and the folders above them; comments and negations are dropped.

    `x/` is a folder anywhere, `x/**` a folder at the root, a name without a star any path that ends in it at a folder's
    edge; with stars, whole paths from the root, and a star spans folders. A leading slash fits nothing.
    """
    kept = [p.removeprefix("./") for p in (x.strip() for x in patterns) if p and not p.startswith(("#", "!"))]
    tests = []
    for p in filter(None, kept):
        if p.endswith("/"):
            name = re.escape(p[:-1])
            tests.append(f"^{name}$|(?:^|/){name}/")
        elif p.endswith("/**"):
            tests.append(f"^{re.escape(p[:-3])}(?:/|$)")
        elif "*" not in p:
            tests.append(f"(?:^|/){re.escape(p)}(?:/|$)")
        else:
            tests.append("^" + ".*".join(map(re.escape, p.split("*"))) + "(?:/|$)")
    tests = [t for t, p in zip(tests, filter(None, kept), strict=True) if not p.startswith("/")]
    return path.rlike("(?s)" + "|".join(f"(?:{t})" for t in tests)) if tests else F.lit(False)


def pack_scan(files: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """Files that a pack walks, with `head`: their first 512 bytes; skipped folders and ignored paths are left out."""
    path = F.col("path")
    return files.where(~hard_skipped(path) & ~pack_ignored(path, [*PACK_IGNORED, *patterns])).withColumn("head", F.substring(F.col("body").cast("binary"), 1, 512))


def import_scan(files: DataFrame) -> DataFrame:
    """Files whose imports are read: none below a folder that this walk skips."""
    return files.where(~F.col("path").rlike("(?:^|/)(?:" + "|".join(map(re.escape, IMPORT_SKIPPED)) + ")/"))


def folder_counts(files: DataFrame) -> DataFrame:
    """(path, body, tokens) -> (dir, files, tokens, lines) of each folder with all below it; files at the root have none."""
    parts = F.split(T.dirname(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    n = F.size(T.split_lines(F.col("body"))).cast("long").alias("n")
    each = files.where(F.col("path").contains("/")).select("tokens", n, up.alias("up")).select("tokens", "n", F.explode("up").alias("dir"))
    return each.groupBy("dir").agg(F.count("*").alias("files"), F.sum("tokens").cast("long").alias("tokens"), F.sum("n").alias("lines"))


def hard_skipped(path: Column) -> Column:
    """Below a folder that packs never walk."""
    return path.rlike("(?:^|/)(?:" + "|".join(map(re.escape, PACK_SKIPPED)) + ")/")


def api_only(path: Column) -> Column:
    """Whether a file's public interface can be shown alone."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*API_ENDINGS)


def changed(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files whose path is in the change set (path)."""
    return files.join(changes.select("path"), "path", "left_semi")


def below(path: Column, anchor: str) -> Column:
    """The anchor itself or anything under it."""
    return (path == anchor) | path.startswith(anchor.rstrip("/") + "/")


def is_secret_path(path: Column) -> Column:
    base = T.basename(path)
    return base.isin(*SECRET_NAMES) | reduce(lambda a, b: a | b, [base.endswith(s) for s in SECRET_SUFFIXES]) | path.rlike(r"(?:^|/)(?:\.ssh|\.aws|\.gnupg)/")


def folders_left(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (dir) that still hold a file anywhere below."""
    parts = F.split(T.dirname(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return folders.join(files.select(F.explode(up).alias("dir")).distinct(), "dir", "left_semi")


def requested(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that wanted (path) names, wanted paths that no file has)."""
    return files.join(wanted, "path", "left_semi"), wanted.join(files.select("path"), "path", "left_anti")
