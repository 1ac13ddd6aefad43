"""Text, path and token expressions; queries, goals and options are driver values, never columns."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of search queries (fixed values).
QUERY_STOP = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with", "どこ", "どれ", "です", "する", "した", "して", "ある", "いる", "から", "まで", "の", "は", "を")
#: Stop words of goals (fixed values).
GOAL_STOP = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with", "が", "から", "したい", "する", "で", "です", "と", "について", "に", "の", "は", "まで", "を", "調べたい", "調べる", "見たい", "知りたい", "確認したい", "レビューしたい")
#: Words a goal's term stands for as well (fixed values).
GOAL_ALIASES = {
    "ログイン": ("login", "auth", "session"),
    "認証": ("auth", "authentication", "login", "session"),
    "セッション": ("session", "auth"),
    "権限": ("permission", "authorization", "auth"),
    "設定": ("config", "settings"),
}
#: Particles that part words of a goal (fixed values), longest first when matched.
GOAL_PARTICLES = ("について", "調べたい", "したい", "レビューしたい", "確認したい", "を", "が", "は", "の", "に", "で", "から", "まで")
#: Stop words of coverage scoring (fixed values).
ECHO_STOP = ("the", "a", "an", "is", "in", "of", "to", "and", "or", "for", "on", "by", "with", "は", "が", "を", "に", "で", "と", "の")

#: Runs of letters that are a word (fixed values): CJK and kana blocks, or ASCII letters, digits and hyphens.
_TOKEN = re.compile(r"[⺀-⿟々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿ぁ-ゟァ-ヿ]+|[A-Za-z0-9_-]+")


def _terms(text: str, stop: tuple[str, ...]) -> list[str]:
    found = (t.strip("_-") for t in _TOKEN.findall(text.lower()))
    return list(dict.fromkeys(t for t in found if len(t) >= 2 and t not in stop))


def query_terms(query: str) -> list[str]:
    """Lower-cased terms of a search, without stop words, each once; the whole query if none is left."""
    return _terms(query, QUERY_STOP) or ([query.lower().strip()] if query.strip() else [])


def goal_terms(goal: str) -> list[str]:
    """Terms of a goal: aliases of known words first, particles as gaps, then as query_terms with the goal's stop words."""
    low = goal.lower()
    extra = " ".join(a for k in sorted(GOAL_ALIASES) if k in low for a in GOAL_ALIASES[k])
    parted = re.sub("|".join(map(re.escape, sorted(GOAL_PARTICLES, key=len, reverse=True))), " ", low)
    return list(dict.fromkeys(_terms(extra, GOAL_STOP) + _terms(parted, GOAL_STOP)))


def size_tokens(size: Column) -> Column:
    """Tokens estimated from bytes: a quarter, one at least."""
    return F.greatest(F.floor(size / 4), F.lit(1)).cast("long")


def split_lines(body: Column) -> Column:
    parts = F.split(body, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def logical_lines(body: Column) -> Column:
    """Lines with their terminators, for hashing."""
    return F.regexp_extract_all(body, F.lit("[^\n]*\n|[^\n]+$"), F.lit(0))


def line_count(body: Column) -> Column:
    """Newlines, and one for a last line without."""
    n = F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"), F.lit("")))
    return (n + F.when((body != "") & ~body.endswith("\n"), 1).otherwise(0)).cast("long")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The folder, `.` without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(".")


def stem(path: Column) -> Column:
    """The basename without its extension; a leading dot opens none."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def truncate_path(path: Column, depth: int) -> Column:
    """The first `depth` folders of a path, `.` for none."""
    parts = F.slice(F.split(dirname(path), "/"), 1, depth) if depth > 0 else F.array()
    joined = F.array_join(parts.cast("array<string>"), "/")
    return F.when((F.instr(path, "/") == 0) | (joined == ""), ".").otherwise(joined)


def identifier_parts(name: Column) -> Column:
    """Lower-cased parts of an identifier: at `_` and `-`, aA, AAa, digits and other characters; two characters at least."""
    for pattern, put in (
        ("(?<=[a-z])(?=[A-Z])", "_"),
        ("(?<=[A-Z])(?=[A-Z][a-z])", "_"),
        ("(?<=[0-9])(?=[^0-9_-])|(?<=[^0-9_-])(?=[0-9])", "_"),
        ("(?<=[A-Za-z0-9])(?=[^A-Za-z0-9_-])|(?<=[^A-Za-z0-9_-])(?=[A-Za-z0-9])", "_"),
    ):
        name = F.regexp_replace(name, pattern, put)
    return F.transform(F.filter(F.split(name, "[_-]"), lambda x: F.char_length(x) >= 2), lambda x: F.lower(x))


def echo_tokens(text: Column) -> Column:
    """Lower-cased tokens for coverage: letters and digits, parted at camel case and between the two; two characters at least; duplicates stay."""
    for pattern in (
        r"(?<=\p{Ll})(?=\p{Lu})",
        r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})",
        r"(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})",
    ):
        text = F.regexp_replace(text, pattern, " ")
    words = F.transform(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(*ECHO_STOP))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits over the characters; 0 for an empty text. Each distinct character is counted by what the text loses without it."""
    n = F.char_length(value)
    counts = F.transform(F.array_distinct(F.split(value, "")), lambda c: (F.octet_length(value) - F.octet_length(F.replace(value, c, F.lit("")))) / F.octet_length(c))
    total = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + k * F.log2(k))
    return F.when(value == "", 0.0).otherwise(F.log2(n) - total / n)


def preview(value: Column) -> Column:
    """Up to twelve bytes whole, else the whole characters within the first and the last four bytes."""
    head, tail = F.lit(""), F.lit("")
    for k in range(1, 5):
        head = F.when(F.octet_length(F.left(value, F.lit(k))) <= 4, F.left(value, F.lit(k))).otherwise(head)
        tail = F.when(F.octet_length(F.right(value, F.lit(k))) <= 4, F.right(value, F.lit(k))).otherwise(tail)
    return F.when(F.octet_length(value) <= 12, value).when(value.isNotNull(), F.concat(head, F.lit("[...]"), tail))


def byte_column(line: Column, term: Column) -> Column:
    """1-based byte offset of the term in the lower-cased line, 1 if it isn't there."""
    low = F.lower(line)
    at = F.position(term, low)
    return F.when(at > 0, F.octet_length(F.substr(low, F.lit(1), at - 1)) + 1).otherwise(1)


def clean_path(path: Column) -> Column:
    """`.`, empty and `..` segments resolved, as slash paths; an absolute path stays so; nothing left is `.`."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    stack = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .when((s == "..") & path.startswith("/"), acc).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(stack, "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def slug(name: Column) -> Column:
    """Lower case, other runs than letters and digits as one hyphen, 48 characters at most."""
    s = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(48)), "-+$", "")


def line_spec(spec: Column) -> Column:
    """`path:a-b`, `path:n` or `path#La-Lb` -> (path, first, last); whole paths have null lines; end >= start >= 1."""
    pattern = r"^(.+?)(?::|#L)(\d{1,9})(?:-L?(\d{1,9}))?$"
    a = F.regexp_extract(spec, pattern, 2).try_cast("int")
    b = F.coalesce(F.regexp_extract(spec, pattern, 3).try_cast("int"), a)
    good = a.isNotNull() & (a >= 1) & (b >= a)
    return F.struct(F.when(good, F.regexp_extract(spec, pattern, 1)).otherwise(spec).alias("path"), F.when(good, a).alias("first"), F.when(good, b).alias("last"))


#: File names of configuration (fixed values).
CONFIG_NAMES = ("package.json", "go.mod", "cargo.toml", "pyproject.toml", "dockerfile", "makefile")
#: File names of entry points (fixed values).
ENTRY_NAMES = ("main.ts", "main.go", "main.py", "index.ts", "index.tsx", "index.js")


def role(path: Column) -> Column:
    """test, doc, config, entry, route, core or nothing: the first rule that fits."""
    base, low = basename(path), F.lower(path)
    name = F.lower(base)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return (
        F.when(low.startswith("tests/") | low.contains("/tests/") | name.endswith("_test.go") | name.rlike(r"\.test\.(?:tsx?|js|go|py)$"), "test")
        .when((ext == ".md") | name.startswith("license") | name.startswith("readme"), "doc")
        .when(name.isin(*CONFIG_NAMES) | ext.isin(".toml", ".yaml", ".yml"), "config")
        .when(base.isin(*ENTRY_NAMES), "entry")
        .when(base.contains("router") | base.contains("route") | base.contains("Router"), "route")
        .when(ext.isin(".ts", ".tsx", ".js", ".go", ".py", ".rs"), "core")
        .otherwise("")
    )


#: Fence languages by extension (fixed values).
LANGUAGES = {"go": "go", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "rs": "rust", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sh": "bash"}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit(""))


def period_start(text: str, now: datetime) -> datetime:
    """`YYYY-MM-DD` as midnight UTC of that day, or a duration before now."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()):
        return datetime.fromisoformat(text.strip()).replace(tzinfo=UTC)
    return now - timedelta(seconds=duration_seconds(text))


def duration_seconds(text: str) -> int:
    """`7d`, `2w`, `1mo`, `1y`, `3h`, `5m`, `9s` or a sum such as `1h30m`; months are 30 days, years 365."""
    units = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000}
    parts = re.findall(r"(\d+)(mo|[smhdwy])", text.strip().lower())
    if not parts or "".join(a + b for a, b in parts) != text.strip().lower():
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * units[u] for n, u in parts)


#: A script block of a page or component, its content in group 1 (fixed value).
SCRIPT_BLOCK = r"(?is)<script\b[^>]*>(.*?)</script\s*>"


def relative_path(raw: Column) -> Column:
    """A relative path below the root with slashes, or null: no empty path, drive, leading slash, NUL or `..`."""
    unified = F.replace(F.trim(raw), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(unified, "/"), lambda p: (p != "") & (p != "."))
    bad = unified.startswith("/") | unified.rlike("^[A-Za-z]:") | F.exists(parts, lambda p: p == "..") | unified.contains("\x00") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def strip_comments(source: Column) -> Column:
    """Block comments go, then each `//` up to the end of its line."""
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
