"""Secret detection by ordered patterns, and redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.tables import lines_of

#: Kind, pattern (RE2 and Java read it alike) and severity, first match first (fixed values). Word edges are ASCII.
PATTERNS = (
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", "high"),
    ("aws_secret_key", r"""(?i)aws[_\-\s]*(secret|access)[_\-\s]*key[_\-\s]*[=:][_\-\s]*['"]?([a-zA-Z0-9/+=]{40})['"]?""", "high"),
    ("gcp_api_key", r"\bAIza[0-9A-Za-z\-_]{35}\b", "high"),
    ("gcp_service_account", r'"type":\s*"service_account"', "high"),
    ("azure_storage_key", r"\b[a-zA-Z0-9+/=]{86}==", "medium"),
    ("github_pat", r"\bghp_[A-Za-z0-9]{36,255}\b", "high"),
    ("github_oauth", r"\bgho_[A-Za-z0-9]{36,255}\b", "high"),
    ("github_app", r"\bghs_[A-Za-z0-9]{36,255}\b", "high"),
    ("github_refresh", r"\bghr_[A-Za-z0-9]{36,255}\b", "high"),
    ("slack_token", r"\bxox[abpr]-[A-Za-z0-9\-]{10,72}\b", "high"),
    ("slack_webhook", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+", "medium"),
    ("jwt", r"\beyJ[A-Za-z0-9\-_=]+\.eyJ[A-Za-z0-9\-_=]+\.?[A-Za-z0-9\-_.+/=]*\b", "medium"),
    ("private_key", r"-----BEGIN ((RSA|EC|DSA|OPENSSH|ENCRYPTED|PGP) )?PRIVATE KEY( BLOCK)?-----", "high"),
    ("generic_secret", r"""(?i)(api[_\-]?key|secret|token|password)["\s]*[=:]["\s]*['"]([a-zA-Z0-9_\-+/=]{16,})['"]""", "low"),
    ("env_assignment", r"""\b[A-Z][A-Z0-9_]{2,}(?:API_?KEY|SECRET|TOKEN|PASSWORD|PASSWD|PRIVATE_?KEY|ACCESS_?KEY|AUTH_?KEY)[A-Z0-9_]*\s*[=:]\s*["'`]?[A-Za-z0-9._/+=-]{12,}["'`]?""", "high"),
)
#: A text without one of these cannot match any pattern (fixed values): as they are, and in lower case.
HINTS, LOW_HINTS = ("AKIA", "AIza", "service_account", "==", "ghp_", "gho_", "ghs_", "ghr_", "xox", "hooks.slack", "eyJ", "BEGIN "), ("aws", "key", "secret", "token", "passw")
#: An edge of a word of ASCII letters, digits and `_`; this engine's own edge goes by all of Unicode.
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Entropy candidates (fixed values).
CANDIDATE, CANDIDATE_SIZE, CANDIDATE_BITS = r"[\p{L}\p{N}_+/=-]+", 20, 4.0


def hinted(text: Column) -> Column:
    """Whether a text, whole file or line, can match any pattern: plain containment, the cheap test before fifteen patterns."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [text.contains(h) for h in HINTS] + [low.contains(h) for h in LOW_HINTS])


def _hit(text: Column, allow: tuple[str, ...]) -> Column:
    """(kind, severity, found) of the first pattern that hits a line, null for none.

    A hit is passed over for the next pattern if an allowed string is in it or in the line.
    """
    named = [a for a in allow if a]
    spared = reduce(lambda a, b: a | b, [text.contains(a) for a in named]) if named else None  # a hit is part of its line
    hit = None
    for kind, pattern, severity in PATTERNS:
        pattern = pattern.replace(r"\b", _EDGE)
        good = text.rlike(pattern) if spared is None else text.rlike(pattern) & ~spared
        row = F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.regexp_substr(text, F.lit(pattern)).alias("found"))
        hit = F.when(good, row) if hit is None else hit.when(good, row)
    return F.when(hinted(text), hit)


def _not_spared(rows: DataFrame, allow_files: tuple[str, ...]) -> DataFrame:
    for pattern in filter(None, allow_files):
        rows = rows.where(~F.col("path").rlike(glob_regex(pattern)))
    return rows


def warnings(lines: DataFrame, allow: tuple[str, ...] = (), allow_files: tuple[str, ...] = (), entropy: bool = False) -> DataFrame:
    """lines -> (path, line_no, kind, severity, preview): the first pattern that hits a line, and its first high-entropy run if asked.

    Allowed strings spare lines, allowed files are left out; empty entries say nothing. One scan, no shuffle.
    """
    rows = _not_spared(lines, allow_files)
    found = rows.where(hinted(F.col("text"))).select("path", "line_no", _hit(F.col("text"), allow).alias("h")).where("h is not null")
    found = found.select("path", "line_no", "h.kind", "h.severity", T.preview(F.col("h.found")).alias("preview"))
    if not entropy:
        return found
    runs = entropy_warnings(rows, allow)
    return found.unionAll(runs.select("path", "line_no", F.lit("high_entropy"), F.lit("low"), T.preview(F.col("candidate"))))


def scan_files(files: DataFrame, allow: tuple[str, ...] = (), allow_files: tuple[str, ...] = ()) -> DataFrame:
    """files (path, body) -> warnings: bodies that cannot hold a hit are never parted into lines."""
    rows = _not_spared(files, allow_files).where(hinted(F.col("body")))
    return warnings(lines_of(rows), allow)


def entropy_warnings(lines: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """(path, line_no, candidate, bits): of each line the first long run of high entropy, lines with an allowed string left out."""
    rows = lines
    for a in filter(None, allow):
        rows = rows.where(~F.col("text").contains(a))
    runs = F.transform(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda c: F.struct(c.alias("candidate"), F.when(F.char_length(c) >= CANDIDATE_SIZE, T.entropy(c)).alias("bits")))
    first = F.get(F.filter(runs, lambda c: c["bits"] >= CANDIDATE_BITS), F.lit(0))
    return rows.select("path", "line_no", first.alias("x")).where("x is not null").select("path", "line_no", "x.candidate", "x.bits")


def glob_regex(glob: str) -> str:
    """An allow-list glob: `*` and `?` within a folder and `[set]`; one that ends in `/**` also fits all below that folder, wherever it is."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if c == "[" and "]" in glob[k:]:
            end = glob.index("]", k)
            out += glob[k : end + 1]
            k = end
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in ".^$+{}()|\\]" else c)
        k += 1
    whole = f"^{out}$"
    if not glob.endswith("/**"):
        return whole
    prefix = "".join("\\" + c if c in ".^$+*?{}()|[]\\" else c for c in glob[:-3])
    return f"{whole}|(?:^|/){prefix}/"


def redact(lines: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """lines with flagged ones masked; a private key goes on to its END line or the first line that is no key text.

    Lines are judged where they are. Only files that open a private key are gathered and put in order.
    """
    marked = lines.withColumn("kind", _hit(F.col("text"), allow)["kind"])
    keyed = lines.where(F.col("text").contains("-----BEGIN ") & (_hit(F.col("text"), allow)["kind"] == "private_key")).select("path").distinct()
    plain = marked.join(keyed, "path", "left_anti")
    w = Window.partitionBy("path").orderBy("line_no")
    joined = marked.join(keyed, "path", "left_semi")
    begin = F.when(F.col("kind") == "private_key", F.col("line_no"))
    key_text = F.col("text").rlike(r"^[A-Za-z0-9+/=\s:,.-]*$") & (F.trim("text") != "")
    end = F.col("text").rlike("-----END ")
    ordered = joined.withColumns({"begin": F.last(begin, ignorenulls=True).over(w), "stop": F.when(end | ~key_text & F.col("kind").isNull(), F.col("line_no"))})
    within = Window.partitionBy("path", "begin").orderBy("line_no")
    prior = F.min("stop").over(within.rowsBetween(Window.unboundedPreceding, -1))
    inside = F.col("begin").isNotNull() & prior.isNull() & (end | key_text)
    held = ordered.select("path", "line_no", "text", F.coalesce("kind", F.when(inside, "private_key")).alias("kind"))
    masked = F.when(F.col("kind").isNotNull(), F.concat(F.lit("[REDACTED — kind="), "kind", F.lit("]"))).otherwise(F.col("text"))
    return plain.select("path", "line_no", "text", "kind").unionAll(held).select("path", "line_no", masked.alias("text"))
