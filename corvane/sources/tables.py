"""The tables operators read, from folders of files or from star-schema tables.

files(path, body, size, tokens), lines(path, line_no, text), symbols(path, name, kind, line),
commits(commit, at, author, root), commit_files(commit, path, added, deleted, status), manifests(path, sha, tokens, score, tier).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.staging import dealt

#: Order lines, and documents, that a task groups.
LINES_EACH, FILES_EACH = 500_000, 5_000


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """A folder tree -> files; content that is no UTF-8 is left out, paths are relative to root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    prefix = root.rstrip("/") + "/"
    clean = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    return raw.where(F.is_valid_utf8("content")).select(
        F.when(clean.startswith(prefix), F.substr(clean, F.lit(len(prefix) + 1))).otherwise(clean).alias("path"),
        F.decode("content", "utf-8").alias("body"), F.col("length").alias("size"), T.size_tokens(F.col("length")).alias("tokens"),
    )


def document_files(documents: DataFrame) -> DataFrame:
    """documents -> files: source/lang/doc_<id>.md."""
    body = F.coalesce("text", F.lit(""))
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return documents.select(path.alias("path"), body.alias("body"), F.col("n_chars").alias("size"), T.size_tokens(F.octet_length(body)).alias("tokens"))


def lines_of(files: DataFrame) -> DataFrame:
    """files -> lines, from 1; no line after a final newline; a carriage return before a newline goes."""
    each = files.select("path", F.posexplode(T.split_lines(F.col("body"))).alias("at", "text"))
    return each.select("path", (F.col("at") + 1).cast("long").alias("line_no"), "text")


def gathered_lines(files: DataFrame) -> DataFrame:
    """lines_of files, all of a path in one task, of about FILES_EACH files: bodies are dealt before they are parted."""
    return lines_of(dealt(files, files.count(), FILES_EACH, "path"))


def word_symbols(lines: DataFrame) -> DataFrame:
    """The first capitalised word of each line, as prose's stand-in for declarations."""
    word = F.regexp_extract("text", "[A-Z][a-z]+", 0)
    return lines.select("path", word.alias("name"), F.lit("word").alias("kind"), F.col("line_no").alias("line")).where("name <> ''")


_IDENT = r"\s*([A-Za-z_][A-Za-z0-9_]*)"
_SCRIPT = r"^\s*(?:export default |export )?"
#: Declaration rules by language (fixed values): extensions, pattern with the name in group 1, kind.
DECLARATIONS = (
    ("go", r"^\s*func \s*(?:\([^)]*\))" + _IDENT, "function"),
    ("go", r"^\s*func " + _IDENT, "function"),
    ("go", r"^\s*type " + _IDENT, "type"),
    ("rs", r"^\s*(?:pub )?fn " + _IDENT, "function"),
    ("rs", r"^\s*(?:pub )?(?:struct|enum) " + _IDENT, "type"),
    ("rs", r"^\s*(?:pub )?trait " + _IDENT, "interface"),
    ("ts|tsx|js|jsx|mjs|cjs", _SCRIPT + "function " + _IDENT, "function"),
    ("ts|tsx|js|jsx|mjs|cjs", _SCRIPT + "class " + _IDENT, "class"),
    ("ts|tsx|js|jsx|mjs|cjs", _SCRIPT + "interface " + _IDENT, "interface"),
    ("ts|tsx|js|jsx|mjs|cjs", _SCRIPT + "(?:const|let|var) " + _IDENT + r"\s*=.*=>", "function"),
    ("py", r"^\s*def " + _IDENT, "function"),
    ("py", r"^\s*class " + _IDENT, "class"),
)


def code_symbols(lines: DataFrame) -> DataFrame:
    """Declarations found line by line; the first rule of a file's language that matches a line names it."""
    ext = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    rule = F.coalesce(
        *[
            F.when(ext.rlike(f"^(?:{e})$") & F.col("text").rlike(p), F.struct(F.regexp_extract("text", p, 1).alias("name"), F.lit(k).alias("kind")))
            for e, p, k in DECLARATIONS
        ]
    )
    found = lines.select("path", F.col("line_no").alias("line"), rule.alias("s")).where("s is not null")
    return found.select("path", "s.name", "s.kind", "line")


def order_commits(orders: DataFrame) -> DataFrame:
    """orders -> commits: urgent orders stand in for commits without a parent."""
    return orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").startswith("1").alias("root"))


def lineitem_files(lineitem: DataFrame) -> DataFrame:
    """lineitem -> commit_files: a part is a path; its lines in an order are added rows, those returned deleted ones. Status: D if any is returned, else A or M.

    Lines are dealt by commit, LINES_EACH a task: what is grouped or joined by commit afterwards stays where it is.
    """
    lines = lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), "l_quantity", "l_returnflag")
    return dealt(lines, lineitem.count(), LINES_EACH, "commit").groupBy("commit", "path").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("added"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(0)).alias("deleted"),
        F.when(F.max(F.col("l_returnflag") == "R"), "D").when(F.max(F.col("l_returnflag") == "A"), "A").otherwise("M").alias("status"),
    )


def parse_log(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Lines of `git log` with unit separators (value) -> commit rows with at, author, email, parents, subject.

    Fields: hash, short hash, author, e-mail, epoch, parents, subject. Authors are cut to 100 and subjects to 500
    characters. With a limit, the newest rows, each with `truncated`: whether there were more.
    """
    part = F.split("value", "\x1f")
    rows = raw.where(F.size(part) >= 7).select(
        part[0].alias("commit"), part[1].alias("short"), F.left(part[2], F.lit(100)).alias("author"), part[3].alias("email"),
        part[4].cast("long").alias("at"), F.filter(F.split(part[5], " "), lambda p: p != "").alias("parents"), F.left(part[6], F.lit(500)).alias("subject"),
    )
    if limit is None:
        return rows.withColumn("truncated", F.lit(False))
    return newest(rows, limit)


def newest(commits: DataFrame, limit: int) -> DataFrame:
    """The newest rows by (at, commit), with `truncated`: one row more is read to learn whether there are others."""
    top = commits.orderBy(F.desc("at"), "commit").limit(limit + 1)
    n = top.agg(F.count("*").alias("n"))
    return top.orderBy(F.desc("at"), "commit").limit(limit).crossJoin(F.broadcast(n)).withColumn("truncated", F.col("n") > limit).drop("n")


def parse_numstat(raw: DataFrame) -> DataFrame:
    """(commit, value) numstat lines `added\\tdeleted\\tpath` -> commit_files with binary; `-` counts are null."""
    part = F.split("value", "\t")
    return raw.where(F.size(part) == 3).select(
        "commit", part[2].alias("path"), part[0].try_cast("long").alias("added"),
        part[1].try_cast("long").alias("deleted"), ((part[0] == "-") & (part[1] == "-")).alias("binary"),
    )


def parse_status(raw: DataFrame) -> DataFrame:
    """Porcelain status lines (value) -> (path, status): `??` is ?, else the first of D, A, M, R, C, T that is set."""
    flags = F.substring("value", 1, 2)
    kind = F.when(flags == "??", "?")
    for letter in "DAMRCT":
        kind = kind.when(flags.contains(letter), letter)
    return raw.where(F.char_length("value") > 3).select(F.substr("value", F.lit(4)).alias("path"), kind.alias("status")).where("status is not null")


def manifest(files: DataFrame, kept: Column, changed: Column) -> DataFrame:
    """A snapshot of files: those kept, with another content where changed; score and tier follow the tokens."""
    body = F.when(changed, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    score = (F.col("tokens") % 20).cast("long")
    return files.where(kept).select(
        "path", F.sha2(body, 256).alias("sha"), (F.col("tokens") + F.when(changed, 1).otherwise(0)).alias("tokens"), score.alias("score"),
        F.when(score >= 10, "High").when(score >= 3, "Medium").otherwise("Low").alias("tier"),
    )
