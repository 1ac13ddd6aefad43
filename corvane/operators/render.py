"""Text of packs, matches, digests and maps: a row each, gathered in order only for one bounded report."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Rows of the omitted list (fixed value).
OMITTED = 50
#: Lines that may follow a declaration whose brackets are open (fixed value).
CONTINUATION = 8


def numbered(n: Column) -> Column:
    """Thousands separators."""
    return F.format_number(n, 0)


def signed(n: Column) -> Column:
    return F.when(n >= 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def metric(tokens: Column, unit: str) -> Column:
    """Tokens as they are, as characters (four each) or pages (500 tokens)."""
    return {"tokens": F.concat(numbered(tokens), F.lit(" tokens")), "chars": F.concat(numbered(tokens * 4), F.lit(" chars")), "pages": F.concat(F.round(tokens / 500, 1).cast("string"), F.lit(" pages"))}[unit]


def pack_rows(files: DataFrame, style: str = "markdown") -> DataFrame:
    """(path, body, tokens) -> (path, text): one file's block as markdown, plain, xml or json."""
    path, body = F.col("path"), F.col("body")
    closed = F.when(body.endswith("\n") | (body == ""), body).otherwise(F.concat(body, F.lit("\n")))
    escaped = F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    made = {
        "markdown": F.concat(F.lit("### "), path, F.lit("\n\n```"), T.language(path), F.lit("\n"), closed, F.lit("```\n")),
        "plain": F.concat(F.lit("== "), path, F.lit(" ==\n"), closed),
        "xml": F.concat(F.lit('<file path="'), path, F.lit('" tokens="'), F.col("tokens").cast("string"), F.lit('">'), escaped, F.lit("</file>\n")),
        "json": F.to_json(F.struct(path.alias("path"), F.col("tokens").alias("tokens"), body.alias("content"))),
    }[style]
    return files.select("path", made.alias("text"))


def omitted(skipped: DataFrame, budget: int) -> DataFrame:
    """(path, tokens, reason) -> (path, line): at most OMITTED rows, largest first, and what all of them would need."""
    top = skipped.orderBy(F.desc("tokens"), "path").limit(OMITTED)
    return top.select("path", F.concat(F.lit("- "), F.col("path"), F.lit(" ("), F.col("reason"), F.lit(", "), numbered(F.col("tokens")), F.lit(f" of {budget} tokens)")).alias("line"))


def vimgrep(matches: DataFrame) -> DataFrame:
    """Search matches -> (path, line_no, text): `path:line:column:text`."""
    return matches.select("path", "line_no", F.concat_ws(":", "path", F.col("line_no").cast("string"), F.col("byte_column").cast("string"), F.trim("text")).alias("text"))


def digest_markdown(digest: DataFrame) -> DataFrame:
    return digest.select(
        F.concat(
            F.lit("# Digest\n\n- commits: "), F.col("commits").cast("string"), F.lit("\n- authors: "), F.col("authors").cast("string"), F.lit("\n- files: "), F.col("files").cast("string"),
            F.lit("\n- added: "), F.col("added").cast("string"), F.lit("\n- deleted: "), F.col("deleted").cast("string"), F.lit("\n"),
        ).alias("text")
    )


def heat_rows(buckets: DataFrame, style: str = "plain") -> DataFrame:
    """(dir, weight) -> (dir, text): plain, ascii bar of 40 cells by the heaviest, or json."""
    if style == "plain":
        return buckets.select("dir", F.concat_ws("\t", "dir", F.col("weight").cast("long").cast("string")).alias("text"))
    if style == "json":
        return buckets.select("dir", F.to_json(F.struct("dir", "weight")).alias("text"))
    most = buckets.agg(F.max("weight").alias("most"))
    bar = F.repeat(F.lit("#"), F.greatest(F.floor(F.col("weight") / F.col("most") * 40 + 0.5), F.lit(1)).cast("int"))
    return buckets.crossJoin(F.broadcast(most)).select("dir", F.concat(F.rpad("dir", 24, " "), bar).alias("text"))  # one row of the most


def treemap_svg(cells: list[tuple[str, int, int, int, int]], scale: int = 10) -> str:
    """Rectangles of one map (a bounded report) as an SVG document."""
    body = "".join(f'<rect x="{x * scale}" y="{y * scale}" width="{w * scale}" height="{h * scale}"><title>{html.escape(d)}</title></rect>' for d, x, y, w, h in cells)
    return f'<svg xmlns="http://www.w3.org/2000/svg">{body}</svg>'


def signatures(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line_no, text) of declaration lines and of those that follow while round brackets are open, eight at most."""
    delta = F.char_length(F.replace("text", F.lit("("), F.lit("((")))- F.char_length(F.replace("text", F.lit(")"), F.lit("))")))
    starts = symbols.select("path", F.col("line").alias("line_no")).distinct().withColumn("opens", F.lit(True))
    w = Window.partitionBy("path").orderBy("line_no")
    marked = lines.join(starts, ["path", "line_no"], "left").withColumn("start", F.last(F.when(F.col("opens"), F.col("line_no")), ignorenulls=True).over(w))
    block = Window.partitionBy("path", "start").orderBy("line_no")
    before = F.sum(delta).over(block.rowsBetween(Window.unboundedPreceding, -1))
    closed = F.max(F.when(F.col("before") <= 0, 1).otherwise(0)).over(block)
    inside = marked.where("start is not null").withColumn("before", before).withColumn("closed", closed)
    return inside.where((F.col("line_no") == F.col("start")) | ((F.col("closed") == 0) & (F.col("line_no") - F.col("start") <= CONTINUATION))).select("path", "line_no", F.rtrim("text").alias("text"))


#: Lines of a public interface by language (fixed values).
PUBLIC = (
    ("go", r"^(?:package |import |func (?:\([^)]*\) )?[A-Z]|type [A-Z]|const [A-Z]|var [A-Z])"),
    ("ts|tsx|js|jsx|mjs", r"^\s*(?:import |export )"),
    ("py", r"^(?:import |from |def [A-Za-z]|class [A-Za-z]|async def [A-Za-z])"),
)


def public_lines(lines: DataFrame) -> DataFrame:
    """Lines of imports and exported declarations; languages without rules keep none."""
    ext = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    keep = F.lit(False)
    for endings, pattern in PUBLIC:
        keep = keep | (ext.rlike(f"^(?:{endings})$") & F.col("text").rlike(pattern))
    return lines.where(keep)


def skim(files: DataFrame, symbols: DataFrame, budget: int) -> DataFrame:
    """(path, tier, tokens): the whole file if it fits, else its symbol lines; an outline always stands, over budget or not."""
    entry = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "kind", F.lit(" "), "name", F.lit("\n"))
    listed = symbols.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", entry.alias("e"))))["e"], "").alias("list"))
    rows = files.join(listed, "path", "left").select("path", "body", F.coalesce("list", F.lit("(no public symbols)\n")).alias("list"), F.coalesce("list", F.lit("(no symbols)\n")).alias("outline"))
    whole, short, last = (T.size_tokens(F.octet_length(c)) for c in ("body", "list", "outline"))
    tier = F.when(whole <= budget, "full").when(short <= budget, "api+doc").otherwise("outline")
    return rows.select("path", tier.alias("tier"), F.when(tier == "full", whole).when(tier == "api+doc", short).otherwise(last).alias("tokens"))
