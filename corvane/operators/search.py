"""Explainable search over files, lines and symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Points (fixed values).
STEM, FOLDER, SYMBOL, PART, LINE = 12, 6, 10, 6, 3
#: Share of the points a synonym has (fixed value).
SYNONYM = 0.7


def _points(base: int, synonym: bool) -> int:
    return int(base * SYNONYM + 0.5) if synonym else base


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("long")


def keyword_scores(files: DataFrame, lines: DataFrame, symbols: DataFrame, terms: list[str], synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, basename, path_score, symbol, splitname, content) for every path that scores.

    Terms go in sorted order: of several that a line or a symbol holds, the first alone scores. Line sums and symbol sums
    are partial aggregates on path, so nothing but sums is shuffled.
    """
    marks = dict.fromkeys(terms, False)
    for term in terms:
        for other in (synonyms or {}).get(term, []):
            marks.setdefault(other.lower(), True)
    words = sorted(marks)
    stem, folder, parts = F.lower(T.stem(F.col("path"))), F.lower(T.dirname(F.col("path"))), T.identifier_parts(T.stem(F.col("path")))
    named = files.select(
        "path",
        _sum([F.when(stem.contains(w), _points(STEM, marks[w])).otherwise(0) for w in words]).alias("basename"),
        _sum([F.when((folder != ".") & folder.contains(w), _points(FOLDER, marks[w])).otherwise(0) for w in words]).alias("path_score"),
        _sum([F.when(~stem.contains(w) & F.array_contains(parts, w), _points(PART, marks[w])).otherwise(0) for w in words]).alias("stem_part"),
    )
    low, name = F.lower("text"), F.lower("name")
    first_line, first_symbol = F.lit(0), F.lit(0)
    for w in reversed(words):
        first_line = F.when(low.contains(w), _points(LINE, marks[w])).otherwise(first_line)
        first_symbol = F.when(name.contains(w), _points(SYMBOL, marks[w])).otherwise(first_symbol)
    any_line = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    content = lines.where(any_line).groupBy("path").agg(F.sum(first_line).cast("long").alias("content"))
    own = T.identifier_parts(F.col("name"))
    split = _sum([F.when(F.array_contains(own, w), _points(PART, marks[w])).otherwise(0) for w in words])
    held = symbols.groupBy("path").agg(F.sum(first_symbol).cast("long").alias("symbol"), F.sum(split).cast("long").alias("symbol_part"))
    scored = named.join(held.where("symbol + symbol_part > 0"), "path", "left").join(content, "path", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("symbol", "symbol_part", "content")}
    return scored.withColumns(zero).select("path", "basename", "path_score", "symbol", (F.col("stem_part") + F.col("symbol_part")).alias("splitname"), "content")


def search(files: DataFrame, lines: DataFrame, symbols: DataFrame, query: str, limit: int = 10, require_all: bool = False, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """The `limit` best paths with their breakdown: score, then path. require_all: each term is found somewhere."""
    terms = T.query_terms(query)
    scored = keyword_scores(files, lines, symbols, terms, synonyms)
    total = F.col("basename") + F.col("path_score") + F.col("symbol") + F.col("splitname") + F.col("content")
    scored = scored.withColumn("score", total).where("score > 0")
    if require_all:
        scored = scored.join(paths_with_all(files, lines, symbols, terms, synonyms), "path", "left_semi")
    return scored.orderBy(F.desc("score"), "path").limit(limit)


def paths_with_all(files: DataFrame, lines: DataFrame, symbols: DataFrame, terms: list[str], synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Paths where every term, or a synonym of it, is in the stem, folder, a symbol or a line."""
    sets = [[t, *[s.lower() for s in (synonyms or {}).get(t, [])]] for t in terms]

    def hits(text: Column) -> list[Column]:
        return [reduce(lambda a, b: a | b, [text.contains(w) for w in s]).alias(f"t{k}") for k, s in enumerate(sets)]

    folder = F.lower(T.dirname(F.col("path")))
    named = F.concat_ws("\n", F.lower(T.stem(F.col("path"))), F.when(folder != ".", folder))
    found = files.select("path", *hits(named)).unionAll(lines.select("path", *hits(F.lower("text")))).unionAll(symbols.select("path", *hits(F.lower("name"))))
    each = found.groupBy("path").agg(*[F.max(f"t{k}").alias(f"t{k}") for k in range(len(sets))])
    return each.where(reduce(lambda a, b: a & b, [F.col(f"t{k}") for k in range(len(sets))])).select("path")


def literal_scores(files: DataFrame, lines: DataFrame, symbols: DataFrame, literal: str) -> DataFrame:
    """(path, literal): case-sensitive containment of one string; paths without are left out."""
    named = files.select("path", (F.when(T.stem(F.col("path")).contains(literal), STEM).otherwise(0) + F.when(T.dirname(F.col("path")).contains(literal), FOLDER).otherwise(0)).alias("n"))
    held = symbols.where(F.col("name").contains(literal)).select("path", F.lit(SYMBOL).alias("n"))
    said = lines.where(F.col("text").contains(literal)).select("path", F.lit(LINE).alias("n"))
    return named.unionAll(held).unionAll(said).groupBy("path").agg(F.sum("n").cast("long").alias("literal")).where("literal > 0")


def regex_scores(lines: DataFrame, pattern: str) -> DataFrame:
    """(path, regex): three points for each line that matches; paths without are left out."""
    return lines.where(F.col("text").rlike(pattern)).groupBy("path").agg((F.count("*") * LINE).cast("long").alias("regex"))


def suggest(files: DataFrame, symbols: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Names near a term: (name, kind, distance), within max(2, a third of the term), nearest first.

    Names are made distinct before any distance is taken; terms are driver values, a column each, never a cross join.
    """
    terms = T.query_terms(query)
    stems = files.select(F.lower(T.stem(F.col("path"))).alias("name"), F.lit("file").alias("kind"), F.lit(0).alias("k"))
    names = symbols.select(F.lower("name").alias("name"), F.lit("symbol").alias("kind"), F.lit(1).alias("k"))
    each = stems.unionAll(names).groupBy("name").agg(F.min_by("kind", "k").alias("kind"))
    far = [F.levenshtein(F.col("name"), F.lit(t), max(2, len(t) // 3)) for t in terms]
    near = [F.when(d > 0, d) for d in far]
    distance = F.least(*near) if len(near) > 1 else near[0]
    found = each.withColumn("distance", distance).where("distance is not null")
    return found.orderBy("distance", F.octet_length("name"), "name").limit(limit).select("name", "kind", "distance")


def matches(lines: DataFrame, query: str, around: int = 1) -> DataFrame:
    """(path, line_no, byte_column, text, before, after) of each line that holds a term; the first term in sorted order counts."""
    words = sorted(T.query_terms(query))
    low = F.lower("text")
    column = F.lit(None).cast("int")
    for w in reversed(words):
        column = F.when(low.contains(w), T.byte_column(F.col("text"), F.lit(w))).otherwise(column)
    w = Window.partitionBy("path").orderBy("line_no")
    near = lines.select(
        "path", "line_no", column.alias("byte_column"), "text",
        F.collect_list("text").over(w.rowsBetween(-around, -1)).alias("before"), F.collect_list("text").over(w.rowsBetween(1, around)).alias("after"),
    )
    return near.where("byte_column is not null")


def anchor(files: DataFrame, symbols: DataFrame, raw: str) -> DataFrame:
    """(kind, path, candidates) of an anchor: the only definition of a symbol; else, where none is, the first file of that name, else that path.

    Several definitions give one row of kind `ambiguous`; nothing found gives no row.
    """
    cleaned = "/".join(p for p in raw.replace("\\", "/").split("/") if p not in ("", "."))
    defined = symbols.where(F.col("name") == raw).agg(F.min("path").alias("path"), F.count("*").alias("n"))
    first = defined.where("n > 0").select(F.lit(0).alias("k"), F.when(F.col("n") == 1, "symbol").otherwise("ambiguous").alias("kind"), F.when(F.col("n") == 1, F.col("path")).alias("path"), F.col("n").alias("candidates"))
    named = files.where(T.basename(F.col("path")) == raw).agg(F.min("path").alias("path")).where("path is not null").select(F.lit(1), F.lit("basename"), "path", F.lit(1).cast("long"))
    exact = files.where(F.col("path") == cleaned).agg(F.min("path").alias("path")).where("path is not null").select(F.lit(2), F.lit("path"), "path", F.lit(1).cast("long"))
    return first.unionAll(named).unionAll(exact).orderBy("k").limit(1).drop("k")


def reasons(files: DataFrame, lines: DataFrame, symbols: DataFrame, query: str) -> DataFrame:
    """(path, reason): what each path matched, in the order symbol, splitname, content, basename, path; values comma-joined.

    Values are terms, but for symbols, which go by name in order of line. A line or symbol counts for its first term only.
    """
    words = sorted(T.query_terms(query))
    low, name = F.lower("text"), F.lower("name")
    first = F.lit(None).cast("string")
    for w in reversed(words):
        first = F.when(low.contains(w), w).otherwise(first)
    said = lines.select("path", first.alias("w"), "line_no").where("w is not null").groupBy("path", "w").agg(F.min("line_no").alias("n"))
    content = said.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "w")))["w"], ", ").alias("content"))
    hit = reduce(lambda a, b: a | b, [name.contains(w) for w in words])
    held = symbols.where(hit).groupBy("path", "name").agg(F.min("line").alias("n"))
    named = held.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "name")))["name"], ", ").alias("symbol"))
    stem, folder, parts = F.lower(T.stem(F.col("path"))), F.lower(T.dirname(F.col("path"))), T.identifier_parts(T.stem(F.col("path")))

    def listed(tests: list[Column]) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(t, w) for t, w in zip(tests, words, strict=True)])), ", ")

    own = files.select(
        "path", listed([stem.contains(w) for w in words]).alias("base"), listed([(folder != ".") & folder.contains(w) for w in words]).alias("dir"),
        listed([~stem.contains(w) & F.array_contains(parts, w) for w in words]).alias("split"),
    )
    rows = own.join(content, "path", "left").join(named, "path", "left")

    def part(label: str, column: str) -> Column:
        return F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(label + " match: "), column))

    text = F.concat_ws("; ", part("symbol", "symbol"), part("splitname", "split"), part("content", "content"), part("basename", "base"), part("path", "dir"))
    return rows.select("path", text.alias("reason")).where("reason <> ''")


def parse_results(raw: DataFrame) -> DataFrame:
    """(id, value) search results as JSON, or path lines -> (id, ord, path): JSON by falling score, lines without comments; the first of equal paths."""
    schema = "array<struct<path:string,score:bigint>>"
    is_json = F.trim("value").startswith("[")
    hits = F.array_sort(
        F.transform(F.from_json("value", schema), lambda x, i: F.struct((-F.coalesce(x["score"], F.lit(0))).alias("k"), i.alias("i"), x["path"].alias("path")))
    )
    found = F.when(is_json, hits["path"]).when(F.trim("value") == "null", F.array().cast("array<string>")).otherwise(
        F.filter(F.transform(T.split_lines(F.col("value")), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#"))
    )
    each = raw.select("id", F.posexplode(found).alias("ord", "p")).withColumn("path", T.clean_path(F.col("p")))
    return each.groupBy("id", "path").agg(F.min("ord").alias("ord"))
