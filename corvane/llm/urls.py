"""URL rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import materialize, spread_join

RULES = "host string, path string, action string"
ALLOW, BLOCK = "allow", "block"
#: Hex digits of the digest that rows and rules are joined on.
PREFIX_DIGITS = 8


def split_url(urls: DataFrame) -> DataFrame:
    """(url) -> (url, host, path). Host: from the first `://` to `/`, `?`, `#` or the end, A-Z in lower case; path: then up to `?` or `#`.

    A null url or one without `://` has both empty.
    """
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return urls.select("url", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


def labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def expressions(parts: DataFrame, lengths: list[int], sizes: list[int]) -> DataFrame:
    """(url, host, path) -> (url, digest): host suffixes of a number of labels, with path prefixes of a length, that rules have."""
    suffixes = F.filter(F.array(*[F.when(labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in sizes]), lambda s: s.isNotNull())
    wanted = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length("path"))
    hosts = parts.where("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix"), wanted.alias("wanted"))
    each = hosts.select("url", "suffix", "path", F.explode("wanted").alias("n"))
    whole = each.select("url", F.concat("suffix", F.lit("\n"), F.substr("path", F.lit(1), F.col("n"))).alias("expression"))
    return whole.select("url", F.sha2("expression", 256).alias("digest"))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """(url) and rules (host, path, action) -> (url, host, path, rule, verdict) for each distinct url, null included.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest (host and path, then host)
    wins; of equal rules block wins. Rows meet rules on a short digest prefix, equally, and the full digest confirms,
    so neither side need be small; Spark broadcasts the rules only if they are. The path lengths and numbers of host labels
    that occur in rules come to the driver: at most as many as the longest rule has characters, however long the urls are. No rule: `default` and a null rule.
    """
    distinct = urls.select("url").distinct()
    parts = split_url(distinct)
    known = rules.where("host is not null").select(F.lower("host").alias("h"), F.coalesce("path", F.lit("")).alias("p"), "action")
    lengths = sorted(r["n"] for r in known.select(F.char_length("p").alias("n")).distinct().collect())
    sizes = sorted(r["n"] for r in known.select(labels(F.col("h")).alias("n")).distinct().collect())
    whole = F.sha2(F.concat("h", F.lit("\n"), "p"), 256)
    known = known.select(
        F.concat("h", "p").alias("rule"), "action", F.char_length("h").alias("size"), whole.alias("full"),
        F.substring(whole, 1, PREFIX_DIGITS).alias("short"),
    )
    if not lengths:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    probes = expressions(parts, lengths, sizes).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    hits = probes.join(known, "short").where(F.col("digest") == F.col("full"))
    rank = F.struct(F.char_length("rule").alias("n"), "size", (F.col("action") == BLOCK).alias("block"), "rule", "action")
    best = hits.groupBy("url").agg(F.max(rank).alias("best")).select(F.col("url").alias("hit_url"), F.col("best.rule").alias("rule"), "best.action")
    joined = parts.join(best, parts["url"] == best["hit_url"], "left")
    return joined.select("url", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """(page_id, url) -> (page_id, url, host, path, rule, verdict), a row for each input row; other columns are ignored.

    Each distinct url is judged once, and a url that very many pages share is joined by broadcast (spread_join), so it
    is no more work than another. Pages with a null url are judged in place, without a join.
    """
    rows = pages.select("page_id", "url")
    counts = rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n_rows"))
    judged = materialize(judge_urls(counts.select("url"), rules, default).join(counts, "url"), "judged")
    told = spread_join(rows, judged, "url", "n_rows", pages.count())
    none = rows.where("url is null").withColumns({"host": F.lit(""), "path": F.lit(""), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    columns = ["page_id", "url", "host", "path", "rule", "verdict"]
    return told.select(*columns).unionAll(none.select(*columns))
