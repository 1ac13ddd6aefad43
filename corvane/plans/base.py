"""The register, table readers, and the SQL of the adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FILES = """files as (select concat(source, '/', lang, '/doc_', doc_id, '.md') as path, coalesce(text, '') as body, n_chars as size,
  greatest(strlen(coalesce(text, '')) // 4, 1) as tokens from documents)"""
LINES = FILES + """,
parts as (select path, regexp_split_to_array(body, '\\r?\\n') as p from files),
cut as (select path, case when p[len(p)] = '' then p[1:len(p) - 1] else p end as p from parts),
lines as (select path, u.i as line_no, p[u.i] as text from cut, unnest(range(1, len(p) + 1)) as u(i))"""
SYMBOLS = LINES + """,
symbols as (select path, regexp_extract(text, '[A-Z][a-z]+') as name, 'word' as kind, line_no as line from lines where regexp_matches(text, '[A-Z][a-z]+'))"""
COMMITS = """commits as (select o_orderkey as "commit", o_orderdate as "at", o_custkey as author, o_orderpriority like '1%' as root from orders),
commit_files as (select l_orderkey as "commit", l_partkey as path, sum(cast(floor(l_quantity) as bigint)) as added,
  sum(case when l_returnflag = 'R' then cast(floor(l_quantity) as bigint) else 0 end) as deleted,
  case when bool_or(l_returnflag = 'R') then 'D' when bool_or(l_returnflag = 'A') then 'A' else 'M' end as status from lineitem group by all)"""


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_files(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines_of(files(spark, sf_dir))


def gathered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gathered_lines(files(spark, sf_dir))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.word_symbols(lines(spark, sf_dir))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.order_commits(table(spark, sf_dir, "orders"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lineitem_files(table(spark, sf_dir, "lineitem"))
