"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import chat, crosstok, jaccard, langid, licenses, media, mixing, packing, quality, secrets, simhash, urls, whitening

#: URL rules of the registered query (fixed values).
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Both turns of the added conversation -1 (fixed value).
PROBE = "</s>[INST] ok [/INST]"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), urls.RULES)
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.license", ",").alias("license_ids"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"), x["sentences"])), ",").alias("matches"),
    )


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.features(media.store(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("cosine_hash")).alias("feature")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def _when_kind(kind: str, found: Column) -> Column:
    return F.when(found == kind, found)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.STRONG))
    written_base = F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    counts = [F.size(F.array_compact(F.transform("secrets.kind", partial(_when_kind, kind)))).cast("long").alias(f"n_{kind}") for kind in secrets.STRONG]
    return found.select("doc_id", *counts, F.sha2(F.array_join(written_base, ","), 256).alias("base_sha256"), F.array_join(written, ",").alias("spans"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, domains, totals = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    posteriors = [F.get("p", F.lit(k)).alias("p_" + d.replace("=", "").replace(",", "_")) for k, d in enumerate(domains)]
    return rated.select("doc_id", "n_tokens", *posteriors, "rate", "copies", F.lit(totals.met).alias("targets_met"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    return chat.digests(chat.format_examples(turns.unionByName(probe)))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return crosstok.align(table(spark, sf_dir, "documents"), *paths)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_url_filter, op3_license_scan, op4_media_columns, op5_simhash, op6_best_fit_packing,
        op7_language_id, op8_secret_scan, op9_source_mixing, op10_chat_formatting, op11_ngram_jaccard,
        op12_cross_tokenizer, op13_whitening,
    )
}

_ESCAPED = r"regexp_replace(regexp_replace({0}, '(</?)(\\*s>)', '\1\\\2', 'g'), '(\[/?)(\\*INST\])', '\1\\\2', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": f"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') as path from parts),
rules(h, p, action) as (values {", ".join(str(r) for r in URL_RULES)}),
fit as (
  select s.page_id, s.host, s.path, h || p as rule, action,
    row_number() over (partition by s.page_id, s.host, s.path order by length(h || p) desc, length(h) desc, action desc) as k
  from (select distinct page_id, host, path from split) s join rules on (s.host = h or ends_with(s.host, '.' || h)) and starts_with(s.path, p))
select s.page_id, s.host, s.path, f.rule, coalesce(f.action, 'allow') as verdict
from split s left join (select * from fit where k = 1) f
  on s.page_id is not distinct from f.page_id and s.host = f.host and s.path = f.path
""",
    "op10_chat_formatting": f"""
with turns as (
  select conv_id, case when conv_id is null then row_number() over () end as lone, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, null, 0, 'user', '{PROBE}'), (-1, null, 1, 'assistant', '{PROBE}')),
sized as (
  select *, 17 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) as n,
    row_number() over (partition by conv_id, lone order by turn, role, text) as k,
    count(*) over (partition by conv_id, lone) as many from turns),
running as (select *, 3 + sum(n) over (partition by conv_id, lone order by k) as upto from sized)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (where role = 'assistant' or k = many) as bigint) as formatted_chars
from running group by conv_id, lone
""",
}
