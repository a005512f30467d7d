"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import (
    budgets, circulant, class_lm, collocations, dialogue, quantised, redirects, risk_rules, token_files, trie_counts,
    vector_fit, warc, wrappers,
)

# Word-level ids end a document with 2, byte-level ids with 0.
WORD_END, BYTE_END = 2, 0

MIX_PATH = ("domain", "lang", "source")
# Domains of the mixture; a source belongs to the domain of its number modulo four, as the tables name no domain.
MIX_WEIGHTS = {
    ("d0",): 3.0, ("d1",): 2.0, ("d2",): 2.0, ("d3",): 1.0,
    **{(d, lang): w for d in ("d0", "d1", "d2", "d3") for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))},
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 9

# Rules on urls (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.size(F.filter(
        F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def domain_of(source: str = "source") -> Column:
    digits = F.regexp_extract(F.coalesce(F.col(source).cast("string"), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(digits == "", F.lit(0)).otherwise(F.try_to_number(digits, F.lit("999999999")) % 4).cast("int").cast("string"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))

    def id_of(name: str) -> Column:
        digits = F.regexp_extract(name, r"^<urn:page:(-?[0-9]+)>$", 1)
        return F.when(digits != "", digits).cast("long")

    return warc.read_records(spark, packages).select(
        id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        id_of("refers_to").alias("refers_to"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op4_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), WORD_END)
    return token_files.token_ranges(token_files.read_tokens(spark, path))


def op6_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found, name = risk_rules.judged(docs, table(spark, sf_dir, "labels"))
    m = F.col(name)
    return found.select("doc_id", *[m[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op8_vector_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_fit.packed_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), BYTE_END)


def op9_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain_of()).withColumn("n_tokens", word_count())
    return budgets.mixed(
        docs, MIX_PATH, F.col("n_tokens"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED
    ).select("doc_id", *MIX_PATH, "n_tokens", "n_copies")


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return class_lm.class_scores(table(spark, sf_dir, "documents"), held_out)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a hash of conversation and turn."""
    space = F.lit(" ")
    code = F.crc32(F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    ).cast("binary")) % 20
    text = F.coalesce(F.col("text"), space)
    return turns.withColumn("_code", code).filter("_code <> 0").select(
        "conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_code") == 3, 2).otherwise(1))).alias("copy"))


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = dialogue.summaries(dialogue.repaired_turns(damaged(turns)))
    every = turns.select("conv_id").distinct().withColumn("c", dialogue.key_of(F.col("conv_id")))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "c", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found, name = redirects.judged(pages.select("page_id", "url"), redirects.page_links(pages), rules)
    return found.select("page_id", f"{name}.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc, op2_vectors, op3_wrappers, op4_unigram_counts, op5_token_files, op6_circulant, op7_risk_rules,
        op8_vector_fit, op9_budgets, op10_class_lm, op11_dialogue,
        op12_collocations, op13_redirects)
}

# Absolute links only, which is what the tables may hold; page_links itself is tested against a brute-force reading.
OP13_SQL = r"""
with recursive rules(rh, rp, verdict) as (
    values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
tags as (
    select url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'),
        '(?i)<(?:link|meta)\s[^>]*>')) as tag
    from pages where url is not null),
links as (
    select url, case
        when regexp_matches(tag, '(?i)^<link\s.*\brel\s*=\s*["'']?canonical\b')
        then regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?(https?://[^"''\s>]+)', 1)
        when regexp_matches(tag, '(?i)^<meta\s.*\bhttp-equiv\s*=\s*["'']?refresh\b')
        then regexp_extract(tag, '(?i)\burl\s*=\s*["'']?(https?://[^"''\s>]+)', 1) end as target
    from tags),
named as (
    select distinct url,
        case when strpos(url, '://') > 0 then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
            else '' end as path,
        case when strpos(url, '://') > 0 then
            regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*(\?[^#]*)', 1) end as query
    from (select url from pages union all select target from links where target <> '')),
placed as (
    select *, case when query is not null then
        lower(split_part(url, '://', 1)) || '://' || regexp_replace(host, case when lower(url) like 'https:%' then ':443$' else ':80$' end, '')
        || case when path = '' then '/' else path end || query end as node
    from named),
fits as (
    select url, max_by(rh || rp, length(rh || rp)) as rule, max_by(verdict, length(rh || rp)) as verdict
    from placed join rules on ('.' || host) like ('%.' || rh) and starts_with(path, rp) group by url),
edges as (
    select distinct a.node as u, b.node as v from links join placed a on links.url = a.url join placed b on links.target = b.url
    where a.node <> b.node),
both_ways as (select u, v from edges union select v, u from edges),
reach(start, node) as (
    select u, u from both_ways union select start, v from reach join both_ways on reach.node = both_ways.u),
aliases as (
    select start, min(verdict) as verdict from reach join placed on placed.node = reach.node join fits on fits.url = placed.url
    group by start)
select page_id, host, path, rule, coalesce(fits.verdict, aliases.verdict, 'allow') as verdict
from pages left join placed on pages.url is not distinct from placed.url left join fits on placed.url = fits.url
    left join aliases on aliases.start = placed.node
"""

ORACLES: dict[str, str] = {"op13_redirects": OP13_SQL}
