"""The registered queries of the training-data operators, on the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import align, bpe, collision, disclosure, itq, minhash, mixing, oracles, phrases, repeats, tokenio, toxicity, urlfilter, wordpiece
from cohortlake.llm.stage import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_decoded=True)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return both.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Target entropy of the query's mixture, as a share of the highest.
ENTROPY_SHARE = 0.97


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, least_entropy_share=ENTROPY_SHARE, budget_share=1.0)
    return mixed.select("doc_id", "source", "n_tokens", "block", F.col("copies").cast("int").alias("copies"))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out())))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("sentences").alias("n_sentences"))


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The query's list: canonical URLs of pages with less HTML than this.
THIN_HTML_BYTES = 1_000


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = urlfilter.split_url(F.col("url"))
    thin = pages.filter(F.octet_length("html") < THIN_HTML_BYTES).select(urlfilter.canonical(host, path).alias("canonical"))
    return urlfilter.judge(pages, thin, URL_RULES)


OP5_SQL = rf"""
WITH rest AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, html, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html|/)$', '') END AS canonical FROM cut
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE strlen(html) < {THIN_HTML_BYTES} AND canonical IS NOT NULL
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule FROM named
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN canonical IN (SELECT canonical FROM listed) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-files').path}/ids"
    tokenio.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    docs = tokenio.read_ids(spark, path)
    return docs.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)


def op10_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin, inside = wordpiece.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), begin, inside)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.measure(table(spark, sf_dir, "documents"), first, second)


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.sanitise(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, (*disclosure.KINDS, disclosure.TERM)))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] < len(disclosure.KINDS))
    # of one parameter: Spark passes a second one the place in the array
    of_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(disclosure.KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside_percent=50, top=2000)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_vector_near_dedup": op4_vector_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_repeats": op6_repeats,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_token_files": op8_token_files,
    "op9_near_dedup": op9_near_dedup,
    "op10_wordpiece_counts": op10_wordpiece_counts,
    "op11_alignment": op11_alignment,
    "op12_disclosure": op12_disclosure,
    "op13_collocations": op13_collocations,
}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express in whole. A vocabulary is read when it is asked for, not on import."""
    begin, inside = wordpiece.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return {
        "op2_mixing": oracles.mixing(0, ENTROPY_SHARE, mixing.BLOCK_TOKENS, mixing.BLOCK_ROWS, mixing.HASH_BITS // 4),
        "op4_vector_near_dedup": oracles.vector_links(0.95),
        "op5_url_filter": OP5_SQL,
        "op9_near_dedup": oracles.near_documents(5, 85),
        "op10_wordpiece_counts": oracles.wordpiece_counts(begin, inside),
        "op13_collocations": oracles.collocations(10, 50, 2000),
    }
