"""URL verdicts: host and path rules, then a blocked Bloom filter backed by an exact join.

Everything here is DataFrame expressions. The filter is a split-block Bloom filter: 256-bit blocks
of eight 32-bit words; a canonical URL sets one bit in each word of one block. It is itself a table
of blocks, built by one ``bit_or`` aggregation, so it has no size limit of its own. Only URLs whose
eight bits are all set go on to the hash join with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.stage import Scratch

WORDS = 8
#: Bits a listed URL gets in the filter; 16 give about one false positive in a thousand.
BITS_PER_URL = 16
#: The blocks are broadcast up to this size (32 bytes a block, known from the list's count) and joined by shuffle above it.
BROADCAST_BYTES = 64 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and path without ``.html`` or ``/`` at its end; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html|/)$", "")))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. Rules are (verdict, text) with text like ``example.org/en/``.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | F.endswith(host, F.lit("." + text[:at]))) & F.startswith(path, F.lit(text[at:]))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _places(url: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """A URL's block, and for each word the bit it sets (two independent 64-bit hashes)."""
    block, bits = F.pmod(F.xxhash64(url), F.lit(n_blocks)), F.xxhash64(url, F.lit("bits"))
    return block, [F.shiftrightunsigned(bits, 5 * i).bitwiseAND(31).cast("int") for i in range(WORDS)]


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def build_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks (block, w0 .. w7) of the distinct non-null URLs in column ``canonical``."""
    block, bits = _places(F.col("canonical"), n_blocks)
    return listed.groupBy(block.alias("block")).agg(*[F.bit_or(_mask(b)).alias(f"w{i}") for i, b in enumerate(bits)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages.

    The verdict is the longest fitting rule's; without one it is ``block`` if the canonical URL is in
    ``listed`` (one column, canonical URLs, nulls and repeats allowed), else ``allow``. Null ids, null
    urls and repeated rows give a row each. An empty list blocks nothing.
    """
    scratch = Scratch(pages.sparkSession, "urlfilter")
    listed = scratch.keep(listed.select(F.col(listed.columns[0]).alias("canonical")).filter(F.col("canonical").isNotNull()).distinct(), "listed")
    n_blocks = max(1, -(-listed.count() * BITS_PER_URL // (32 * WORDS)))
    blocks = build_filter(listed, n_blocks)
    if n_blocks * 4 * (WORDS + 1) * 2 <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    else:
        blocks = scratch.keep(blocks, "blocks")  # both sides of the join are then plain shuffles, which adaptive execution can split

    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    canonicals = F.when(rule.isNull(), canonical(F.col("host"), F.col("path")))
    urls = urls.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), canonicals.alias("canonical"))

    block, bits = _places(F.col("canonical"), n_blocks)
    # what isn't asked for, by a rule or for want of a host, is spread over blocks that aren't there
    nowhere = -1 - F.pmod(F.xxhash64("id", "path"), F.lit(n_blocks))
    probed = urls.withColumn("block", F.when(F.col("canonical").isNotNull(), block).otherwise(nowhere)).join(blocks, "block", "left")
    hit = F.lit(True)
    for i, bit in enumerate(bits):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(_mask(bit)) != 0)
    probed = probed.select("id", "host", "path", "rule", "verdict", "canonical", F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False)).alias("hit"))

    settled = probed.filter(~F.col("hit")).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    exact = probed.filter("hit").join(listed.withColumn("is_listed", F.lit(True)), "canonical", "left")
    exact = exact.withColumn("verdict", F.when(F.col("is_listed"), "block").otherwise("allow"))
    out = ["id", "host", "path", "rule", "verdict"]
    return settled.select(out).unionAll(exact.select(out)).withColumnRenamed("id", id_col)
