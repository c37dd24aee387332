"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of eight 32-bit words.  A URL's hash picks one block and one bit in
each of its words, so one lookup decides whether the URL can be listed.  Only possible hits reach
the exact hash join with the list, which removes the false positives.  Building, probing and joining
are built-in column functions throughout.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is
listed only if the list holds the empty string; null entries of the list are dropped; listed URLs may repeat; rows may repeat and are judged one by one.  An empty table gives no rows; of
clashing rules the longest wins; a URL of any length is taken whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Odd multipliers, one for each word of a block.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
BITS_PER_KEY, BLOCK_BITS = 16, 256
#: A filter of more bytes isn't broadcast but joined by block.
BROADCAST_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def canonical(host: Column, path: Column) -> Column:
    """Host and path without trailing slashes; scheme, query and fragment are dropped."""
    return F.concat(host, F.regexp_replace(path, r"/+$", ""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does.

    ``rules`` is a short list of (verdict, host, path): a literal CASE, evaluated without a join.
    """
    if len(rules) > 1000:
        raise ValueError("rules is a short policy list; put long lists into `listed`")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))  # 31 bits, so that no product exceeds a long
    bits = [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]
    return F.pmod(F.shiftright(h, 32), F.lit(blocks)), [F.pow(F.lit(2.0), b).cast("long") for b in bits]


def bloom(keys: DataFrame, key_col: str, blocks: int) -> DataFrame:
    """The filter: one row (_block, _w0 .. _w7) for each block that has a key."""
    block, words = _bits(F.col(key_col), blocks)
    cols = keys.select(block.alias("_block"), *(w.alias(f"_w{i}") for i, w in enumerate(words)))
    return cols.groupBy("_block").agg(*(F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(8)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "canonical", otherwise: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of every row of ``pages``, and whether the list was hit.

    ``listed`` holds canonical URLs to block.  The filter is broadcast while its size, known from the
    number of listed URLs, is at most ``BROADCAST_BYTES``; a larger one is joined by block.
    """
    listed = listed.select(F.col(listed_col).alias("_key")).where("_key is not null").distinct()
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // BLOCK_BITS))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "_said": verdict, "_key": canonical(F.col("host"), F.col("path"))})
    block, words = _bits(F.col("_key"), blocks)
    table = bloom(listed, "_key", blocks)
    table = F.broadcast(table) if blocks * 80 <= BROADCAST_BYTES else table
    names = [f"_b{i}" for i in range(8)]
    probed = urls.withColumn("_block", block).withColumns(dict(zip(names, words, strict=True))).join(table, "_block", "left")
    hit = F.lit(True)
    for i in range(8):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(F.col(f"_b{i}")) != 0)
    probed = probed.withColumn("_possible", F.coalesce(hit, F.lit(False))).select(id_col, "host", "path", "rule", "_said", "_key", "_possible")
    sure = probed.where("not _possible").withColumn("_listed", F.lit(False))
    exact = probed.where("_possible").join(listed.withColumn("_in", F.lit(True)), "_key", "left").withColumn("_listed", F.col("_in").isNotNull()).drop("_in")
    out = sure.unionByName(exact)
    return out.select(id_col, "host", "path", "rule", F.coalesce("_said", F.when(F.col("_listed"), "block").otherwise(otherwise)).alias("verdict"), F.col("_listed").alias("listed"))
