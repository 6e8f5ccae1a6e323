"""URL filter: host and path rules first, then a list of canonical URLs.

The list becomes a blocked Bloom filter: one row of four 64-bit words per
block, two bits per word and key, built with bit_or.  A page meets one block
only.  Pages whose bits are all set are possible hits and go to an exact hash
join with the list; the others never move.  Column expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import let, lower_ascii

BITS_PER_KEY = 16
BLOCK_BITS = 256
WORDS = 4
# A filter of more blocks (48 bytes a row) is joined by block instead of broadcast.
BROADCAST_BLOCKS = 400_000

# Query parameters that do not change the page.
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; '' without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without index page and final slash,
    query sorted and without tracking parameters.  Null without a host part."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"/index\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(F.lit("")))
    return F.when(url.contains("://"), F.concat(host, path, tail))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one.

    `rules` are (verdict, host/path) pairs and part of the plan: a short list.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the words of the key's block."""

    def bit(code: str, k: int) -> Column:
        return F.expr(f"shiftleft(1L, cast(shiftrightunsigned({code}, {6 * k}) & 63 as int))")

    code = "xxhash64(_key, 1)"
    return [bit(code, 2 * w).bitwiseOR(bit(code, 2 * w + 1)) for w in range(WORDS)]


def bloom_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """(table of _block and words, number of blocks) over the distinct `_key` values."""
    blocks = max(1, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS))
    words = [m.alias(f"_m{w}") for w, m in enumerate(_masks(F.col("_key")))]
    filled = keys.select(_block(F.col("_key"), blocks).alias("_block"), *words)
    return filled.groupBy("_block").agg(*[F.bit_or(f"_m{w}").alias(f"_w{w}") for w in range(WORDS)]), blocks


def possible_hits(rows: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """`rows` (with `_key`, null for none) plus `_possible`."""
    small = F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table
    # without a key a row still gets a block, or all such rows would meet in one task
    spot = F.coalesce(_block(F.col("_key"), blocks), F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    joined = rows.withColumn("_block", spot).join(small, "_block", "left")
    inside = F.lit(True)
    for w, mask in enumerate(_masks(F.col("_key"))):
        inside = inside & (F.col(f"_w{w}").bitwiseAND(mask) == mask)
    return joined.withColumn("_possible", F.col("_key").isNotNull() & F.coalesce(inside, F.lit(False))).drop(
        "_block", *[f"_w{w}" for w in range(WORDS)]
    )


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """`pages` plus host, path, rule, listed and verdict.

    `listed` holds the listed pages' URLs in a column `url`.  The verdict is that
    of the longest rule that fits; else block for a listed canonical URL and allow
    otherwise.  Null URLs and those without :// have empty host and path and are
    never listed.  Every row stays, repeated ones too; columns of `pages` named
    like the added ones are replaced.
    """
    keys = listed.select(canonical(F.col("url")).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    table, blocks = bloom_filter(keys)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = (
        pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url)), "_key": canonical(F.col(url))})
        .withColumns({"rule": rule, "_verdict": verdict})
    )
    probed = possible_hits(judged, table, blocks)
    exact = keys.select(F.col("_key").alias("_listed"))
    hits = probed.filter("_possible").join(exact, F.col("_key") == F.col("_listed"), "left")
    hits = hits.withColumn("listed", F.col("_listed").isNotNull()).drop("_listed")
    both = probed.filter("NOT _possible").withColumn("listed", F.lit(False)).unionByName(hits)
    decided = F.coalesce("_verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return both.withColumn("verdict", decided).drop("_key", "_verdict", "_possible")
