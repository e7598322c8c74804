"""URL rules by cascades of Bloom filters.

A URL's keys are its host suffixes joined with the prefixes of its path, of the label counts
and lengths that rules have. Level 1 of a cascade holds the listed keys; level 2 holds the
corpus's keys that level 1 takes wrongly; level 3 the listed keys that level 2 takes
wrongly; and so on until nothing is wrong. As the levels are built over every key that the
corpus has, a walk down them is an exact test for each of its keys, made by bit arithmetic
on literals: the pages are never joined with the list.

A list whose filters would pass ``max_bytes`` is dealt into parts by hash, each with cascades
of its own, which judge the pages one after the other.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule;
repeated rows are judged alike; of fitting rules of equal length the one with more labels
wins, and a key on both lists is blocked; very long URLs are hashed by the few prefixes that
rules have; an empty table or an empty list gives filters that take nothing; further columns
aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

#: (verdict, host, path): the longest host + path that fits wins.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, label_counts: Sequence[int], path_lengths: Sequence[int]) -> Column:
    """Keys (host suffix + path prefix) by which a rule could fit, longest first; as many as
    the distinct shapes of the rules, whatever the number of rules."""
    labels = F.split(host, r"\.", -1)
    keys = []
    for n in label_counts:
        suffix = F.substring_index(host, ".", -n)
        for m in path_lengths:
            fits = (host != "") & (F.size(labels) >= n) & (F.length(path) >= m)
            key = F.concat(suffix, F.substring(path, 1, m))
            keys.append(F.when(fits, F.struct((-F.length(key)).alias("o"), F.lit(-n).alias("n"), key.alias("key"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*keys))), lambda x: x["key"])


class BloomCascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both: one column ``key``).

    The filters go to the driver and into the plan as literals; their size depends on the
    list, never on the corpus's rows, and ``max_bytes`` bounds it."""

    def __init__(
        self,
        listed: DataFrame,
        universe: DataFrame,
        bits_per_key: int = 12,
        hashes: int = 4,
        max_bytes: int = 16 << 20,
        max_levels: int = 40,
    ):
        self.hashes, self.levels = hashes, []
        self.n_listed = 0
        universe = universe.select("key").where("key is not null").distinct()
        wanted = listed.select("key").where("key is not null").distinct()
        inside = universe.join(wanted, "key", "left_semi")
        outside = universe.join(wanted, "key", "left_anti")
        level = inside
        while True:
            n = level.count()
            if not self.levels:
                self.n_listed = n
            if not n:
                break
            if len(self.levels) >= max_levels:
                raise RuntimeError("the cascade doesn't end; two keys have equal hashes at every level")
            bits = 64 * math.ceil(max(64, n * bits_per_key) / 64)
            if bits // 8 > max_bytes:
                raise ValueError(f"a filter of {bits // 8} bytes is over max_bytes={max_bytes}; split the list")
            self.levels.append(self._filter(level, bits, len(self.levels)))
            # what this level takes wrongly, of the keys that the level above sends here
            other = outside if len(self.levels) % 2 else inside
            level = other.where(self._passes(F.col("key"), len(self.levels)))

    def _positions(self, key: Column, level: int, bits: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(self.hashes)]

    def _filter(self, keys: DataFrame, bits: int, level: int) -> list[int]:
        words = (
            keys.select(F.explode(F.array(*self._positions(F.col("key"), level, bits))).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        )
        out = [0] * (bits // 64)
        for r in words.toLocalIterator():
            out[r["word"]] = r["bits"]
        return out

    def _in(self, key: Column, level: int) -> Column:
        words = self.levels[level]
        held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded into one literal
        found = F.lit(True)
        for p in self._positions(key, level, 64 * len(words)):
            found = found & (F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found

    def _passes(self, key: Column, levels: int) -> Column:
        ok = F.lit(True)
        for i in range(levels):
            ok = ok & self._in(key, i)
        return ok

    def contains(self, key: Column) -> Column:
        """In level 1 and not in 2, or in 1 to 3 and not in 4, and so on."""
        found = F.lit(False) if len(self.levels) % 2 == 0 else F.lit(True)
        for i in range(len(self.levels) - 1, -1, -1):
            found = F.when(self._in(key, i), found).otherwise(F.lit(i % 2 == 1))
        return found


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    **cascade,
) -> DataFrame:
    """Verdict of every URL: that of the longest fitting rule, else ``default`` (what no
    cascade takes isn't listed)."""
    spark = pages.sparkSession
    label_counts = sorted({h.count(".") + 1 for _, h, _ in rules})
    path_lengths = sorted({len(p) for _, _, p in rules})
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), label_counts, path_lengths))
    # written once: every level of every cascade reads it, not the pages
    universe = written(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    listed = spark.createDataFrame([(v, h + p) for v, h, p in rules], "verdict string, key string")
    bits, most = cascade.get("bits_per_key", 12), cascade.get("max_bytes", 16 << 20)
    parts = max(1, math.ceil(2 * len(rules) * bits / 8 / most))
    part_of = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))
    nothing = F.lit(None).cast("struct<at: int, key: string, verdict: string>")
    keyed = keyed.withColumn("first", nothing)
    for n in range(parts):
        own = [df.where(part_of(F.col("key")) == n) if parts > 1 else df for df in (listed, universe)]
        lists = {verdict: BloomCascade(own[0].where(F.col("verdict") == verdict), own[1], **cascade) for verdict in ("block", "allow")}

        def verdict_of(k: Column, lists=lists, n=n) -> Column:
            told = F.when(lists["block"].contains(k), F.lit("block")).when(lists["allow"].contains(k), F.lit("allow"))
            return F.when(part_of(k) == n, told) if parts > 1 else told

        told = F.transform(F.col("keys"), lambda k, i: F.struct(i.alias("at"), k.alias("key"), verdict_of(k).alias("verdict")))
        found = F.get(F.filter(told, lambda x: x["verdict"].isNotNull()), F.lit(0))
        if parts > 1:
            keyed = written(keyed.withColumn("first", F.array_min(F.array_compact(F.array("first", found)))), "judged")
        else:
            keyed = keyed.withColumn("first", found)
    return keyed.select(
        "page_id",
        "host",
        "path",
        F.col("first")["key"].alias("rule"),
        F.coalesce(F.col("first")["verdict"], F.lit(default)).alias("verdict"),
    )


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, instr(coalesce(url, ''), '://') AS i, coalesce(url, '') AS url FROM pages
), split AS (
  SELECT page_id,
         CASE WHEN i > 0 THEN regexp_extract(substr(url, i + 3), '^([^/?#]*)', 1) ELSE '' END AS raw_host,
         CASE WHEN i > 0 THEN regexp_extract(substr(url, i + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM parts
), hosts AS (
  SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM split
), judged AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM hosts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
