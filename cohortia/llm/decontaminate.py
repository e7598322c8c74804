"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item is its windows of ``window`` consecutive words, a window the shingles of ``SHINGLE`` words
in it. Shingles are ordered by rarity, counted over the whole corpus; a document holds a window
only if it holds the window's rarest shingle, so that one (the prefix) is joined with the
documents' shingles. The window must then lie inside the document (length bound) at the one place
which the shingle's place in it allows (positional bound), and is verified there: every shingle
of the window must stand at its place. Shingles are joined and compared as their words, so that
is the window word for word.

Documents give only shingles that some item has: a Bloom filter of the items' shingles keeps the
others from leaving the scan; it has no false negatives and its false positives meet the join.
A shingle of very many places, or a window of very many documents, is spread over several tasks.

Cases: null text has no words, empty texts likewise; an item with fewer words than a window is
one window, one without words none; very long texts are rows of shingles like others; repeated
rows are judged alike, each for itself; of shingles equally rare the one of least words is the
prefix; items with equal texts are all named; empty tables give no rows or no hits; a null
doc_id is an id, a null item_id is left out; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import parted
from .common import forget, handing_back, spread_join, table, written
from .near_dup import gram_hashes, word_hashes

#: Words of a shingle (fewer in shorter windows).
SHINGLE = 5

#: A-Z to lower case; what isn't 0-9, a-z or beyond ASCII to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
#: Bits of a shingle's hash that give its places in the filter.
_SHIFTS = (0, 18, 36)


def fold_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def item_windows(benchmark: DataFrame, window: int, item_id: str, item_text: str) -> DataFrame:
    """name, w (128-bit hash of the window), size, k (words of a shingle), grams (its shingles in turn, each its hash and its words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch["name"], batch["text"]):
                words = fold_words(text)
                if not words:
                    continue
                size = min(window, len(words))
                k = min(SHINGLE, size)
                hashes = gram_hashes(word_hashes(words), k).view(np.int64).tolist()
                grams = [(h, b" ".join(words[i : i + k])) for i, h in enumerate(hashes)]
                for i in range(len(words) - size + 1):
                    w = hashlib.blake2b(b" ".join(words[i : i + size]), digest_size=16).digest()
                    out.append((name, w, size, k, grams[i : i + size - k + 1]))
            yield pd.DataFrame(out, columns=["name", "w", "size", "k", "grams"])

    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).cast("binary").alias("text"))
    kind = "name string, w binary, size int, k int, grams array<struct<h: bigint, gram: binary>>"
    return items.where("name is not null").mapInPandas(handing_back(run), kind)


def _filter(hashes: DataFrame, most_bytes: int) -> np.ndarray | None:
    """A Bloom filter of the shingles' hashes ``h`` as bytes of bits; none if it would pass ``most_bytes``."""
    n = hashes.count()
    bits = 1 << max(10, math.ceil(math.log2(16 * n + 1)))
    if bits > 8 * most_bytes:
        return None
    places = [F.shiftrightunsigned("h", s).bitwiseAND(F.lit(bits - 1)) for s in _SHIFTS]
    byte = hashes.select(F.explode(F.array(*places)).alias("p")).groupBy(F.shiftright("p", 3).alias("at"))
    got = byte.agg(F.bit_or(F.expr("shiftleft(1, cast(p & 7 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().astype(np.uint8)
    return out


def document_shingles(rows: DataFrame, sizes: list[int], held) -> DataFrame:
    """a, b (what names the row), p (place of the first word), gram (words), of the shingles that the filter lets through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for batch in batches:
            for start in range(0, len(batch), 256):
                x = batch.iloc[start : start + 256]
                words, n = [], []
                for text in x["text"]:
                    own = fold_words(text)
                    words += own
                    n.append(len(own))
                if not words:
                    continue
                h, n = word_hashes(words), np.array(n)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                for k in sizes:
                    if len(h) < k:
                        continue
                    grams = gram_hashes(h, k)
                    found = place[: len(grams)] + k <= n[row[: len(grams)]]
                    if bits is not None:
                        for shift in _SHIFTS:
                            at = (grams >> np.uint64(shift)) & np.uint64(8 * len(bits) - 1)
                            found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    found = np.flatnonzero(found)
                    if len(found):
                        of = row[found]
                        own = [b" ".join(words[i : i + k]) for i in found.tolist()]
                        yield pd.DataFrame({"a": x["a"].to_numpy()[of], "b": x["b"].to_numpy()[of], "p": place[found], "gram": own})

    return rows.mapInPandas(handing_back(run), "a bigint, b bigint, p bigint, gram binary")


def _keys(id_col: str, text_col: str) -> dict[str, Column]:
    """What names a row: rows of equal id and text are judged alike."""
    return {"a": F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull()), "b": F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))}


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int, filter_bytes: int, id_col: str, text_col: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """a, b, start, size, w of each window in each document; and name, w of each item and window."""
    spark = docs.sparkSession
    windows = written(item_windows(benchmark, window, item_id, item_text), "windows")
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # SHINGLE numbers at most
    each = windows.dropDuplicates(["w"]).select("w", "size", F.posexplode("grams").alias("r", "x")).select("w", "size", "r", "x.h", "x.gram")
    bits = _filter(each.select("h").distinct(), filter_bytes)
    held = spark.sparkContext.broadcast(bits)
    rows = docs.select(*[c.alias(n) for n, c in _keys(id_col, text_col).items()], F.col(text_col).cast("binary").alias("text"))
    found = document_shingles(rows, sizes, held)
    if bits is None:
        found = found.join(each.select("gram").distinct(), "gram", "left_semi").select(*found.columns)
    hits = written(found.distinct(), "hits")  # rows repeated in full count once
    held.destroy()
    rarity = hits.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = each.join(rarity, "gram", "left").select("w", "size", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "r").alias("x"))
    # all shingles of a window in one row: window - SHINGLE + 1 at most
    prefix = ranked.groupBy("w", "size").agg(F.min("x").alias("x"), F.collect_list(F.struct("x.r", "x.gram")).alias("grams"))
    prefix = prefix.where("x.n > 0").select("w", "size", "x.gram", "x.r", "grams")
    places = spread_join(hits, prefix, "gram", rarity, hits.count(), ["a", "b", "p"]).withColumn("start", F.col("p") - F.col("r"))
    # every shingle of the window at its place; the last one's place keeps the window inside the document
    parts = F.size("grams").alias("parts")
    wanted = places.where("start >= 0").select("a", "b", "start", "size", "w", parts, F.explode("grams").alias("x"))
    wanted = wanted.select("a", "b", "start", "size", "w", "parts", (F.col("start") + F.col("x.r")).alias("p"), "x.gram")
    stand = wanted.join(hits, ["a", "b", "p", "gram"], "left_semi").groupBy("a", "b", "start", "size", "w", "parts").agg(F.count("*").alias("n"))
    out = written(stand.where("n = parts").select("a", "b", "start", "size", "w"), "occurrences")
    forget(spark, hits)
    return out, windows.select("name", "w").distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    filter_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (names), items_sha256, contaminated.

    A filter over ``filter_bytes`` isn't made: all shingles of the documents then meet the join."""
    found, names = occurrences(docs, benchmark, window, filter_bytes, id_col, text_col, item_id, item_text)
    # merged spans: [end so far, words covered]
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    more = lambda s, x: F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + more(s, x)).alias("n"))
    hit = found.groupBy("a", "b").agg(F.aggregate(spans, zero, step, lambda s: s["n"]).alias("n_hit"))
    held = written(found.select("a", "b", "w").distinct(), "held")
    holders = held.groupBy("w").agg(F.count("*").alias("n"))
    items = spread_join(held, names, "w", holders, held.count(), ["a", "b"]).groupBy("a", "b").agg(F.array_sort(F.collect_set("name")).alias("items"))
    judged = written(hit.join(items, ["a", "b"]), "judged")

    @F.pandas_udf("bigint")
    def count(text: pd.Series) -> pd.Series:
        return pd.Series([len(fold_words(t)) for t in text], dtype="int64")

    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in _keys(id_col, text_col).items()], count(F.col(text_col).cast("binary")).alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.join(judged, ["a", "b"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        items.alias("items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, filter_bytes: int = 16 << 20) -> DataFrame:
    """The documents without any window of the benchmark, all columns; only rows that may hold one are shuffled."""
    found, _ = occurrences(docs, benchmark, window, filter_bytes, "doc_id", "text", "item_id", "text")
    gone = written(found.select("a", "b").distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in _keys("doc_id", "text").items()])
    near, rest = parted(rows, F.xxhash64("a", "b"), gone.select(F.xxhash64("a", "b").alias("key")), "key", gone.count())
    # an anti join would be pushed below the filter, where all texts meet it: an outer one stays above
    told = near.join(gone.withColumn("gone", F.lit(True)), ["a", "b"], "left").where("gone is null")
    return rest.unionByName(told.select(*rows.columns)).select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
