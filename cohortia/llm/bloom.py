"""A Bloom filter of long keys as a broadcast row, to keep rows that can't match out of a shuffle.
It has no false negatives, and rows that pass still meet the join. As a literal it would stand in
the plan, its text and every task of it, each time as large as the keys are many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond this many keys (16 MB of bits) no filter is made; the join then gets all rows.
MOST_KEYS = 8_000_000
_HASHES = 3


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(_HASHES)]


def _words(keys: DataFrame, name: str, bits: int) -> np.ndarray:
    words = (
        keys.select(F.explode(F.array(*_positions(F.col(name), bits))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    )
    got = words.toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[got["word"].to_numpy()] = got["bits"].to_numpy()
    return held


def _bits_for(n_keys: int) -> int:
    return 64 * (max(64, 16 * n_keys) // 64)


def _tested(rows: DataFrame, key: Column, keys: DataFrame, name: str, n_keys: int, held: bool) -> DataFrame:
    bits = _bits_for(n_keys)
    filter_ = rows.sparkSession.createDataFrame(pa.table({"_bloom": pa.array([_words(keys, name, bits)])}))
    at = lambda p: F.getbit(F.get("_bloom", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    found = F.lit(True)
    for p in _positions(key, bits):
        found = found & at(p)
    found = F.coalesce(found, F.lit(False))
    return rows.join(F.broadcast(filter_), found if held else ~found).drop("_bloom")  # one row


def possible(rows: DataFrame, key: Column, keys: DataFrame, name: str, n_keys: int) -> DataFrame:
    """All rows of ``rows`` whose ``key`` is in ``keys[name]``, and few others; all beyond ``MOST_KEYS``."""
    if n_keys > MOST_KEYS:
        return rows
    return _tested(rows, key, keys, name, n_keys, True) if n_keys else rows.limit(0)


def parted(rows: DataFrame, key: Column, keys: DataFrame, name: str, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """What ``possible`` gives, and all other rows, none of which is in ``keys[name]``."""
    if n_keys > MOST_KEYS:
        return rows, rows.limit(0)
    if not n_keys:
        return rows.limit(0), rows
    return _tested(rows, key, keys, name, n_keys, True), _tested(rows, key, keys, name, n_keys, False)
