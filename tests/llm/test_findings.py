"""Cases that reviews found: texts of one id in the repeats operator, filters kept out of the driver's plans."""

import hashlib
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortia.llm import bloom, decontaminate, near_dup, substring_dedup


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def many_spans(spark, n=60_000):
    return spark.range(n).select(F.col("id").alias("u"), F.col("id").alias("v"), F.expr("array(named_struct('a', 0L, 'b', 100L))").alias("spans"))


def test_repeats_keep_their_filter_out_of_the_plan(spark, documents):
    rows = substring_dedup._keys(documents([(1, "a"), (2, "b")]), "doc_id", "text")
    for part in substring_dedup._with_spans(rows, many_spans(spark)):
        assert plan_size(part) < 20_000


def test_cut_repeats_keep_their_filter_out_of_the_plan(spark, documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "covered_spans", lambda docs: many_spans(spark))
    docs = documents([(1, "a"), (2, None), (None, "c")])
    cut = substring_dedup.cut_repeats(docs)
    assert plan_size(cut) < 60_000
    assert sorted((r["doc_id"] or 0, r["text"]) for r in cut.collect()) == [(0, "c"), (1, "a"), (2, None)]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_parted_rows_are_all_rows_once(spark, n):
    rows = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("x"))
    keys = spark.range(2, 2 + n).select(F.col("id").alias("k"))
    near, rest = bloom.parted(rows, F.col("x"), keys, "k", n)
    near, rest = [r["x"] for r in near.collect()], [r["x"] for r in rest.collect()]
    assert Counter(near + rest) == Counter([None, *range(1, 1000)])
    assert set(range(2, 2 + n)) <= set(near) and len(near) < n + 50 and (None in rest or n)


def brute_of_rows(rows, length=100):
    """Each row a document; no text of an id is earlier than another of that id."""
    rows = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in rows:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            least[s] = min(least.get(s, 1 << 63), -1 if d is None else d)
    out = Counter()
    for d, b in rows:
        cover, own = bytearray(len(b)), set()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in own or least[s] < (-1 if d is None else d):
                cover[i : i + length] = b"\1" * length
            own.add(s)
        runs = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out[d, len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("chunk", "crowd"), [(1 << 20, 4096), (300, 4096), (300, 2)])
def test_texts_of_one_id_keep_what_they_share(documents, monkeypatch, chunk, crowd):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    r = random.Random(4)
    parts = ["".join(r.choice("abc é") for _ in range(n)) for n in (90, 130, 200, 320)] + ["ab" * 120]
    texts = ["".join([r.choice("xyz"), r.choice(parts), r.choice(["", "q"]), r.choice(parts)]) for _ in range(60)]
    rows = [(r.choice([None, 1, 1, 2, 5, 9]), t) for t in texts] + [(1, parts[1]), (1, parts[1] + "."), (None, parts[2]), (None, "-" + parts[2])]
    found = substring_dedup.remove_repeats(documents(rows + rows[:3]).repartition(3), crowd=crowd).drop("spans")
    assert Counter(tuple(x) for x in found.collect()) == brute_of_rows(rows + rows[:3])


def unfiltered_joins(df):
    """Joins of texts with no Bloom filter below them, in the optimized plan."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    below = lambda i: itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(lines)))
    joins = [i for i, x in enumerate(lines) if x.lstrip(" :+-").startswith("Join") and "_bloom" not in x]
    return [lines[i] for i in joins if not any("_bloom" in lines[j] for j in below(i))]


def test_only_filtered_texts_meet_the_joins(spark, documents):
    copies = [(i, " ".join(f"w{i % 40}x{j}" for j in range(30))) for i in range(60)] + [(None, "a b c d e f"), (70, "")]
    docs = documents(copies + [(3, copies[3][1])])
    left = near_dup.drop_near_duplicates(docs)
    assert not unfiltered_joins(left)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in left.collect()) == [-1, *range(40), 70]
    benchmark = spark.createDataFrame([("i", copies[5][1])], "item_id string, text string")
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert not unfiltered_joins(clean)
    want = Counter(d for d, _ in copies + [copies[3]] if d not in (5, 45))
    assert Counter(r["doc_id"] for r in clean.collect()) == want
