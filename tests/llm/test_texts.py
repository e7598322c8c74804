"""Operators on single texts: quality, packing, decontamination, sharding, licenses."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortia.llm import decontaminate as dec
from cohortia.llm import license_scan, packing, quality_crf, sharding

WORDS = "the of and licence sample Été noise word 42 under cc by".split()


def text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))


# --- 1 quality -------------------------------------------------------------------------------


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 4, 2])
    unary, pair = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    got, pairs, log_z = quality_crf.forward_backward(unary, pair, quality_crf.Chains(lengths))
    want, total, both, start = np.zeros(7), 0.0, np.zeros((2, 2)), 0
    for n in lengths:
        z, mass, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(unary[start + k, y[k]] for k in range(n)) + sum(pair[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            mass += w * np.array(y)
            for k in range(n - 1):
                joint[y[k], y[k + 1]] += w
        want[start : start + n] = mass / z
        both += joint / z
        total += np.log(z)
        start += n
    assert np.allclose(got, want) and np.allclose(pairs, both) and log_z == pytest.approx(total)


def test_quality_learns_and_scores_everything(spark, documents):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "along", "a", "field"]) for _ in range(40)) + ".\nAnd so it ends."
    bad = lambda: "\n".join("BUY!! NOW!! " * rng.randint(3, 9) for _ in range(3))
    rows = [(i, good() if i % 3 else bad()) for i in range(150)]
    edge = [(1000, None), (1001, ""), (None, good()), (5, rows[5][1]), (1002, "A" * 300_000 + "\n" * 2000)]
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(150)] + [(1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    out = quality_crf.score_quality(documents(rows + edge), labels).collect()
    assert len(out) == len(rows) + len(edge)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in out if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == int(bool(r["doc_id"] % 3)) for r in held if r["doc_id"] < 150]) > 0.95
    none = quality_crf.score_quality(documents(rows[:4]), labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_crf.score_quality(documents([]), labels).count() == 0
    assert quality_crf.keep_good(documents(rows), labels).columns == documents(rows).columns


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    rows = [(i, ("GO!! " * 20) if i % 2 else "a plain line of words.\nAnother one.") for i in range(60)]
    labels = [(i, 1 - i % 2) for i in range(60)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    score = lambda ls: sorted((r["doc_id"], r["score"]) for r in quality_crf.score_quality(documents(rows), spark.createDataFrame(ls, "doc_id bigint, quality int")).collect())
    assert score(labels) == score(flipped)


# --- 2 packing -------------------------------------------------------------------------------


def test_packing_round_trip(documents):
    from tokenizers import Tokenizer

    rows = [(i, text(i, i * 7 % 90)) for i in range(60)] + [(100, None), (101, ""), (3, text(3, 21)), (None, "x"), (102, "ab " * 9000), (103, "It's <|endoftext|> ﬁn Σς e\u0301 \x1c\x85 'll")]
    pieces = [r.asDict() for r in packing.pack(documents(rows).repartition(5), window=256).collect()]
    tk = Tokenizer.from_file(packing.word_bpe_path())
    want = sorted((str(i), tk.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    by = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by.setdefault((str(p["doc_id"])), []).append((p["start"], p["doc_tokens"], ids))
    got = []
    for d, parts in by.items():
        for start, n, ids in parts:
            if start == 0:
                got.append((d, ids))
            else:
                assert len(got[-1][1]) == start or d in ("3",)
                got[-1][1].extend(ids)
    assert sorted(got) == want
    used = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == used.get(p["sequence_id"], 0)
        used[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n == 256 for s, n in used.items() if s != max(used)) and sorted(used) == list(range(len(used)))
    assert packing.pack(documents([])).count() == 0


def test_cached_words_equal_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 500)  # the table starts anew many times
    r = random.Random(4)
    letters = "abcXYZ'sStTrevmlLd09!.,;-%$#|&*ÉéßöÜñÇœŽ²½ΣσİıK  \n\t\xa0 \x1c\x85é中\U0001f600"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    words = packing.CachedTokenizer(packing.word_bpe_path())
    tk = Tokenizer.from_file(packing.word_bpe_path())
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        got = words.encode_batch([t.encode() for t in part], 1)
        assert [g.tolist() for g in got] == [e.ids + [1] for e in tk.encode_batch(part, add_special_tokens=False)]


# --- 8 decontamination -----------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, documents, block_bytes):
    items = [(i, text(1000 + i, n)) for i, n in enumerate([14, 3, 0, 30, 10, 1, 14])] + [(7, None), (None, "of the"), (8, text(1000, 14))]
    rows = [(i, text(i, 40) + (items[i % 7][1] if i % 2 else "")) for i in range(40)] + [(50, None), (51, ""), (1, text(1, 40) + items[1][1]), (None, items[3][1])]
    window = 5
    found = dec.decontaminate(documents(rows), spark.createDataFrame(items, "item_id bigint, text string"), window, block_bytes)
    want = []
    for i, t in rows:
        w, hit, own = words(t), set(), set()
        for name, item in items:
            v = words(item)
            for s in range(max(1, len(v) - window + 1)) if v and name is not None else ():
                x = v[s : s + window]
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit |= set(range(k, k + len(x)))
                        own.add(str(name))
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in found.drop("items").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert dec.decontaminate(documents(rows[:2]), empty).where("contaminated").count() == 0
    assert dec.decontaminate(documents([]), empty).count() == 0


def test_quality_of_ids_with_two_texts_ignores_the_order_of_rows(spark, documents):
    r = random.Random(2)
    good = [(i, text(i, 30) + ".\nA line that ends well.") for i in range(0, 40)]
    bad = [(i, "BUY!! NOW!! " * r.randint(3, 9)) for i in range(40, 80)]
    rows = good + bad + [(i, "BUY!! " * 20) for i in range(0, 40, 2)] + [(i, text(i, 20)) for i in range(40, 80, 3)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id bigint, quality int")
    got = []
    for at in (rows, rows[::-1]):
        out = quality_crf.score_quality(documents(at).repartition(3), labels).collect()
        got.append(sorted((x["doc_id"], round(x["score"], 12)) for x in out))
    assert got[0] == got[1] and len(got[0]) == len(rows)


# --- 7 sharding ------------------------------------------------------------------------------


def test_one_id_for_all_rows_is_no_hot_group(spark, documents):
    """Rows of one id are numbered by their texts' checksums, equal rows by their count."""
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same")] * 200 + [(7, f"t{i}") for i in range(100)]
    docs = documents(rows).repartition(4)
    out = sharding.shard_documents(docs, 3, rows_per_bucket=30).collect()
    assert len(out) == 600
    for k in range(3):
        own = [r["slot"] for r in out if r["shard"] == k]
        assert sorted(own) == list(range(len(own)))
    assert len({r["shard"] for r in out if r["doc_id"] == 7}) == 1 and len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    again = sharding.shard_documents(docs.repartition(7), 3, rows_per_bucket=30).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        h = 42
        for v in ([] if key is None else [key]) + [b]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        j = int((b + 1) * (float(1 << 31) / ((h >> 33) + 1)))
    return b


def test_jump_hash_and_slots(documents):
    rows = [(i, "é" * (i % 5)) for i in range(400)] + [(7, "twice"), (7, "twice"), (None, None), (-3, "")]
    out = [r.asDict() for r in sharding.shard_documents(documents(rows), 8, rows_per_bucket=50).collect()]
    assert len(out) == len(rows)
    for r in out:
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 8), jump(r["doc_id"], 9))
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.shard_documents(documents([])).count() == 0
    assert [jump(k, 200) for k in range(50)] == [r["s"] for r in documents([(k, "") for k in range(50)]).select("doc_id", sharding.jump_shard(F.col("doc_id"), 200).alias("s")).orderBy("doc_id").collect()]


# --- 10 licenses -----------------------------------------------------------------------------


def test_licenses_against_brute_force(documents):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(i, text(i, 30)) for i in range(30)] + [
        (40, f"Start.\n{apache} end"), (41, "ALL rights... reserved; all rights reserved"), (42, None), (43, ""), (44, "cc by cc by-nc"), (44, "cc by cc by-nc"),
        (45, "licensed under the very apache license version 2 0"), (None, "General Public\nLicense"), (46, "--cc by"), (47, "xcc by cc bye CC\tBY"), (48, "\u212accc by"),
        (49, ("words here " * 5000) + apache),
    ]
    got = [r.asDict() for r in license_scan.scan_licenses(documents(rows)).collect()]
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        w, places, labels = words(t), [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[40]["labels"] == "apache-2.0" and by[40]["score"] == 1.0
    assert by[45]["labels"] == "apache-2.0" and by[45]["score"] >= 0.6
    assert by[49]["labels"] == "apache-2.0"
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in got if r["base_labels"])
    assert license_scan.scan_licenses(documents([])).count() == 0
