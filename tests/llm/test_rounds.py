"""SQL of the exact contracts, and cases of repeated ids, crowded groups, empty tables and clashing names."""

import itertools
import os
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm import ann_hnsw, common, decontaminate, license_scan, near_dup, packing, registry
from cohortia.llm import components as components_module
from cohortia.llm.common import written
from tests.llm.test_pairs import brute_components, exact, prose
from tests.llm.test_texts import text, words

SF = "/root/testdata/sf0.001"


def plain(df):
    """Rows as texts, whatever type a nullable number has."""
    one = lambda x: None if str(x) in ("None", "nan", "<NA>") else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)
    return sorted(repr([one(x) for x in row]) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_one_id_with_several_texts(documents):
    """Components belong to texts: the order of rows doesn't matter, and no other text of an id is lost."""
    r = random.Random(1)
    x, y, z = prose(r, 60), prose(r, 60), prose(r, 60)
    rows = [(5, x), (3, x), (5, y), (9, y + " more"), (1, z), (2, z), (2, prose(r, 30))]
    want = {(5, 3, False), (3, 3, True), (5, 5, True), (9, 5, False), (1, 1, True), (2, 1, False), (2, 2, True)}
    for order in itertools.islice(itertools.permutations(rows), 0, 5040, 1700):
        out = near_dup.near_duplicates(documents(list(order)), 3, 85).collect()
        assert {(o["doc_id"], o["component_id"], o["kept"]) for o in out} == want and len(out) == len(rows)
        kept = {(o["doc_id"], o["text"]) for o in near_dup.drop_near_duplicates(documents(list(order)), 3, 85).collect()}
        assert kept == {(3, x), (5, y), (1, z), (2, rows[-1][1])}


def test_crowded_boilerplate_and_large_families(documents, monkeypatch):
    """A region of documents with a common half, pairs at the threshold in it, and a family of near copies."""
    for name, value in {"REGION": 12, "BLOCK": 10, "PILOTS": 3}.items():
        monkeypatch.setattr(near_dup, name, value)
    r = random.Random(7)
    common = prose(r, 60)
    rows = []
    for i in range(40):
        own = prose(r, 25).split()
        rows.append((2 * i, f"{common} {' '.join(own)}"))
        own[12] = "changed"
        rows.append((2 * i + 1, f"{common} {' '.join(own)}"))
    base = prose(r, 120).split()
    for i in range(60):
        w = list(base)
        w[r.randrange(120)] = prose(r, 1)
        rows.append((1000 + i, " ".join(w)))
    got = {o["doc_id"]: (o["n_shingles"], o["component_id"]) for o in near_dup.near_duplicates(documents(rows), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


@pytest.mark.parametrize("n", [500, 2000, 20000])
def test_graph_recall_at_every_size(n):
    x = np.random.default_rng(n).normal(size=(n, 16))
    graph, height = ann_hnsw.Graph.build(x)
    assert len(graph.near) > 1 and (height >= 0).all()
    q = np.arange(0, n, max(20, n // 100))
    found = graph.search(x[q], 21, 160)
    want = exact(np.arange(n), x, int(q[1] - q[0]), 20)
    hits = sum(len(set(want[int(i)]) & set(f[:21].tolist())) for i, f in zip(q, found))
    assert hits / (20 * len(q)) >= 0.9


def brute_notices(t, k=3, band=3, least=0.6):
    w, labels, score = words(t), set(), 0.0
    for name, notice in license_scan.NOTICES.items():
        v = notice.split()
        groups = {}
        for p in range(len(w) - k + 1):
            for q in range(len(v) - k + 1):
                if w[p : p + k] == v[q : q + k]:
                    groups.setdefault((p - q, p // len(v)), []).append((p, q))
        spans = sorted((min(h)[0], d, max(h)[0], {q + j for _, q in h for j in range(k)}) for (d, _), h in groups.items())
        copy, last = set(), None
        for lo, d, hi, own in spans:
            if last is None or abs(d - last[0]) > band or lo > last[1] + band + k:
                copy = set()
            copy |= own
            last = (d, hi)
            if len(copy) / len(v) >= least:
                labels.add(name)
                score = max(score, len(copy) / len(v))
    return labels, score


def test_notices_against_brute_force(documents, monkeypatch):
    long = " ".join(f"w{i}" for i in range(150))  # a notice may have any length
    monkeypatch.setitem(license_scan.NOTICES, "long", long)
    r = random.Random(3)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            v = license_scan.NOTICES[r.choice(list(license_scan.NOTICES))].split()
            for _ in range(r.randint(0, 5)):
                v[r.randrange(len(v))] = r.choice(["x", "very the", ""])
            parts.append(" ".join(v[r.randint(0, 3) :]))
        rows.append((i, f" {text(i, 4)} ".join(["", *parts, ""])))
    for o in license_scan.scan_licenses(documents(rows)).collect():
        labels, score = brute_notices(rows[o["doc_id"]][1])
        base = set(filter(None, o["base_labels"].split(",")))
        assert set(filter(None, o["labels"].split(","))) == labels | base and o["score"] == pytest.approx(score)


def test_packing_with_another_vocabulary(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, text(i, 20) + "  Ünd\n") for i in range(20)] + [(50, None)]
    got = {}
    for p in packing.pack(documents(rows), window=1 << 20, tokenizer=path).collect():
        got[p["doc_id"]] = np.frombuffer(p["ids"], "<u4").tolist()
    tk = Tokenizer.from_file(path)
    assert got == {i: tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}


def test_pipeline_stages_on_edge_cases(spark, documents, tmp_path):
    """Nulls in any column, repeated rows and ids, an empty table, and columns of clashing names."""
    import corpus_pipeline as pipe

    r = random.Random(2)
    good = [prose(r, 50) for _ in range(20)]
    spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, good[0]), (None, good[1]), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t) for i, t in enumerate(good)] + [(None, None), (None, good[2]), (7, ""), (7, good[7]), (7, "another text of seven"), (5, "x" * 60_000)]
    full = documents(rows).withColumns({"__u": F.lit(1), "row": F.lit("r"), "id": F.lit(2), "hash": F.lit(3), "a": F.lit(4), "b": F.lit(5), "text_hash": F.lit(6)})
    full = full.withColumns({c: F.when(F.col("doc_id") > 0, F.col(c)) for c in ("lang", "source", "n_chars")})
    for docs in (full, full.where("false")):
        n = docs.count()
        for name, stage in pipe.STAGES[:-1]:
            out = written(stage(spark, docs, str(tmp_path)), name)
            assert out.columns == docs.columns and out.count() <= n
            if name == "near_duplicates" and n:
                texts = [(o["doc_id"], o["text"]) for o in out.select("doc_id", "text").collect()]
                assert texts.count((7, good[7])) == 1 and (7, "another text of seven") in texts and (None, good[2]) in texts
            if name == "benchmarks" and n:
                assert out.where("text is null").count() == 1 and not out.where(F.col("text") == good[0]).count()
        assert (pipe.packing(spark, docs, str(tmp_path)).count() == 0) == (n == 0)


@pytest.mark.parametrize("filter_bytes", [1 << 20, 8])
def test_shingles_and_windows_of_very_many_documents(spark, documents, monkeypatch, filter_bytes):
    """An item of one frequent word, and windows that most documents hold, are spread over tasks."""
    monkeypatch.setattr(common, "LEAST", 20)
    passage = "a passage that stands in nearly every one of these documents here"
    items = [(1, "word"), (2, passage), (3, passage + " and more"), (4, "word word"), (5, "not in any of them"), (6, "words of")]
    rows = [(i, "word " * (i % 7) + f"text {i} " + (passage.upper() if i % 3 else "") + " word") for i in range(120)]
    found = decontaminate.decontaminate(documents(rows), spark.createDataFrame(items, "item_id bigint, text string"), 5, filter_bytes)
    want = []
    for i, t in rows:
        w, hit, own = t.lower().split(), set(), set()
        for name, item in items:
            v = item.split()
            for x in {tuple(v[s : s + 5]) for s in range(max(1, len(v) - 4))}:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        own.add(str(name))
        want.append((i, len(w), len(hit), sorted(own)))
    assert sorted(map(tuple, found.select("doc_id", "n_words", "n_hit", "items").collect())) == want


def test_spread_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST", 10)
    rows = spark.createDataFrame([(k, i) for k in range(20) for i in range(k * k)] + [(None, 1)], "key int, i int").repartition(5)
    few = spark.createDataFrame([(k, c) for k in range(0, 20, 3) for c in "ab"] + [(None, "c")], "key int, c string")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    got = common.spread_join(rows, few, "key", counts, rows.count(), ["i"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(few, "key").collect()))


def test_hubs_of_many_edges(spark, monkeypatch):
    """Vertices of very many edges: their edges meet the smallest neighbour in several tasks."""
    monkeypatch.setattr(components_module, "PER_TASK", 50)
    monkeypatch.setattr(common, "LEAST", 10)
    r = random.Random(4)
    edges = [(1000 + i, 7 if i % 3 else 9) for i in range(400)] + [(5000, 1000 + i) for i in range(0, 60, 2)] + [(9000 + i, 9001 + i) for i in range(30)]
    r.shuffle(edges)
    got = {x["vertex"]: x["component"] for x in components_module.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)).collect()}
    assert {v: c for v, c in got.items() if v < 9000} == {v: 7 for e in edges for v in e if v < 9000}
    assert {c for v, c in got.items() if v >= 9000} == {9000}


def test_parts_of_one_hash_keep_their_own_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 20)
    monkeypatch.setattr(packing, "FRESH", 5)
    monkeypatch.setattr(packing, "HELD", 600)
    monkeypatch.setattr(packing, "hash", lambda part: len(part) % 3, raising=False)  # nearly all clash
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 5))) for _ in range(30)) for _ in range(200)]
    cached, tk = packing.CachedTokenizer(packing.word_bpe_path()), Tokenizer.from_file(packing.word_bpe_path())
    for a in range(0, len(texts), 10):
        got = cached.encode_batch([t.encode() for t in texts[a : a + 10]], 1)
        assert [g.tolist() for g in got] == [e.ids + [1] for e in tk.encode_batch(texts[a : a + 10], add_special_tokens=False)]
