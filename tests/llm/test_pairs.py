"""Operators across texts and rows: near duplicates, repeats, neighbours, archives, URLs, pipeline."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm import ann_hnsw, groups, near_dup, prefix_join, substring_dedup, url_filter, warc
from cohortia.llm import components as components_module
from cohortia.llm.components import components


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(n))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 5), (60, 61), (61, 62), (7, 7), (None, 3), (200, 199)] + [(300, k) for k in range(301, 360)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 0
    assert (got[60], got[62], got[200], got[359]) == (60, 60, 199, 300)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("per_task", [1, 7, 60])
def test_components_over_many_tasks(spark, monkeypatch, per_task):
    monkeypatch.setattr(components_module, "PER_TASK", per_task)
    r = random.Random(per_task)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(70)] + [(200, k) for k in range(201, 260)] + [(k, k + 1) for k in range(300, 340)]
    root = list(range(400))
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = sorted((x["vertex"], x["component"]) for x in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)).collect())
    assert got == sorted((v, root[v]) for v in {v for a, b in edges for v in (a, b) if a != b})


# --- 5 near duplicates -----------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_rows(seed=0):
    r = random.Random(seed)
    base = [prose(r, r.choice([4, 30, 80, 200])) for _ in range(25)]
    rows = []
    for i in range(160):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = prose(r, 1)
        rows.append((i * 3 + 1, r.choice(["{}", "  {}\n", "{}"]).format(" ".join(w))))
    return rows + [(500, None), (501, ""), (502, " \t\n"), (503, "a b"), (504, "A  b"), (505, "b a"), (506, base[0].upper())]


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 85, False), (5, 80, True)])
def test_near_duplicates_against_brute_force(documents, monkeypatch, k, percent, small):
    if small:  # many blocks, crowded regions
        monkeypatch.setattr(near_dup, "BLOCK", 4)
        monkeypatch.setattr(near_dup, "REGION", 3)
    rows = near_rows(k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(documents(rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_near_duplicate_cases(documents):
    rows = [(2, "one two three four"), (1, "One two three four"), (2, "one two three four"), (None, "one two three four"), (3, None)]
    out = [r.asDict() for r in near_dup.near_duplicates(documents(rows), 3, 85).collect()]
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in out) == [
        ("1", 2, "1", True), ("2", 2, "1", False), ("2", 2, "1", False), ("3", 0, "3", True), ("None", 2, "None", True),
    ]
    kept = near_dup.drop_near_duplicates(documents(rows))
    assert kept.columns == documents(rows).columns and kept.count() == 3
    assert near_dup.near_duplicates(documents([]), 3, 85).count() == 0


def _edges(spark, sig, least, n_trees):
    members = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(sig)], "u bigint, sig binary")
    found = near_dup.candidate_edges(members, n_trees, least).collect()
    return {r["vertex"]: r["component"] for r in components(spark.createDataFrame([(r["a"], r["b"]) for r in found], "a bigint, b bigint")).collect()}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_common_prefixes_of_neighbours_make_regions(spark, monkeypatch, batch):
    """Regions and their depths follow from the sorted labels alone, however they are dealt."""
    monkeypatch.setattr(near_dup, "REGION", 5)
    r = random.Random(3)
    width, depths = 2, range(near_dup.LEAST, near_dup.DEPTH + 1)
    labels = [bytes([0, r.randrange(2)]) + bytes(v for _ in range(near_dup.DEPTH) for v in (0, r.choice([1, 1, 1, 1, 2]))) for _ in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = near_dup.crowded_regions(spark.createDataFrame([(x,) for x in labels], "label binary").repartition(3), depths, width).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for d in depths:
        for x in labels:
            want.setdefault((d, x[: 2 + d * width]), []).append(x)
    assert {(x["depth"], bytes(x["prefix"]), x["blocks"]) for x in got} == {(d, p, -(-len(v) // 5)) for (d, p), v in want.items() if len(v) > 5}
    pairs = [bytes([0, 1, 0, 7, 0, 8]), bytes([0, 1, 0, 7, 0, 9]), bytes([0, 2, 0, 7, 0, 9])]
    assert near_dup.common_values(pairs, 2).tolist() == [1, -1]


def test_crowded_regions_lose_no_pair(spark, monkeypatch):
    """Pairs that share the first four values, but no whole label, of a region that is crowded."""
    monkeypatch.setattr(near_dup, "REGION", 8)
    rng = np.random.default_rng(1)
    n_trees, n = 4, 120
    sig = rng.integers(0, 1 << 32, (n, near_dup.DEPTH * n_trees), dtype=np.uint32)
    sig[:, : near_dup.LEAST] = 7  # everyone's region in the first tree
    for i in range(n // 2):  # i and i + n / 2: equal but for one value in each tree
        sig[i + n // 2] = sig[i]
        sig[i + n // 2, near_dup.DEPTH - 1 :: near_dup.DEPTH] ^= 1
        sig[i + n // 2, near_dup.DEPTH :: near_dup.DEPTH] ^= 1  # no other tree's region
    got = _edges(spark, sig, 0.6, n_trees)
    assert [got.get(i + n // 2) for i in range(n // 2)] == list(range(n // 2))


def test_blocks_of_one_label_meet_each_other(spark, monkeypatch):
    """Many clusters with one whole label: pairs far apart in the order of ids."""
    monkeypatch.setattr(near_dup, "REGION", 8)
    rng = np.random.default_rng(2)
    n_trees, n = 4, 120
    sig = rng.integers(0, 1 << 32, (n, near_dup.DEPTH * n_trees), dtype=np.uint32)
    sig[:, : near_dup.DEPTH] = 7
    for i in range(n // 2):
        sig[i + n // 2] = sig[i]
        sig[i + n // 2, near_dup.DEPTH :: near_dup.DEPTH] ^= 1
    got = _edges(spark, sig, 0.7, n_trees)
    assert [got.get(i + n // 2) for i in range(n // 2)] == list(range(n // 2))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80), (3, 50)])
def test_texts_of_one_repeated_word(documents, k, percent):
    rows = [(10 * w + n, " ".join([word] * n)) for w, word in enumerate(["spam", "egg"]) for n in range(1, 10)]
    rows += [(30, "spam spam spam egg"), (31, "Spam  spam spam spam SPAM spam"), (32, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(documents(rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


# --- 13 prefix join --------------------------------------------------------------------------


def joined_rows(seed):
    """Near copies, a family around a common passage, texts of little else than that passage."""
    r = random.Random(seed)
    passage = prose(r, 40)
    rows = near_rows(seed) + [(600 + i, prose(r, r.choice([2, 6, 60])) + " " + passage) for i in range(50)]
    for i in range(40):
        w = passage.split()
        w[r.randrange(len(w))] = prose(r, 1)
        rows.append((700 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "percent", "small"), [(4, 85, False), (5, 80, True), (2, 60, False)])
def test_prefix_join_against_brute_force(documents, monkeypatch, k, percent, small):
    if small:  # many blocks, joins for all but the most frequent n-grams
        monkeypatch.setattr(near_dup, "BLOCK", 4)
        monkeypatch.setattr(groups, "HEAVY", 60)
    rows = joined_rows(k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.prefix_join(documents(rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize("k", [4, 2])
def test_prefix_join_of_repeated_words(documents, k):
    rows = [(10 * w + n, " ".join([word] * n)) for w, word in enumerate(["spam", "egg"]) for n in range(1, 10)]
    rows += [(30, "spam spam spam egg"), (31, "Spam  spam spam spam SPAM spam"), (32, None), (33, "a b a b a b a b"), (34, "b a b a b a b")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.prefix_join(documents(rows), k, 85).collect()}
    assert got == brute_components(rows, k, 85)


def test_prefix_join_cases(documents):
    text = "one two three four five"
    rows = [(2, text), (1, text.title()), (2, text), (2, "another text of six words"), (None, text), (3, None), (4, " "), (5, "w " * 60_000)]
    out = prefix_join.prefix_join(documents(rows), 4, 85)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out.collect()) == [
        ("1", 2, "1"), ("2", 2, "1"), ("2", 2, "1"), ("2", 2, "2"), ("3", 0, "3"), ("4", 0, "4"), ("5", 1, "5"), ("None", 2, "None"),
    ]
    assert prefix_join.prefix_join(documents([]), 4, 85).count() == 0


def test_an_order_cuts_clusters_by_its_own_prefixes(spark):
    rows = [(1, 0, [5, 6], [1]), (2, 0, [6, 9], [2]), (3, 0, [9], [2]), (4, 0, [70], [2]), (5, 1, [6], [1])]
    members = spark.createDataFrame(rows, "u bigint, cluster bigint, rare array<bigint>, other array<bigint>")
    once = prefix_join.cut(members, "rare")
    assert {(r["u"], r["cluster"]) for r in once.collect()} == {(1, 1), (2, 1), (3, 1)}  # 4 shares none, 5 none in its cluster
    assert {(r["u"], r["cluster"]) for r in prefix_join.cut(once, "other").collect()} == {(2, 2), (3, 2)}


# --- 6 repeats -------------------------------------------------------------------------------


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(s)
        runs = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out[d] = (len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


def repeat_rows():
    r = random.Random(5)
    parts = [prose(r, n) for n in (12, 25, 40, 90, 14)]
    rows = [(i, prose(r, r.randint(0, 30)) + r.choice(parts) + prose(r, 5) + r.choice(parts)) for i in range(60)]
    rows += [(70, "ab" * 400), (71, "x" + "ab" * 300), (72, None), (73, ""), (74, parts[3][:99]), (75, parts[3][:100]), (76, rows[3][1]), (None, rows[4][1]), (-5, parts[2])]
    return rows + [(80, parts[3] * 30), (81, "\n".join(parts))]


@pytest.mark.parametrize("crowd", [4096, 2])
def test_repeats_against_brute_force(documents, crowd):
    rows = repeat_rows()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(documents(rows), crowd=crowd).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("crowd", [4096, 2])
def test_repeats_with_zero_bytes(documents, crowd):
    r = random.Random(8)
    passage = prose(r, 60).encode()[:100].decode("utf-8", "ignore")
    parts = ["\0" * 120, passage, "".join(r.choice("\0a") for _ in range(110)), passage + "\0", passage + "\0\0"]
    rows = [(1, "a" + passage + "\0"), (2, "c" + passage), (3, "b" + passage + "\0")]
    rows += [(i, r.choice("xyz\0") + r.choice(parts) + r.choice(["", "\0", "\0\0", "q", "\0q"]) + r.choice(parts)) for i in range(10, 60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(documents(rows), crowd=crowd).collect()}
    assert got == brute_repeats(rows)


def test_repeat_cases(documents):
    rows = [(1, "q" * 50 + "é" * 80), (1, "q" * 50 + "é" * 80), (2, "é" * 80 + "z")]
    out = [r.asDict() for r in substring_dedup.remove_repeats(documents(rows)).collect()]
    assert len(out) == 3 and len({str(r) for r in out if r["doc_id"] == 1}) == 1
    cut = substring_dedup.cut_repeats(documents(rows))
    assert cut.columns == documents(rows).columns
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert substring_dedup.remove_repeats(documents([])).count() == 0


@pytest.mark.parametrize(("chunk", "crowd"), [(1 << 20, 4096), (200, 4096), (200, 2)])
def test_repeated_rows_keep_their_bytes(documents, monkeypatch, chunk, crowd):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)  # one chunk, or each row its own
    r = random.Random(3)
    own, other, part = prose(r, 60), prose(r, 60), prose(r, 40)
    rows = [(1, own), (1, own), (None, other), (None, other), (2, part + own), (2, part + own), (1, own), (3, part)]
    for at in (rows, rows[::-1]):
        docs = documents(at).repartition(3)
        got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs, crowd=crowd).collect()}
        size = [len(t.encode()) for t in (own, other, part, part + own)]
        assert got == {(1, size[0], 0), (None, size[1], 0), (2, size[3], size[0]), (3, size[2], size[2])}
    cut = [(r["doc_id"], r["text"]) for r in substring_dedup.cut_repeats(documents(rows)).collect()]
    assert cut.count((1, own)) == 3 and cut.count((None, other)) == 2 and cut.count((2, part)) == 2


def test_maximal_repeats_have_all_occurrences():
    texts = [b"--" + b"abcdefgh" + b"1", b"++" + b"abcdefgh" + b"2", b"xyabcdefg3", b"??abcdefgh"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size)
    found = set()
    for depth, counts, places in substring_dedup.maximal_repeats(data, ends - size, ends, np.zeros(4, np.int64), 5):
        at = 0
        for d, n in zip(depth.tolist(), counts.tolist()):
            found.add((bytes(data[places[at] : places[at] + d]), n))
            at += n
    assert {(b"abcdefgh", 3), (b"abcdefg", 4)} <= found
    assert all(s in (b"abcdefgh", b"abcdefg") for s, _ in found)


# --- 3 neighbours ----------------------------------------------------------------------------


def exact(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        s[ids == ids[i]] = -np.inf
        best = [j for j in np.lexsort((ids, -s)) if np.isfinite(s[j])][:k]
        out[int(ids[i])] = [int(ids[j]) for j in best]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_recall_and_scores(spark, scale):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x = x * rng.uniform(0.2, 2, (3000, 1)) if scale else x / np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = ann_hnsw.search_all(df, shard_size=1100).toPandas()
    want = exact(np.arange(3000), x.astype(float), 20, 20)
    hits = sum(len(set(want[q]) & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert len(got) == 20 * len(want) and hits / len(got) >= 0.95
    row = got.iloc[7]
    assert row["score"] == pytest.approx(float(x[int(row["query_id"])].astype(float) @ x[int(row["vec_id"])].astype(float)), rel=1e-12)
    for _, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g["score"]) <= 0).all()


@pytest.mark.parametrize("outlier", [1e4, 1e-4])
def test_neighbours_beside_one_outlier_norm(spark, outlier):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= outlier
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann_hnsw.search_all(df, shard_size=3000).toPandas()
    want = exact(np.arange(3000), x, 20, 20)
    hits = sum(len(set(want[q]) & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert len(got) == 20 * len(want) and hits / len(got) >= 0.95


def test_neighbour_cases(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 0.0]), (120, None), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (180, [1.0]), (200, [0.5, 0.5]), (0, [1.0, 0.0]), (None, [1.0, 1.0]), (220, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"v": F.lit(1), "ids": F.lit(2), "shard": F.lit(3)})
    got = ann_hnsw.search_all(df).toPandas()
    assert sorted(got["query_id"].unique()) == [0, 20, 40, 200]
    zero = got[got["query_id"] == 0].sort_values("rank")
    assert zero["vec_id"].tolist() == list(range(1, 21))  # ties to the smaller id
    few = ann_hnsw.search_all(df.where("vec_id in (0, 1, 200)")).toPandas()
    assert few[few["query_id"] == 0].sort_values("rank")["vec_id"].tolist() == [1, 200]
    assert ann_hnsw.search_all(df.where("false")).count() == 0


# --- 4 archives ------------------------------------------------------------------------------


def test_archives_round_trip_and_reject_magic(spark):
    fake = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    pages = [(i, f"http://h/{i}", f"<p>{i % 7} é</p>") for i in range(50)] + [(60, None, fake), (61, "http://a\r\nb", None), (62, "u", ""), (63, "u", fake), (64, "u", "tail\r\n"), (65, "u", "\r\n\r\n"), (66, "u", "\n" * 70000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({"digest": F.lit(1), "value": F.lit(2), "block": F.lit(3)})
    got = {r["page_id"]: r for r in warc.round_trip(df.repartition(3), per_file=9).collect()}
    first = {}
    for i, _, html in sorted(pages):
        b = (html or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[b]) if b in first else ("response", None))
        first.setdefault(b, i)
    assert len(got) == len(pages)
    small = warc.round_trip(df, least=5)
    assert small.where("page_id in (61, 62) and record_type = 'response'").count() == 2
    assert warc.round_trip(df.where("false")).count() == 0
    null = warc.round_trip(spark.createDataFrame([(None, "u", "a"), (1, "u", "a"), (1, "u", "a")], "page_id bigint, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in null) == [("1", "response"), ("1", "response"), ("None", "revisit")]


def test_broken_archive_is_an_error(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"WARC/1.1\r\nContent-Length: 900\r\n\r\nshort\r\n\r\n")
    with pytest.raises(ValueError):
        warc.read_archives(spark, f"file://{tmp_path}")


# --- 9 URLs ----------------------------------------------------------------------------------


def test_urls_against_the_rules(spark):
    r = random.Random(2)
    hosts = ["example.net", "A.Example.NET", "example.com", "x.example.com", "org", "w3.org", "net", "nonet", "example.network", ""]
    urls = [r.choice(["http", "ftp", ""]) + "://" + r.choice(hosts) + r.choice(["", "/", "/en/", "/en/x", "/de/", "/fr/a?b", "/en#/", "?/en/", "/en"]) for _ in range(300)]
    urls += [None, "", "no scheme", "a://b://net/", "http://example.net/en/é\nx"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit("h"), "key": F.lit("k")})
    for r_ in url_filter.judge_urls(df).collect():
        rest = (urls[r_["page_id"]] or "").split("://", 1)[1] if "://" in (urls[r_["page_id"]] or "") else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        assert (r_["host"], r_["path"], r_["rule"], r_["verdict"]) == (host, path, best[2], best[1])
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.crc32("key") % 5 == 0)
    c = url_filter.BloomCascade(listed, universe, bits_per_key=4, hashes=2)
    assert len(c.levels) > 1
    assert universe.where(c.contains(F.col("key"))).exceptAll(listed).count() == 0
    assert listed.where(~c.contains(F.col("key"))).count() == 0
    with pytest.raises(ValueError):
        url_filter.BloomCascade(listed, universe, max_bytes=8)


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline as pipe
    from cohortia.llm.common import written

    r = random.Random(9)
    clean = [prose(r, 60).capitalize() + "." for _ in range(60)]
    bench = [(1, prose(r, 20))]
    texts = clean + [clean[0] + " more", "BUY!! IT!! " * 40, clean[1] + " " + bench[0][1], clean[5][:150] + prose(r, 40), None, ""]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], names).write.parquet(f"{tmp_path}/documents.parquet")
    junk = [(1000 + i, "GET!! THIS!! " * r.randint(5, 20)) for i in range(40)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in junk], names).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(60)] + [(i, 0) for i, _ in junk], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = written(out, name)
        kept[name] = {x["doc_id"]: x["text"] for x in docs.select("doc_id", "text").collect()}
    assert set(range(60)) <= set(kept["benchmarks"])
    assert not {i for i, _ in junk} & set(kept["quality"])
    assert 60 not in kept["near_duplicates"] and 62 not in kept["benchmarks"]
    assert clean[5][:150] not in kept["repeats"][63] and kept["repeats"][5] == clean[5]
    pieces = pipe.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in pieces.select("doc_id").collect()} == set(kept["benchmarks"])
