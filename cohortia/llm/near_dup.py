"""Near duplicates by an LSH forest.

Texts are sets of word shingles with a MinHash signature, cut into trees of ``DEPTH`` values. A
tree's order is the documents sorted by their labels, its values as big-endian bytes. Orders are
dealt by ranges of labels, so neighbours in a task are those of the longest common prefix; a run of
neighbours that share d values or more is a region of depth d, and parts of a run in several tasks
are added up. In the first ``shallow`` trees regions have ``LEAST`` values. Where that leaves more
than ``REGION`` documents in a region, the documents in it descend: in all trees they lie in the
longest regions, of ``LEAST`` to ``DEPTH`` common values, that hold ``REGION`` documents at most.
Regions that stay crowded at full depth are dealt into blocks; documents that lie in the region's
largest cluster after that need no further comparison with each other, and all others (strays) meet
every block of the region, so that nothing is capped. In a region, documents stand in the order of
labels: neighbours of the longest common prefix are tried first, and every pair whose sketches
(four bits of each value) are near ends in one cluster.

A link at the threshold misses all regions of LEAST values in the shallow trees, or all of DEPTH
values in the whole forest, with odds of at most ``miss / 2`` each; the number of trees follows
from that, whatever the sizes of regions. The sketch test, five standard deviations and 0.02
under the threshold, comes on top.

Clusters are confirmed on full sets: an inverted index in the task gives all intersections.
Clusters beyond a block are dealt into blocks that all hold the same few pilots, so that a
family of copies is one component after one comparison; only strays meet further blocks.

Exact copies (equal word sequences) are one member with one set from the start, so a group of
copies costs one row. Members are numbered; a doc_id is only a name of rows.

Cases: null and empty texts have no shingles and are linked with nothing; texts with fewer
words than a shingle are one shingle, linked with equal ones only; a doc_id with several texts
is several documents, whose texts aren't linked for that (each row gets the component of its
own text); rows repeated in full get one answer each; a null doc_id is linked with nothing
(component_id null, kept); ties don't matter, as a component is named by its smallest doc_id;
very long texts are read whole; an empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import parted, possible
from .common import forget, handing_back, table, written
from .components import components, stars

DEPTH, LEAST, REGION = 6, 4, 1024
#: Values of a signature that its sketch has.
SKETCHED = 128
#: Members of a cluster compared in one task, and shingles in their sets; members that all its blocks hold.
BLOCK, BLOCK_SHINGLES, PILOTS = 2048, 1_500_000, 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and bytes 9 to 13."""
    return (text or b"").translate(_LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words: sums of byte values times powers of a base by place in the word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    first = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(first, size)
    top = int(size.max())
    power = np.cumprod(np.full(top, _BASE, np.uint64)) if top > 1 else np.full(1, _BASE, np.uint64)
    return _mixed(np.add.reduceat(_BYTE[data] * power[place], first) + size.astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, of which there are k at least."""
    n = len(h)
    out = h[: n - k + 1] * _STEP[0]
    for d in range(1, k):
        out = out + h[d : n - k + 1 + d] * _STEP[d % 64]
    return _mixed(out)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (all words as one, if fewer)."""
    if not words:
        return np.empty(0, np.uint64)
    h, n = word_hashes(words), len(words)
    if n < k:
        return _mixed((h * _STEP[np.arange(n) % 64]).sum(keepdims=True) + np.uint64(n + 1))
    return np.unique(gram_hashes(h, k))


def signatures(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """MinHash values, sets x n_hashes (uint32); no set may be empty."""
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 32, n_hashes, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32)
    out = np.empty((len(sets), n_hashes), np.uint32)
    i = 0
    while i < len(sets):  # a few ten thousand values at once stay in the cache
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 32_768):
            size += len(sets[j])
            j += 1
        h = np.concatenate(sets[i:j])
        h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
        length = np.fromiter(map(len, sets[i:j]), np.int64, j - i)
        first = np.cumsum(length) - length
        for k in range(n_hashes):
            v = h * a[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v += b[k]
            out[i:j, k] = np.minimum.reduceat(v, first)
        i = j
    return out


def _sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each of the first values, two to a byte."""
    nibble = ((sig[:, :SKETCHED].astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(28)).astype(np.uint8)
    return nibble[:, ::2] << 4 | nibble[:, 1::2]


def _agree(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of one sketch with others, or row by row."""
    x = one ^ others
    same = ((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)
    return (same / (2 * others.shape[1]) - 1 / 16) * (16 / 15)


def trees_for(threshold: float, miss: float, depth: int) -> int:
    """Trees of which a pair at the threshold shares ``depth`` values of at least one, but for odds of ``miss``."""
    return max(4, math.ceil(math.log(miss) / math.log(1 - min(threshold, 0.999) ** depth)))


def text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("binary"), F.lit(b"")))


def sign(docs: DataFrame, shingle: int, n_hashes: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), seq (128-bit hash of the word sequence), n (set size), sig (16 bits a value)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                rows = batch.iloc[start : start + 512]
                sets, seq = [], []
                for t in rows["text"]:
                    words = words_of(t)
                    sets.append(shingle_set(words, shingle))
                    seq.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                sig: list[bytes | None] = [None] * len(sets)
                full = np.flatnonzero(n)
                for i, s in zip(full.tolist(), signatures([sets[i] for i in full], n_hashes).astype("<u2")):
                    sig[i] = s.tobytes()
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(object), "h": rows["h"].to_numpy(), "seq": seq, "n": n, "sig": sig})

    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInPandas(handing_back(run), f"doc_id {kind}, h bigint, seq binary, n bigint, sig binary")


def _orders(members: DataFrame, n_trees: int, trees: int, sketched: bool = True) -> DataFrame:
    """A row for each member and each of the first ``trees`` trees: label (two bytes of the tree, then
    its values, big-endian), u and sketch; labels alone unless ``sketched``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                x = batch.iloc[start : start + 1024]
                width = len(x["sig"].iloc[0]) // (DEPTH * n_trees)  # bytes of a value
                sig = np.frombuffer(b"".join(x["sig"]), f"<u{width}").reshape(len(x), -1).astype(f">u{width}")
                more = {"u": x["u"].to_numpy(), "sketch": [s.tobytes() for s in _sketch(sig)]} if sketched else {}
                for t in range(trees):
                    own = np.ascontiguousarray(sig[:, DEPTH * t : DEPTH * (t + 1)])
                    yield pd.DataFrame({"label": [t.to_bytes(2, "big") + v.tobytes() for v in own]} | more)

    return members.select("u", "sig").mapInPandas(handing_back(run), "label binary" + ", u bigint, sketch binary" * sketched)


def _prefix(label: str, values: int, width: int) -> Column:
    return F.substring(label, 1, 2 + values * width)


def common_values(labels: list[bytes], width: int) -> np.ndarray:
    """Of each label and the next, how many leading values are equal; -1 in different trees."""
    x = np.frombuffer(b"".join(labels), np.uint8).reshape(len(labels), -1)
    differ = x[1:] != x[:-1]
    equal = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.where(equal < 2, -1, (equal - 2) // width)


def crowded_regions(orders: DataFrame, depths: Sequence[int], width: int) -> DataFrame:
    """(depth, prefix, blocks) of the regions of ``depths`` values with more than REGION labels.

    Labels are sorted over tasks of ranges; a run of neighbours with d common values that doesn't
    touch the end of a batch is a whole region, which leaves the task only if it is crowded."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels = list(batch["label"])
            if not labels:
                continue
            common, out = common_values(labels, width), []
            for d in depths:
                begin = np.concatenate([[0], np.flatnonzero(common < d) + 1])
                size = np.diff(np.append(begin, len(labels)))
                told = size > REGION
                told[[0, -1]] = True
                out += [(d, labels[i][: 2 + d * width], int(n)) for i, n in zip(begin[told].tolist(), size[told])]
            yield pd.DataFrame(out, columns=["depth", "prefix", "n"])

    parts = orders.select("label").repartitionByRange("label").sortWithinPartitions("label").mapInPandas(handing_back(runs), "depth int, prefix binary, n bigint")
    total = parts.groupBy("depth", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > REGION)
    return total.select("depth", "prefix", F.ceil(F.col("n") / REGION).cast("int").alias("blocks"))


def _stray_meetings(rows: DataFrame, most: int) -> DataFrame:
    """Rows (group, blocks, u, comp, ...) of groups with several components: those outside the
    group's largest component (side 0), in parts of ``most``, meet every block of it (side 1).
    Adds g, which names the meeting, and side."""
    sizes = rows.groupBy("group", "comp").agg(F.count("*").alias("n"))
    homes = sizes.groupBy("group").agg(F.max_by("comp", F.struct("n", "comp")).alias("home"), (F.sum("n") - F.max("n")).alias("strays")).where("strays > 0")
    rows = rows.join(homes, "group").withColumn("parts", F.ceil(F.col("strays") / most).cast("int"))
    block, part = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("u", F.lit(1)), F.col("parts")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    every = rows.withColumn("p", each(F.col("parts"))).withColumns({"q": block, "side": F.lit(1)})
    strays = rows.where("comp <> home").withColumn("q", each(F.col("blocks"))).withColumns({"p": part, "side": F.lit(0)})
    return every.unionByName(strays).withColumn("g", F.xxhash64("group", "p", "q")).drop("group", "p", "q", "home", "strays", "parts", "blocks")


def _by_group(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[list, np.ndarray]]:
    """Columns (g first) of rows sorted by g, with whole groups only, and where each group ends."""
    held: list[list] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not len(batch):
                continue
            held.append([batch[c].to_numpy() for c in columns])
            if held[0][0][0] == held[-1][0][-1]:
                continue
        if not held:
            continue
        whole = [np.concatenate(x) for x in zip(*held)]
        g = whole[0]
        end = len(g) if batch is None else int(np.searchsorted(g, g[-1]))
        cuts = np.flatnonzero(g[1:end] != g[: end - 1]) + 1
        held = [[x[end:] for x in whole]] if end < len(g) else []
        if end:
            yield [x[:end] for x in whole], np.append(cuts, end)


def _unpacked(sketches: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def _near_pairs(u: np.ndarray, s: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning set of the near pairs of a region, whose rows are in the order of labels."""
    edges, todo = [], np.arange(len(u))
    # neighbours by common prefix first: runs of near ones are one cluster with one row left to ask
    close = _agree(s[:-1], s[1:]) >= least
    edges += zip(u[:-1][close].tolist(), u[1:][close].tolist())
    run = np.concatenate([[0], np.cumsum(~close)])
    while len(todo) > 1:
        reached, rest = [todo[0]], todo[1:]
        while reached and len(rest):
            i = reached.pop()
            close = _agree(s[i], s[rest]) >= least
            found = rest[close]
            known = run[found] == run[i]
            edges += [(u[i], u[j]) for j in found[~known].tolist()]
            reached += found.tolist()
            rest = rest[~close]
        todo = rest
    return edges


def _region_edges(rows: DataFrame, least: float) -> DataFrame:
    """Edges inside each region g of rows (g, label, u, sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (g, u, sketches), ends in _by_group(batches, ["g", "u", "sketch"]):
            begins = np.concatenate([[0], ends[:-1]])
            edges: list[tuple[int, int]] = []
            pair = begins[ends - begins == 2]
            if len(pair):
                close = _agree(_unpacked(sketches[pair]), _unpacked(sketches[pair + 1])) >= least
                edges += zip(u[pair[close]], u[pair[close] + 1])
            for a, b in zip(begins.tolist(), ends.tolist()):
                if b - a > 2:
                    edges += _near_pairs(u[a:b], _unpacked(sketches[a:b]), least)
            if edges:
                yield stars(edges)

    return rows.repartition("g").sortWithinPartitions("g", "label", "u").mapInPandas(handing_back(run), "a bigint, b bigint")


def _stray_edges(rows: DataFrame, least: float) -> DataFrame:
    """Of each meeting, an edge from each stray to each component that has a near row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, u, comp, side, sketches), ends in _by_group(batches, ["g", "u", "comp", "side", "sketch"]):
            edges: list[tuple[int, int]] = []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                s, own = _unpacked(sketches[a:b]), comp[a:b]
                others = np.flatnonzero(side[a:b] == 1)
                for i in np.flatnonzero(side[a:b] == 0).tolist():
                    apart = others[own[others] != own[i]]
                    near = apart[_agree(s[i], s[apart]) >= least]
                    _, one = np.unique(own[near], return_index=True)
                    edges += [(u[a + i], u[a + j]) for j in near[one].tolist()]
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])

    return rows.repartition("g").sortWithinPartitions("g").mapInPandas(handing_back(run), "a bigint, b bigint")


def candidate_edges(members: DataFrame, n_trees: int, least: float, shallow: int | None = None) -> DataFrame:
    """Edges (a, b) whose components hold every pair that shares a region with near sketches.

    ``members`` (u, sig) has DEPTH * n_trees values of 2 or 4 bytes; regions of LEAST values are
    made in the first ``shallow`` trees."""
    shallow = shallow or n_trees
    first = members.select(F.octet_length("sig").alias("n")).first()
    width = first["n"] // (DEPTH * n_trees) if first else 2
    region = lambda d: F.xxhash64(_prefix("label", d, width))
    labels = written(_orders(members, n_trees, shallow, sketched=False), "labels")  # read twice: ranges are sampled
    crowded = written(crowded_regions(labels, [LEAST], width).select("prefix"), "crowded")
    forget(members.sparkSession, labels)
    rows = _orders(members, n_trees, shallow).withColumn("prefix", _prefix("label", LEAST, width))
    if crowded.isEmpty():
        return _region_edges(rows.select(region(LEAST).alias("g"), "label", "u", "sketch"), least).where("a <> b").distinct()
    descend = rows.select("prefix", "u").join(crowded, "prefix", "left_semi").select("u").distinct()
    deep = written(_orders(members.join(descend, "u", "left_semi"), n_trees, n_trees), "deep")
    depths = range(LEAST, DEPTH + 1)
    found = written(crowded_regions(deep, depths, width), "crowded")
    # the longest region of few rows: in depth order, the first prefix that isn't crowded
    placed, g = deep, F.lit(None).cast("bigint")
    for d in depths:
        own = found.where(F.col("depth") == d).select(F.col("prefix").alias(f"p{d}"), F.col("blocks").alias(f"blocks{d}"))
        placed = placed.withColumn(f"p{d}", _prefix("label", d, width)).join(own, f"p{d}", "left")
        g = F.coalesce(g, F.when(F.col(f"blocks{d}").isNull(), region(d)))
    last, blocks = region(DEPTH), f"blocks{DEPTH}"
    block = F.pmod(F.xxhash64("u", last), F.col(blocks)).cast("int")
    placed = placed.withColumns({"few": g, "last": last}).withColumn("g", F.coalesce("few", F.xxhash64("last", block)))
    small = rows.join(crowded, "prefix", "left_anti").select(region(LEAST).alias("g"), "label", "u", "sketch")
    edges = written(_region_edges(small.unionByName(placed.select("g", "label", "u", "sketch")), least).where("a <> b").distinct(), "edges")
    leaves = placed.where("few is null").select(F.col("last").alias("group"), F.col(blocks).alias("blocks"), "u", "sketch")
    if leaves.isEmpty():
        return edges
    known = components(edges).withColumnsRenamed({"vertex": "u", "component": "comp"})
    leaves = leaves.join(known, "u", "left").withColumn("comp", F.coalesce("comp", "u"))
    settled = known.select(F.col("u").alias("a"), F.col("comp").alias("b"))
    return settled.unionByName(_stray_edges(_stray_meetings(leaves, REGION), least)).distinct()


def _links(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None, over: int, under: int) -> list[tuple[int, int]]:
    """A spanning set of the links ``under * intersection >= over * union`` among all, or between
    rows of side 0 and rows of side 1."""
    m = len(ids)
    n = np.fromiter(map(len, sets), np.int64, m)
    if m == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if under * inter >= over * (n[0] + n[1] - inter) else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), n)
    order = np.argsort(flat, kind="stable")
    value = flat[order]
    head = np.concatenate([[True], value[1:] != value[:-1]])
    begin = np.flatnonzero(head)
    count = np.diff(np.append(begin, len(value)))
    number = np.empty(len(flat), np.int32)
    number[order] = np.cumsum(head) - 1
    owners = owner[order]
    del flat, value, owner, order, head
    shared = count > 1
    start = np.cumsum(n) - n
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(m) if sides is None else np.flatnonzero(sides == 0).tolist():
        own = number[start[i] : start[i] + n[i]]
        own = own[shared[own]]
        if not len(own):
            continue
        c = count[own]
        at = np.repeat(begin[own] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        inter = np.bincount(owners[at], minlength=m)
        linked = under * inter >= over * (n[i] + n - inter)
        linked[i] = False
        if sides is not None:
            linked &= sides == 1
        for j in np.flatnonzero(linked).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((ids[i], ids[j]))
    return out


def _compare(rows: DataFrame, shingle: int, over: int, under: int, sided: bool) -> DataFrame:
    """Links inside each group g of rows (g, u, side, text); if ``sided``, from side 0 to side 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def batched() -> Iterator[pd.DataFrame]:
            for batch in batches:  # sets instead of texts as soon as they are read
                for start in range(0, len(batch), 256):
                    x = batch.iloc[start : start + 256]
                    sets = np.empty(len(x), object)
                    sets[:] = [shingle_set(words_of(t), shingle) for t in x["text"]]
                    yield x.drop(columns="text").assign(set=sets)

        for (_, u, side, sets), ends in _by_group(batched(), ["g", "u", "side", "set"]):
            found: list[tuple[int, int]] = []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                # rows that were read twice stand next to each other
                new = a + np.flatnonzero(np.concatenate([[True], (u[a + 1 : b] != u[a : b - 1]) | (side[a + 1 : b] != side[a : b - 1])]))
                if len(new) > 1:
                    found += _links(u[new], list(sets[new]), side[new] if sided else None, over, under)
            if found:
                yield stars(found)

    out = rows.repartition("g").sortWithinPartitions("g", "u", "side").select("g", "u", "side", "text").mapInPandas(handing_back(run), "a bigint, b bigint")
    return out.where("a <> b")


def _confirmed(clusters: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges whose components are those of all links inside ``clusters`` (u, n, cluster); texts: u, text."""
    sizes = clusters.groupBy("cluster").agg(
        F.count("*").alias("m"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = clusters.join(sizes, "cluster")
    pilot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("u", F.lit(2)), F.col("m")) < PILOTS)
    block = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    block = F.explode(F.when(pilot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block)))
    met = placed.withColumn("block", block).select("u", F.xxhash64("cluster", "block").alias("g"), F.lit(0).alias("side"))
    links = written(_compare(texts.join(met, "u"), shingle, percent, 100, sided=False), "links")
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return links
    known = components(links).withColumnsRenamed({"vertex": "u", "component": "comp"})
    settled = known.select(F.col("u").alias("a"), F.col("comp").alias("b"))
    large = large.join(known, "u", "left").select(F.col("cluster").alias("group"), "blocks", "u", F.coalesce("comp", "u").alias("comp"))
    met = _stray_meetings(large, BLOCK).select("u", "g", "side")
    return settled.unionByName(_compare(texts.join(met, "u"), shingle, percent, 100, sided=True))


def _answers(docs: DataFrame, shingle: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept of each row."""
    p = percent / 100
    n_trees = trees_for(p, miss / 2, DEPTH)
    shallow = min(n_trees, trees_for(p, miss / 2, LEAST))
    signed = written(sign(docs, shingle, DEPTH * n_trees, id_col, text_col), "signed")
    # copies: one member for each word sequence, with its smallest doc_id and that row's text
    first = F.min(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), "h", "n", "sig")).alias("x")
    members = signed.where("n > 0 and doc_id is not null").groupBy("seq").agg(first)
    # numbers are written with the rows: whatever a retried task does, one number is one text
    members = written(members.select("seq", F.monotonically_increasing_id().alias("u"), F.col("x.doc_id").alias("first"), "x.h", "x.n", "x.sig"), "members")
    least = p - 5 * math.sqrt(p * (1 - p) / min(SKETCHED, DEPTH * n_trees)) - 0.02
    # members of one shingle are linked with equal ones only (from 51 percent): no order is needed for them
    edges = candidate_edges(members if percent <= 50 else members.where("n > 1"), n_trees, least, shallow)
    alone = members.where("n = 1").withColumn("shingle", F.xxhash64("sig"))
    least_of = alone.groupBy("shingle").agg(F.min("u").alias("a"), F.count("*").alias("count")).where("count > 1").select("shingle", "a")
    edges = edges.unionByName(alone.join(least_of, "shingle").select("a", F.col("u").alias("b")).where("a <> b"))
    clusters = components(edges).withColumnsRenamed({"vertex": "u", "component": "cluster"})
    return resolved(docs, signed, members, clusters, shingle, percent, id_col, text_col)


def resolved(docs: DataFrame, signed: DataFrame, members: DataFrame, clusters: DataFrame, shingle: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept of each row, from ``clusters`` (u, cluster), inside which
    all links lie. ``signed`` has doc_id, h, seq, n of each row; ``members`` has u, first, h, n of each seq."""
    spark = docs.sparkSession
    clusters = written(clusters.join(members.select("u", "first", "h", "n"), "u"), "clusters")
    rows = docs.select(F.col(id_col).cast("bigint").alias("first"), text_hash(text_col).alias("h"), F.col(text_col).cast("binary").alias("text")).where("first is not null")
    keyed = clusters.select(F.xxhash64("first", "h").alias("key"))
    rows = possible(rows, F.xxhash64("first", "h"), keyed, "key", clusters.count())
    texts = written(rows.join(clusters.select("u", "first", "h"), ["first", "h"]).select("u", "text"), "texts")
    linked = components(_confirmed(clusters.select("u", "n", "cluster"), texts, shingle, percent))
    names = linked.join(members.select(F.col("u").alias("vertex"), "first"), "vertex")
    names = names.join(names.groupBy("component").agg(F.min("first").alias("name")), "component").select(F.col("vertex").alias("u"), "name")
    named = written(members.select("seq", "u", "first").join(names, "u", "left").select("seq", F.coalesce("name", "first").alias("component_id")), "named")
    forget(spark, texts, clusters, members)
    kind = docs.schema[id_col].dataType
    out = signed.select("doc_id", "h", "seq", "n").join(named, "seq", "left")
    own = F.col("component_id").cast(kind)
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), own).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    miss: float = 1e-5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id: an integer).

    Links are ``100 * |A & B| >= percent * |A | B|``, confirmed on full sets."""
    return _answers(docs, shingle, percent, miss, id_col, text_col).drop("h")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all its columns.

    Rows, not ids, are dropped: another text of the same doc_id stays. Of rows that repeat
    doc_id and text one stays, if the text has words; rows without words or doc_id all stay."""
    found = _answers(docs, shingle, percent, miss, "doc_id", "text")
    counted = found.groupBy("doc_id", "h", "kept").agg(F.count("*").alias("m"), F.max("n_shingles").alias("n"))
    todo = written(counted.where("not kept or m > 1 and n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "kept"), "gone")
    # only rows that may be among those meet the joins; the others aren't shuffled
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_hash("text").alias("hash"))
    some, rest = parted(rows, F.xxhash64("id", "hash"), todo.select(F.xxhash64("id", "hash").alias("key")), "key", todo.count())
    # a semi or anti join would be pushed below the filter, where all texts meet it: an outer one stays above
    told = some.join(todo, ["id", "hash"], "left")
    left = told.where("kept is null").drop("kept")
    one = told.where("kept").drop("kept").dropDuplicates(["id", "hash"])
    return rest.unionByName(left).unionByName(one).select("row.*")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
