"""Concatenate and cut.

Pass 1 tokenizes every document in the partition it is read in and writes ids with their
place among the partition's tokens, so a partition's last place is its token total. Prefix
sums of those totals (one number a task) give each partition's global offset. Pass 2 cuts the
token stream at multiples of the window; a document that crosses a cut leaves a piece in each
window it touches. Nothing is shuffled: texts and ids stay in the partition they are read in.

Cases: a null or empty text is the end id alone; repeated rows are packed each for itself;
very long texts span as many windows as they need; an empty table gives no rows; further
columns aren't read. Windows are full but for the last.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, handing_back, table, written

#: A worker's table of parts: so many, the first and so mostly the frequent ones, in a dictionary (some
#: 200 bytes each), so many more by 64-bit hash and compared byte by byte (some 40 bytes each and
#: their own, ``HELD`` in all); with more it starts anew.
CACHE, RARE, HELD = 60_000, 1_000_000, 32 << 20
#: Parts that join the hashed ones at once, and words of parts kept at hand.
FRESH, WORDS = 50_000, 100_000

#: Parts of printable ASCII and Latin letters that lower-case and normalize letter by letter.
_PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e]+")
_LETTER = r"a-z\xdf-\xf6\xf8-\u017e"
#: The vocabulary's own way to cut lower-cased text, for such parts.
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")

#: The settings of vocabularies for which words can be cut apart as below.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Byte-level vocabularies write a printable byte as itself and the others as letters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_LETTER = {b: chr(b) for b in _PRINTABLE}
_AS_LETTER |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _AS_LETTER)}


def _by_words(settings: dict) -> bool:
    """Whether a vocabulary lower-cases, drops white space and never reads across it."""
    normal, cuts = settings["normalizer"] or {}, (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
    split, level = cuts if len(cuts) == 2 else ({}, {})
    return (
        normal.get("normalizers") == _NORMALIZER
        and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": _SPLITTER}, "Removed", True)
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
    )


class CachedTokenizer:
    """Token ids of whole texts.

    If the vocabulary's splitter drops white space and never reads across it, the ids of a text
    are those of its white-space-separated parts in turn; parts seen before are looked up. With
    other vocabularies texts go to the tokenizer whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _by_words(json.loads(self.tokenizer.to_str()))
        self.clear()

    @classmethod
    def of(cls, path: str) -> CachedTokenizer:
        if path not in KEPT:
            KEPT.clear()
            KEPT[path] = cls(path)
        return KEPT[path]

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes = np.empty(0, np.int64)  # sorted, of the parts that aren't in ``number``
        self.slots = np.empty(0, np.int32)
        self.text = bytearray()  # their bytes, and where each one's begin and end
        self.begins = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int32)
        self.pieces: dict[str, bytes] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int32)
        self.lengths = np.zeros(1 << 14, np.int32)
        self.used = self.count = 0

    def _learn(self, parts: list[bytes]) -> None:
        texts = [p.decode() for p in parts]
        cuts = [_CUT.findall(t.lower()) if "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        pieces, model = self.pieces, self.tokenizer.model
        found = dict.fromkeys(piece for c in cuts if c for piece in c if piece not in pieces)
        for piece in found:
            # what is left to do for one word of the cut text: bytes as letters, then merges
            ids = model.tokenize(piece if piece.isascii() else "".join(map(_AS_LETTER.__getitem__, piece.encode())))
            found[piece] = array("I", [t.id for t in ids]).tobytes()
        if len(pieces) < WORDS:
            pieces.update(found)
            found = pieces
        get = pieces.__getitem__ if found is pieces else lambda piece: pieces.get(piece) or found[piece]
        whole = iter(self.tokenizer.encode_batch_fast([t for t, c in zip(texts, cuts) if not c], add_special_tokens=False))
        ids = [b"".join(map(get, c)) if c else array("I", next(whole).ids).tobytes() for c in cuts]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = self.used + np.cumsum(lengths)
        k, to = self.count, self.count + len(parts)
        while to > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while int(ends[-1]) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : int(ends[-1])] = np.frombuffer(b"".join(ids), np.uint32)
        self.starts[k:to], self.lengths[k:to] = ends - lengths, lengths
        self.number.update(zip(parts, range(k, to)))
        self.used, self.count = int(ends[-1]), to

    def _fold(self) -> None:
        """Move parts beyond the first ones to the table by hash."""
        late = list(islice(self.number.items(), CACHE, None))
        for part, _ in late:
            del self.number[part]
        names = [part for part, _ in late]
        size = np.fromiter(map(len, names), np.int32, len(names))
        begins = np.concatenate([self.begins, len(self.text) + np.cumsum(size, dtype=np.int64) - size])
        self.text += b"".join(names)
        hashes = np.concatenate([self.hashes, np.fromiter(map(hash, names), np.int64, len(names))])
        slots = np.concatenate([self.slots, np.fromiter((i for _, i in late), np.int32, len(late))])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.slots, self.begins, self.sizes = hashes[order], slots[order], begins[order], np.concatenate([self.sizes, size])[order]

    def _find(self, parts: list[bytes]) -> np.ndarray:
        which = np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(which < 0)
        if len(missing) and len(self.hashes):
            h = np.fromiter((hash(parts[i]) for i in missing.tolist()), np.int64, len(missing))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            missing, at = missing[known], at[known]
            # of parts of one hash the first is found, the others are learned anew
            begin, size, text = self.begins[at], self.sizes[at], self.text
            same = [z == len(p) and text.startswith(p, b) for i, b, z in zip(missing.tolist(), begin.tolist(), size.tolist()) for p in (parts[i],)]
            same = np.array(same, bool)
            which[missing[same]] = self.slots[at[same]]
        return which

    def encode_batch(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        if not self.by_words:
            whole = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array([*e.ids, end], np.uint32) for e in whole]
        parts: list[bytes] = []
        marks = []
        for t in texts:
            parts += t.split()
            marks.append(len(parts))
        which = self._find(parts)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            if self.count >= RARE or self.used >= 8 * RARE or len(self.text) >= HELD:
                self.clear()
                return self.encode_batch(texts, end)
            self._learn(list(dict.fromkeys(parts[i] for i in missing.tolist())))
            which[missing] = np.fromiter((self.number[parts[i]] for i in missing.tolist()), np.int64, len(missing))
            if len(self.number) > CACHE + FRESH:
                self._fold()
        lengths = self.lengths[which].astype(np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(parts) else 0
        flat = self.ids[np.arange(n) + np.repeat(self.starts[which] - (ends - lengths), lengths)] if n else np.empty(0, np.uint32)
        cuts = np.concatenate([[0], ends])[[0, *marks]].tolist()
        return [np.append(flat[a:b], np.uint32(end)) for a, b in zip(cuts, cuts[1:])]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part (the task's number), at (tokens of the part before), n, ids (little-endian
    uint32), written to the shared folder: pass 2 and any retry read the same numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = CachedTokenizer.of(tokenizer or word_bpe_path())
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, len(batch), 256):  # bounds the ids held for an Arrow batch
                rows = batch.iloc[start : start + 256]
                ids = words.encode_batch([t or b"" for t in rows["text"]], end_id)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pd.DataFrame(
                    {"doc_id": rows["doc_id"].to_numpy(object), "part": part, "at": before, "n": n, "ids": [x.astype("<u4").tobytes() for x in ids]}
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return written(rows.mapInPandas(handing_back(encode, keeps=True), f"doc_id {kind}, part int, at bigint, n bigint, ids binary"), "tokens")


def pack(docs: DataFrame, window: int = 2048, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = tokenize(docs, tokenizer, end_id, id_col, text_col)
    # one row a task of pass 1, however many rows there are
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total")).orderBy("part").collect()
    base, bases = 0, {}
    for r in totals:
        bases[r["part"]] = base
        base += r["total"]
    held = spark.sparkContext.broadcast(bases)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = held.value
        for x in batches:
            first = x["at"].to_numpy() + x["part"].map(before).to_numpy()
            out = []
            for doc_id, g, n, ids in zip(x["doc_id"], first.tolist(), x["n"].tolist(), x["ids"]):
                start = 0
                while start < n:
                    offset = (g + start) % window
                    length = min(window - offset, n - start)
                    out.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n, (g + start) // window, offset))
                    start += length
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            frame["doc_id"] = pd.Series([r[0] for r in out], dtype=object)
            yield frame

    return tokens.mapInPandas(
        handing_back(cut, keeps=True), f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
