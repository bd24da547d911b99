"""Benchmark decontamination by SimHash over item-sized windows.

An item and every window of its length get 128-bit SimHash fingerprints of words
and word pairs. Windows meet items in a multi-index: eight blocks of 16 bits, each
item entered under every value within 3 flips of its own block. Two fingerprints
within 31 bits agree within 3 bits in one block at least, so the index gives all
pairs within the radius. Candidates are then checked by the exact weighted
similarity of their 5-word shingles.

A window that shares no shingle with any item has similarity 0 and needs no
fingerprint; a bitmap of the items' shingles tells these before any is computed.

Indexes are built by tasks, about ITEMS_A_PASS items each, as files in the shared
folder that workers map into memory: the documents are read once, whatever the size
of the benchmark, and no items pass through the driver.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared_files import map_arrays, qualified, write_arrays
from .words import LOOSE, Words, by_bytes, mix, shingles
from .workspace import fresh_path, materialise, small_batches

SHINGLE = 5
BLOCKS, BLOCK_BITS, FLIPS = 8, 16, 3
#: Pigeonhole: BLOCKS * (FLIPS + 1) - 1.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Items in one index file, about.
ITEMS_A_PASS = 1024
#: Windows fingerprinted at once, and the words that they may start in.
WINDOWS, SPAN = 8192, 8192


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 128 bits drawn from each hash."""
    two = np.stack([mix(h), mix(h ^ np.uint64(0xA5A5A5A5C3C3C3C3))], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(two).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


class Prints:
    """Fingerprints of windows of one run of words, from prefix sums of the signs of words and of word pairs."""

    def __init__(self, words: np.ndarray):
        kind = np.int16 if len(words) < 1 << 14 else np.int32
        zero = np.zeros((1, 128), dtype=kind)
        self.one = np.concatenate([zero, np.cumsum(_signs(words), axis=0, dtype=kind)])
        self.two = np.concatenate([zero, np.cumsum(_signs(shingles(words, 2)), axis=0, dtype=kind)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(n x 8) blocks of the windows ``words[start:end]``, of one word at least."""
        total = self.one[end]
        total -= self.one[start]
        total += self.two[np.maximum(end - 1, start)]
        total -= self.two[start]
        return np.packbits(total > 0, axis=1).view(">u2").astype(np.uint16)


@functools.lru_cache(maxsize=1)
def _masks() -> np.ndarray:
    """All 16-bit numbers with at most FLIPS bits set."""
    found = [sum(1 << i for i in bits) for n in range(FLIPS + 1) for bits in itertools.combinations(range(BLOCK_BITS), n)]
    return np.array(found, dtype=np.uint16)


@dataclass(frozen=True)
class Items:
    """Benchmark items as word hashes.

    ``shared`` are the shingles of several items of the whole benchmark of ``total``
    items, in order, and ``times`` in how many they are; all others are in one or none.
    Without a total these items are the whole benchmark.
    """

    key: str
    ids: tuple[int, ...]
    words: tuple[bytes, ...]
    total: int = 0
    shared: bytes = b""
    times: bytes = b""


def _index_arrays(ids: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    """What an index file holds: ids, words with their offsets, known shingles, their bitmap, fingerprints, and a table for each block."""
    sets = [np.unique(shingles(w, min(SHINGLE, len(w)))) for w in words]
    known = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
    bitmap = np.zeros(1 << 20, dtype=np.uint8)
    bitmap[(known >> np.uint64(44)).astype(np.int64)] = 1
    prints = np.concatenate([Prints(w).of(np.array([0]), np.array([len(w)])) for w in words]) if words else np.zeros((0, BLOCKS), np.uint16)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    tables = [x for b in range(BLOCKS) for x in _table(prints[:, b])]
    return [ids, np.concatenate([*words, np.zeros(0, np.uint64)]), offsets, known, np.packbits(bitmap, bitorder="little"), prints.ravel(), *tables]


def _table(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items by every value within FLIPS flips of their own block: where each value's items start, and the items."""
    near = (block[:, None] ^ _masks()[None, :]).astype(np.int64)
    owner = np.repeat(np.arange(len(block), dtype=np.int32), near.shape[1])
    order = np.argsort(near.ravel(), kind="stable")
    return np.searchsorted(near.ravel()[order], np.arange((1 << BLOCK_BITS) + 1)), owner[order]


class Index:
    """Multi-index over some items' fingerprints, with their shingles; weights are those of the whole benchmark."""

    def __init__(self, items: Items):
        arrays = _index_arrays(np.array(items.ids, dtype=np.int64), [np.frombuffer(w, dtype=np.uint64) for w in items.words])
        if items.total:
            common = [np.array([items.total]), np.frombuffer(items.shared, np.uint64), np.frombuffer(items.times, np.int64)]
        else:
            every, n = np.unique(np.concatenate([*(np.unique(shingles(w, min(SHINGLE, len(w)))) for w in np.split(arrays[1], arrays[2][1:-1])), np.zeros(0, np.uint64)]), return_counts=True)
            common = [np.array([len(items.ids)]), every[n > 1], n[n > 1]]
        self._open(arrays, common)

    @classmethod
    def of(cls, arrays: list[np.ndarray], common: list[np.ndarray]) -> Index:
        out = cls.__new__(cls)
        out._open(arrays, common)
        return out

    def _open(self, arrays: list[np.ndarray], common: list[np.ndarray]) -> None:
        self.ids, self._words, offsets, self.known, bitmap, prints, *tables = arrays
        self._offsets = offsets
        self.length = np.diff(offsets)
        self.width = np.minimum(self.length, SHINGLE)
        self.widths = np.unique(self.width[self.width > 0])
        self.bitmap = np.unpackbits(bitmap, bitorder="little").view(bool)
        self.prints = prints.reshape(-1, BLOCKS)
        self.tables = list(zip(tables[::2], tables[1::2], strict=True))
        # a shingle of many items (a template) says less: weight log(1 + items / items with it)
        total = int(common[0][0])
        self.other, self.shared, self.weights = float(np.log1p(max(total, 1))), common[1], np.log1p(total / common[2])

    def item_set(self, item: int) -> np.ndarray:
        words = self._words[self._offsets[item] : self._offsets[item + 1]]
        return np.unique(shingles(words, int(self.width[item])))

    def weight(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(s), self.other)
        at = np.minimum(np.searchsorted(self.shared, s), len(self.shared) - 1)
        return np.where(self.shared[at] == s, self.weights[at], self.other)

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        maybe = np.flatnonzero(self.bitmap[(s >> np.uint64(44)).astype(np.int64)])
        return maybe[np.isin(s[maybe], self.known)]

    def near(self, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item) of the same size whose fingerprints are within RADIUS bits."""
        windows, items = [], []
        for b, (starts, owner) in enumerate(self.tables):
            v = prints[:, b]
            lo = starts[v]
            n = starts[v.astype(np.int64) + 1] - lo
            w = np.repeat(np.arange(len(v)), n)
            i = owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(w))]
            same = self.length[i] == size[w]
            windows.append(w[same]), items.append(i[same])
        w, i = np.concatenate(windows), np.concatenate(items).astype(np.int64)
        close = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1) <= RADIUS
        pair = np.unique(w[close] * len(self.ids) + i[close])
        return pair // len(self.ids), pair % len(self.ids)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and the item's."""
        s = np.unique(shingles(window, int(self.width[item])))
        t = self.item_set(item)
        both = self.weight(np.intersect1d(s, t)).sum()
        union = self.weight(np.union1d(s, t)).sum()
        return float(both / union) if union else 0.0

    def search(self, words: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
        """Items found in a text's words: item -> (best similarity, start, end) in words."""
        found: dict[int, tuple[float, int, int]] = {}
        n = len(words)
        marked = np.zeros(n, dtype=bool)
        for k in self.widths:
            marked[self.hits(shingles(words, int(k)))] = True
        hit = np.flatnonzero(marked)
        if not len(hit):
            return found
        start, end = [], []
        for size in np.unique(self.length[self.length > 0]):
            # windows of this size that hold a hit; a shorter text is one window
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, np.maximum(hit - size + 1, 0), 1)
            np.add.at(edge, hit + 1, -1)
            s = np.unique(np.minimum(np.flatnonzero(np.cumsum(edge[:-1]) > 0), max(n - size, 0)))
            start.append(s), end.append(s + size)
        start, end = np.concatenate(start), np.concatenate(end)
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        at = 0
        while at < len(start):
            # so many windows, and so many words, at a time
            to = max(at + 1, min(at + WINDOWS, int(np.searchsorted(start, start[at] + SPAN))))
            s, size = start[at:to], end[at:to] - start[at:to]
            e, lo = np.minimum(end[at:to], n), int(start[at])
            prints = Prints(words[lo : int(e.max())]).of(s - lo, e - lo)
            for a, item in zip(*self.near(prints, size), strict=True):
                got = self.similarity(words[s[a] : e[a]], int(item))
                if got >= threshold and got > found.get(int(item), (0.0,))[0]:
                    found[int(item)] = (got, int(s[a]), int(e[a]))
            at = to
        return found


@functools.lru_cache(maxsize=1024)
def _mapped(path: str, common: str) -> Index:
    return Index.of(map_arrays(path), map_arrays(common))


def _search(docs: DataFrame, folder: str, files: int, threshold: float) -> DataFrame:
    """``docs`` (document, __text) with the items found in place of the text."""
    names = [c for c in docs.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__text").to_pylist()
            leaks: list[list[dict]] = [[] for _ in texts]
            for lo, hi in by_bytes(texts):
                w = Words(texts[lo:hi], LOOSE, lower=True)
                runs: dict[int, np.ndarray] = {}
                for f in range(files):
                    index = _mapped(f"{folder}/items-{f}", f"{folder}/shared")
                    suspect = np.zeros(hi - lo, dtype=bool)
                    for k in index.widths.tolist():
                        if k not in runs:
                            runs[k] = shingles(w.hash, k)
                        suspect[np.searchsorted(w.offset, index.hits(runs[k]), side="right") - 1] = True
                    for d in np.flatnonzero(suspect):
                        found = index.search(w.hash[w.offset[d] : w.offset[d + 1]], threshold)
                        leaks[lo + d] += [{"item": int(index.ids[i]), "similarity": s, "start_word": p, "end_word": q} for i, (s, p, q) in sorted(found.items())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(leaks, _LEAKS)], names=[*names, "leaks"])

    return docs.mapInArrow(run, StructType([*[docs.schema[c] for c in names], *StructType.fromDDL(f"leaks {_LEAK}").fields]))


_LEAK = "array<struct<item:bigint,similarity:double,start_word:bigint,end_word:bigint>>"
_LEAKS = pa.list_(pa.struct([("item", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of every item; and a null for each item with words."""
    for b in batches:
        texts = b.column("text").to_pylist()
        for lo, hi in by_bytes(texts):
            w = Words(texts[lo:hi], LOOSE, lower=True)
            for i in range(hi - lo):
                h = w.hash[w.offset[i] : w.offset[i + 1]]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([None, *np.unique(shingles(h, min(SHINGLE, len(h)))).view(np.int64).tolist()], pa.int64())], names=["shingle"])


def write_index(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[str, int]:
    """The folder and number of index files of the benchmark; items without words or id are left out, equal rows merge."""
    spark = benchmark.sparkSession
    folder = qualified(spark, fresh_path(spark, "items"))
    rows = benchmark.select(F.col(f"`{item_col}`").cast("bigint").alias("item"), F.col(f"`{text_col}`").alias("text")).where("item is not null and text is not null").distinct()
    rows = materialise(rows, "benchmark")
    files = max(1, -(-rows.count() // ITEMS_A_PASS))
    times = materialise(rows.select("text").mapInArrow(_item_shingles, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1 or shingle is null"), "shared")
    total = times.where("shingle is null").agg(F.sum("n")).first()[0] or 0

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(parts) if parts else pa.table({"shingle": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        s, n = table["shingle"].to_numpy().view(np.uint64), table["n"].to_numpy()
        order = np.argsort(s)
        write_arrays(f"{folder}/shared", [np.array([total]), s[order], n[order].astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array([len(s)], pa.int64())], names=["n"])

    # shingles of several items: one row each, a small part of the benchmark
    times.where("shingle is not null").repartition(1).mapInArrow(shared, "n bigint").collect()

    def build(table: pa.Table) -> pa.Table:
        file = table["file"][0].as_py()
        part = sorted((i, t) for i, t in zip(table["item"].to_pylist(), table["text"].to_pylist(), strict=True) if i is not None)
        w = Words([t for _, t in part], LOOSE, lower=True)
        words = [w.hash[lo:hi] for lo, hi in zip(w.offset[:-1], w.offset[1:], strict=True)]
        some = [k for k, x in enumerate(words) if len(x)]
        write_arrays(f"{folder}/items-{file}", _index_arrays(np.array([part[k][0] for k in some], dtype=np.int64), [words[k] for k in some]))
        return pa.table({"file": pa.array([file], pa.int64())})

    # every file has a row of its own, so that none is missing
    dealt = rows.select(F.pmod(F.xxhash64("item"), F.lit(files)).cast("bigint").alias("file"), "item", "text")
    dealt = dealt.unionByName(spark.range(files).select(F.col("id").alias("file"), F.lit(None).cast("bigint").alias("item"), F.lit(None).cast("string").alias("text")))
    dealt.groupBy("file").applyInArrow(build, "file bigint").collect()
    return folder, files


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, item_col: str = "item_id", item_text_col: str = "text", text_col: str = "text") -> DataFrame:
    """Every row as a struct ``document`` of all its columns, with leaks: items found in its whole text, best window each.

    Words are runs of letters and digits in lower case, so marks around a word do
    not hide a passage. An item leaks into a text if a window of the item's length
    (the whole text, if shorter) has a weighted 5-word-shingle similarity of
    ``threshold`` or more with it; an item of fewer words is one shingle. Null and
    empty texts, and items without words, never match. Repeated rows are searched
    each by itself; of windows equally similar the first is told. Empty tables on
    either side give no leaks.
    """
    small_batches(docs.sparkSession)
    folder, files = write_index(benchmark, item_col, item_text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col(f"`{text_col}`").alias("__text"))
    return _search(rows, folder, files, threshold)
