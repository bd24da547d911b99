"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles. Documents of equal sets become one
node. Shingles are hashed into blocks, and a block's parity word is the XOR of the
64-bit hashes in it: a linear sketch in which every shingle that only one of two
sets has changes one block at most, so the number of differing blocks bounds the
symmetric difference from below. Sets of a and b shingles that link differ in
(a + b) / 7 shingles at most, a third of the smaller one; so of each set's non-empty
blocks, in one order for all, the first floor(n / 3) + 1 hold one that both have
(pigeonhole with prefixes). Nodes that share a block of a size band are candidates.

Candidates must then pass a second parity sketch, of single bits, whose Hamming
distance bounds the symmetric difference in the same way. What passes is verified
on the sets. Pairs are compared where their nodes meet and never sent out. First
every node meets those of its home, the largest group that it is in, part by part and
then across parts where classes differ; then, of the other groups, only pairs of different homes that are still in different classes are
compared, and of groups of the same members one. So what many near copies share is
compared once, not once for each block. Links that join classes are verified until
they are joined; when all classes are known, the links within each are counted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .words import SPACE, Words, by_bytes, mix, shingles
from .workspace import columns_as, drop, materialise, small_batches

SHINGLE = 5
#: Links take at least NUM / DEN of the union; the bounds in the text above follow from 3 / 4.
NUM, DEN = 75, 100
#: Groups of more nodes are compared in squares of two such parts.
SQUARE = 512
#: Shingles of one part, about, where sets themselves are compared.
SQUARE_SHINGLES = 1 << 20
#: Pairs whose sketches are compared at once, and columns of a table of sets.
PAIRS, COLUMNS = 1 << 15, 1 << 12


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    for lo, hi in by_bytes(texts):
        w = Words(texts[lo:hi], SPACE, lower=True)
        for d in range(hi - lo):
            h = w.hash[w.offset[d] : w.offset[d + 1]]
            yield np.unique(shingles(h, min(k, len(h)))) if len(h) else np.zeros(0, dtype=np.uint64)


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """A 96-bit digest of the set: what tells nodes apart before they get their numbers."""
    n = np.uint64(len(s))
    x = mix(np.array([np.add.reduce(mix(s)) + n, np.add.reduce(mix(s ^ np.uint64(0x6A09E667F3BCC909))) ^ n], dtype=np.uint64))
    return int(x.view(np.int64)[0]), int(x.view(np.int32)[2])


def bits_of(n: int) -> int:
    """Bits of the single-bit sketch: a power of two, two to four times the set's size, so that few shingles share a bit; 64 at least."""
    return max(64, 2 << int(n).bit_length())


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles in each bit's class; a sketch of half the size is the XOR of the halves."""
    b = bits_of(len(s))
    odd = np.bincount((s >> np.uint64(8)).astype(np.int64) & (b - 1), minlength=b) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def blocks_in(band: int) -> int:
    """Blocks of a size band, 2**band to 2**(band + 1) shingles: one to two shingles a block, and for small sets one.

    A set keeps over a third of its size in non-empty blocks but for a chance below 1e-10.
    """
    top = 2 << band
    return 1 << 16 if top <= 64 else top if top <= 256 else top // 2


def block_keys(s: np.ndarray) -> np.ndarray:
    """The parity words, as keys, that a set must be looked up by: those of its band, and of the band below if a partner may lie there."""
    n = len(s)
    if not n:
        return np.zeros(0, dtype=np.int64)
    own = n.bit_length() - 1
    keys = []
    for band in (own, own - 1):
        if band < own and (band < 0 or NUM * n > DEN * ((1 << own) - 1)):
            break
        m = blocks_in(band)
        block = (s >> np.uint64(32)) % np.uint64(m)
        order = np.argsort(block, kind="stable")
        at = block[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        word = np.bitwise_xor.reduceat(s[order], first)
        count = np.diff(np.append(first, n))
        # the common order of blocks: fuller ones first, for few documents share them by chance
        best = np.lexsort((at[first], -count))[: n // 3 + 1]
        keys.append(mix(word[best] ^ mix(at[first][best] + np.uint64((band + 1) << 40) + (count[best].astype(np.uint64) << np.uint64(48)))))
    return np.concatenate(keys).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        n, digest, sketch = [], [], []
        for s in shingle_sets(texts):
            n.append(len(s)), digest.append(digest_of(s)), sketch.append(bit_sketch(s) if len(s) else None)
        d, more = zip(*digest, strict=True) if digest else ((), ())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(more, pa.int32()), pa.array(sketch, pa.binary())], names=["id", "n", "digest", "more", "sketch"])


#: Digests that a worker remembers, so that it gives the keys of copies once.
REMEMBERED = 1 << 17
#: Keys of one bucket, about, and those that a worker holds at once.
BUCKET_KEYS, HELD_KEYS = 1 << 20, 1 << 22


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _keys(buckets: int):
    """Keys of every set, once for each that the task has not just had: (bucket, rows), rows being the keys in order, each with the number of its digest, and the digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            keys, digests = [np.zeros(0, np.int64)], []
            for s in shingle_sets(b.column("text").to_pylist()):
                d = digest_of(s)
                if len(s) and d not in seen:
                    seen.add(d)
                    keys.append(block_keys(s)), digests.append(d)
            if len(seen) > REMEMBERED:
                seen.clear()
            if not digests:
                continue
            key = np.concatenate(keys)
            owner = np.repeat(np.arange(len(digests)), [len(k) for k in keys[1:]])
            named = np.array(digests, dtype=np.int64)
            order = np.argsort(key.view(np.uint64))
            key, owner = key[order], owner[order]
            bucket = _bucket(key, buckets)
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            blobs = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                some, number = np.unique(owner[lo:hi], return_inverse=True)
                kind = np.uint16 if len(some) < 1 << 16 else np.uint32
                blobs.append(np.array([hi - lo, len(some), kind().itemsize], np.int64).tobytes() + key[lo:hi].tobytes() + named[some, 0].tobytes() + named[some, 1].astype(np.int32).tobytes() + number.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    return run


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k, size = np.frombuffer(blob, np.int64, 3).tolist()
    key = np.frombuffer(blob, np.int64, n, 24)
    digest, more = np.frombuffer(blob, np.int64, k, 24 + 8 * n), np.frombuffer(blob, np.int32, k, 24 + 8 * n + 8 * k)
    number = np.frombuffer(blob, np.uint16 if size == 2 else np.uint32, n, 24 + 8 * n + 12 * k)
    return key, digest[number], more[number]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets in; rows (key, digest, more, size) of the keys that several digests have out, size being how many.

    Of a bucket with more than HELD_KEYS rows, keys known to be shared are passed on
    at once (size is then what was seen so far, and a row may come twice): only keys
    of one digest are held.
    """
    held: list[tuple[np.ndarray, ...]] = []
    known = np.zeros(0, dtype=np.int64)
    now, n = -1, 0

    def settle(last: bool):
        nonlocal held, known, n
        key, digest, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((more, digest, key))
        key, digest, more = key[order], digest[order], more[order]
        new = np.append(True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]) | (more[1:] != more[:-1]))
        key, digest, more = key[new], digest[new], more[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        many = size > 1
        if len(known):
            many |= np.isin(key[first], known)
        rows = np.repeat(many, size)
        out = pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(digest[rows]), pa.array(more[rows]), pa.array(np.repeat(size, size)[rows].astype(np.int32))], names=["key", "digest", "more", "size"])
        held, n = [], 0
        if last:
            known = known[:0]
        else:
            known = np.union1d(known, key[first][many])
            held, n = [(key[~rows], digest[~rows], more[~rows])], int((~rows).sum())
        return out

    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
            if bucket != now and held:
                yield settle(True)
            now = bucket
            held.append(_opened(blob.as_py()))
            n += len(held[-1][0])
            if n >= HELD_KEYS and len(held) > 1 and n >= 2 * len(held[0][0]):
                yield settle(False)
    if held:
        yield settle(True)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def fold_distance(i: np.ndarray, j: np.ndarray, size: np.ndarray, start: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    """Hamming distances of pairs of sketches, which lie at ``start`` in ``buffer`` with ``size`` bytes each, at the smaller size of both."""
    far = np.zeros(len(i), dtype=np.int64)
    common = np.minimum(size[i], size[j])
    for bytes_ in np.unique(common):
        at = np.flatnonzero(common == bytes_)
        nodes, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        table = np.zeros((len(nodes), bytes_ // 8), dtype=np.uint64)
        for own in np.unique(size[nodes]):
            mine = np.flatnonzero(size[nodes] == own)
            lines = np.concatenate([buffer[x : x + own] for x in start[nodes[mine]].tolist()]).reshape(len(mine), own)
            table[mine] = np.ascontiguousarray(_fold(lines, bytes_)).view(np.uint64)
        for lo in range(0, len(at), PAIRS):
            x, y = back[lo : min(lo + PAIRS, len(at))], back[len(at) + lo : len(at) + min(lo + PAIRS, len(at))]
            far[at[lo : lo + PAIRS]] = np.bitwise_count(table[x] ^ table[y]).sum(axis=1)
    return far


class _Cells:
    """Complete cells of rows in order, as columns; binary ones as offsets into a buffer."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.columns = {}
        for f in table.schema:
            c = table[f.name].chunk(0) if table.num_rows else table[f.name]
            if pa.types.is_binary(f.type):
                offsets = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset).astype(np.int64)
                self.columns[f.name] = (offsets, np.frombuffer(c.buffers()[2] or b"", np.uint8))
            else:
                self.columns[f.name] = c.to_numpy(zero_copy_only=False)
        cell = self.columns["cell"]
        self.first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.size = np.diff(np.append(self.first, len(cell)))

    def __getitem__(self, name: str):
        return self.columns[name]

    def binary(self, name: str, row: int) -> np.ndarray:
        offsets, buffer = self.columns[name]
        return buffer[offsets[row] : offsets[row + 1]]

    def pairs(self, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows i < j of the same cell, about ``most`` at a time."""
        for k in np.unique(self.size[self.size > 1]):
            i, j = _triangle(int(k)) if k <= 64 else np.triu_indices(int(k), 1)
            starts = self.first[self.size == k]
            step = max(1, most // len(i))
            for lo in range(0, len(starts), step):
                at = starts[lo : lo + step, None]
                yield (at + i).ravel(), (at + j).ravel()

    def passing(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows whose sizes and sketches allow a link, with their distance: of both sides of a square, of different homes and of different classes."""
        n, side, home, root = self["n"], self["side"], self["home"], self["root"]
        offsets, buffer = self["sketch"]
        found = [(np.zeros(0, np.int64),) * 3]
        for i, j in self.pairs():
            ok = ((side[i] == 0) | (side[i] != side[j])) & (root[i] != root[j]) & ((home[i] != home[j]) | (home[i] == 0))
            ok &= DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            far = fold_distance(i, j, np.diff(offsets), offsets[:-1], buffer)
            near = far <= (n[i] + n[j]) // 7
            found.append((i[near], j[near], far[near]))
        i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((j, i, far, np.searchsorted(self.first, i, side="right")))
        return i[order], j[order], far[order]


@functools.lru_cache(maxsize=64)
def _triangle(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k, 1)


def _by_cell(solve, out: pa.Schema):
    """A worker over rows sorted by cell: ``solve`` gets complete cells and gives columns of ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = solve(_Cells(pa.Table.from_batches(parts)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], side="left"))
            if cut:
                yield finish([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield finish(held)

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_FOREST = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())])
_NODES = pa.schema([("cell", pa.int64()), ("side", pa.int32()), ("node", pa.int64())])
_COUNTS = pa.schema([("node", pa.int64()), ("links", pa.int64())])


def _undecided(cells: _Cells):
    """Rows with a passing pair."""
    i, j, _ = cells.passing()
    rows = np.unique(np.concatenate([i, j]))
    return cells["cell"][rows], cells["side"][rows], cells["node"][rows]


def _forest(cells: _Cells):
    """Of each cell's passing pairs a spanning forest of its classes, nearest first; and the cells that had more pairs."""
    i, j, _ = cells.passing()
    cell, node = cells["cell"], cells["node"]
    _, comp = np.unique(cells["root"], return_inverse=True)
    # classes of one cell are not those of another
    _, comp = np.unique(np.stack([np.repeat(np.arange(len(cells.first)), cells.size), comp]), axis=1, return_inverse=True)
    comp = comp.ravel()
    forest = _Forest(int(comp.max(initial=-1)) + 1)
    sent = np.array([forest.join(x, y) for x, y in zip(comp[i].tolist(), comp[j].tolist(), strict=True)], dtype=bool)
    a, b = np.minimum(node[i[sent]], node[j[sent]]), np.maximum(node[i[sent]], node[j[sent]])
    a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
    more = np.unique(cell[i[~sent]])
    none = [None]
    return [*a.tolist(), *none * len(more)], [*b.tolist(), *none * len(more)], [*none * len(a), *more.tolist()]


def _bridges(cells: _Cells):
    """Verified links between classes, nearest first, as many as join what the cell's links join."""
    i, j, _ = cells.passing()
    _, comp = np.unique(cells["root"], return_inverse=True)
    forest = _Forest(int(comp.max(initial=-1)) + 1)
    a, b = [], []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = int(comp[x]), int(comp[y])
        if forest.root(p) != forest.root(q) and _linked(cells.binary("shingles", x).view(np.uint64), cells.binary("shingles", y).view(np.uint64)):
            forest.join(p, q)
            a.append(int(cells["node"][x])), b.append(int(cells["node"][y]))
    return a, b


def common_shingles(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets, or of all sets with all ``others``, as products of tables of zeros and ones."""
    both = [*sets, *(others or [])]
    _, column = np.unique(np.concatenate([*both, np.zeros(0, np.uint64)]), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    # columns of several sets, in the order of columns
    several = np.flatnonzero(np.bincount(column) > 1)
    number = np.full(int(column.max(initial=-1)) + 1, -1)
    number[several] = np.arange(len(several))
    column = number[column]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    row, column = row[order], column[order]
    k = len(sets)
    out = np.zeros((k, len(both) - k if others is not None else k), dtype=np.int64)
    for lo in range(0, len(several), COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        table = np.zeros((len(both), min(COLUMNS, len(several) - lo)), dtype=np.float32)
        table[row[part], column[part] - lo] = 1
        out += np.rint(table[:k] @ (table[k:] if others is not None else table).T).astype(np.int64)
    return out


def _count_links(cells: _Cells):
    """How many documents of the cell link with each node, by all pairs of its sets."""
    nodes, links = [], []
    n, side, copies, node = cells["n"], cells["side"], cells["copies"], cells["node"]
    for first, size in zip(cells.first.tolist(), cells.size.tolist(), strict=True):
        rows = np.arange(first, first + size)
        left, right = rows[side[rows] < 2], rows[side[rows] == 2]
        square = side[first] > 0
        if square and not (len(left) and len(right)):
            continue
        sets = [[cells.binary("shingles", r).view(np.uint64) for r in x] for x in (left, right)]
        both = common_shingles(sets[0], sets[1] if square else None)
        other = right if square else left
        linked = DEN * both >= NUM * (n[left][:, None] + n[other][None, :] - both)
        if not square:
            np.fill_diagonal(linked, False)
        nodes.append(node[left]), links.append(linked @ copies[other])
        if square:
            nodes.append(node[right]), links.append(linked.T @ copies[left])
    return np.concatenate([*nodes, np.zeros(0, np.int64)]), np.concatenate([*links, np.zeros(0, np.int64)])


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xa, xb = batch.column("xa"), batch.column("xb")
        mask = pa.array([_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(xa, xb, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digest, sets = [], []
        for s in shingle_sets(b.column("text").to_pylist()):
            digest.append(digest_of(s)), sets.append(s.tobytes())
        d, more = zip(*digest, strict=True) if digest else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(more, pa.int32()), pa.array(sets, pa.binary())], names=["digest", "more", "shingles"])


def _sets_of(nodes: DataFrame, rows: DataFrame, told: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes asked for, built anew from one text each."""
    ids = materialise(nodes.join(told.select("node", "id", "digest", "more"), "node"), "asked")
    found = rows.join(ids.select("id").distinct(), "id", "left_semi").mapInArrow(_sets, "digest bigint, more int, shingles binary")
    found = found.join(ids.select("node", "digest", "more"), ["digest", "more"]).groupBy("node").agg(F.first("shingles").alias("shingles"))
    return materialise(found, "sets", wide=True)


def _with_sets(nodes: DataFrame, rows: DataFrame, told: DataFrame, known: DataFrame | None) -> DataFrame | None:
    """The sets ``known`` and those of ``nodes``."""
    wanted = nodes.select("node").distinct()
    wanted = materialise(wanted if known is None else wanted.join(known.select("node"), "node", "left_anti"), "wanted")
    if not wanted.isEmpty():
        more = _sets_of(wanted, rows, told)
        known = more if known is None else known.unionByName(more)
    drop(wanted)
    return known


def _parts(count: Column) -> Column:
    return F.ceil(count / SQUARE).cast("int")


def _squares(members: DataFrame) -> DataFrame:
    """Rows (cell, parts, node, ...) of larger cells dealt into squares of two parts each, so that no task holds more than two parts: cell, side, node, ...

    Pairs of a square count if they are of both sides (1 and 2), those of a part with itself all (0).
    """
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    rows = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return rows.withColumn("cell", cell).withColumn("side", side).drop("part", "other", "parts")


def _across(members: DataFrame) -> DataFrame:
    """As ``_squares`` for rows (cell, node, home, ...) of which only pairs of different homes matter.

    Members of the home that most have are compared with the others only, so they are
    copied once for each part of the others.
    """
    most = members.groupBy("cell", "home").agg(F.count("*").alias("n_home")).groupBy("cell").agg(F.max_by("home", F.struct("n_home", "home")).alias("most"), F.max("n_home").alias("n_most"), F.sum("n_home").alias("n_all"))
    rows = members.join(most.select("cell", "most", "n_all", _parts(F.col("n_most")).alias("p_most"), _parts(F.greatest(F.col("n_all") - F.col("n_most"), F.lit(1))).alias("p_rest")), "cell")
    whole, own = F.col("n_all") <= SQUARE, F.col("home") == F.col("most")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.when(own, F.col("p_most")).otherwise(F.col("p_rest"))).cast("int")
    rows = rows.withColumn("part", part).withColumn("own", own)
    # of the others, parts 0 to p_rest - 1 are for each other and those after for the parts of the most common home
    last = F.when(whole, 0).when(own, F.col("p_rest") - 1).otherwise(F.col("p_rest") + F.col("p_most") - 1)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    among = ~F.col("own") & (F.col("other") < F.col("p_rest"))
    meets = F.when(F.col("own"), F.struct(F.col("part").alias("m"), F.col("other").alias("r"))).otherwise(F.struct((F.col("other") - F.col("p_rest")).alias("m"), F.col("part").alias("r")))
    cell = F.when(whole, F.col("cell")).when(among, F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other"))).otherwise(F.xxhash64("cell", F.lit("most"), meets["m"], meets["r"]))
    side = F.when(whole, 0).when(among, F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)).when(F.col("own"), 1).otherwise(2)
    return rows.withColumn("side", side).withColumn("cell", cell).drop("most", "n_all", "p_most", "p_rest", "own", "part", "other")


class _Joiner:
    """Joins nodes through cells: keeps the links found, and the sets that were needed for them."""

    def __init__(self, rows: DataFrame, told: DataFrame):
        self.rows, self.told, self.sets, self.links = rows, told, None, None
        self.shown = told.select("node", "n", "sketch")
        self.n_out = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def in_cells(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.n_out, "cell").sortWithinPartitions("cell", "node")

    def add(self, links: DataFrame) -> None:
        links = materialise(links.distinct(), "links")
        self.links = links if self.links is None else self.links.unionByName(links)

    def forest(self, square: DataFrame) -> DataFrame:
        """Verifies a forest of each cell's passing pairs; cells that had more pairs are left."""
        found = materialise(self.in_cells(square.join(self.shown, "node")).mapInArrow(_by_cell(_forest, _FOREST), "a bigint, b bigint, cell bigint"), "found")
        pairs = materialise(found.where("a is not null").select("a", "b").distinct(), "pairs")
        self.sets = _with_sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), self.rows, self.told, self.sets)
        if self.sets is not None:
            side = lambda c: self.sets.select(F.col("node").alias(c), F.col("shingles").alias(f"x{c}"))
            self.add(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify, "a bigint, b bigint"))
        left = materialise(found.where("cell is not null").select("cell").distinct(), "unsolved")
        drop(found)
        return left

    def settle(self, members: DataFrame) -> None:
        """Joins what the members (cell, node, home, root) of cells, of different homes, let join; takes the written table away."""
        square = materialise(_across(members), "squares", wide=True)
        drop(members)
        left = self.forest(square)
        if not left.isEmpty():
            # where a forest left pairs out, those that are still in different classes are compared on their sets
            again = materialise(_rooted(square.join(left, "cell", "left_semi").drop("root"), self.links), "squares")
            self.bridge(again)
            drop(again)
        drop(square)

    def bridge(self, square: DataFrame) -> None:
        """Verifies the passing pairs of the cells (cell, side, node, home, root) until they are joined or refuted, each cell in one place."""
        asked = materialise(self.in_cells(square.join(self.shown, "node")).mapInArrow(_by_cell(_undecided, _NODES), "cell bigint, side int, node bigint"), "undecided")
        self.sets = _with_sets(asked, self.rows, self.told, self.sets)
        if self.sets is not None:
            full = asked.join(square, ["cell", "side", "node"]).join(self.shown, "node").join(self.sets, "node")
            self.add(self.in_cells(full).mapInArrow(_by_cell(_bridges, _PAIRS), "a bigint, b bigint"))
        drop(asked)


def _rooted(df: DataFrame, links: DataFrame | None) -> DataFrame:
    """``df`` (node, ...) with root, its class by the links."""
    if links is None:
        return df.withColumn("root", F.col("node"))
    return df.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def link_nodes(rows: DataFrame, told: DataFrame, node_of, count: bool = True) -> tuple[DataFrame, DataFrame | None] | None:
    """(node, root) of all nodes that link with others, and (node, links): how many documents of other sets each of these links with (None without ``count``); None if none link.

    ``told`` has node, id, digest, more, n, sketch and copies (documents of that
    set); ``node_of`` adds the node to rows with digest and more.
    """
    total = told.agg(F.sum("n")).first()[0] or 0
    n_out = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(n_out, -(-total // (2 * BUCKET_KEYS)))
    keyed = rows.select("text").mapInArrow(_keys(buckets), "bucket int, rows binary")
    met = keyed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "key bigint, digest bigint, more int, size int")
    met = materialise(node_of(met).select("key", "node", "size"), "met", wide=True)
    homes = materialise(met.groupBy("node").agg(F.max(F.struct("size", "key")).alias("best")).select("node", F.col("best.key").alias("home")), "homes")
    joiner = _Joiner(rows, told)

    # first every node meets those of its home: those of its part, and then the other parts' where classes differ
    crowds = homes.groupBy("home").agg(F.count("*").alias("crowd")).where("crowd > 1").select("home", _parts(F.col("crowd")).alias("parts"))
    members = materialise(homes.join(crowds, "home"), "members")
    none = F.lit(0).cast("bigint")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
    square = members.select(F.when(F.col("parts") == 1, F.col("home")).otherwise(F.xxhash64("home", part)).alias("cell"), F.lit(0).alias("side"), "node", none.alias("home"), F.col("node").alias("root"))
    square = materialise(square, "squares")
    joiner.bridge(square)
    drop(square)
    large = members.where("parts > 1")
    if not large.isEmpty():
        large = _rooted(large, joiner.links).select(F.col("home").alias("cell"), "node", F.col("root").alias("home"), "root")
        mixed = large.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("cell")
        joiner.settle(materialise(large.join(mixed, "cell", "left_semi"), "members"))
    drop(members)

    # of other groups only those of several homes and several classes go on, and of groups of the same members one
    placed = materialise(_rooted(homes, joiner.links), "placed")
    groups = materialise(met.select("key", "node").join(placed, "node"), "groups", wide=True)
    mark = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    several = groups.groupBy("key").agg(F.min("home").alias("h0"), F.max("home").alias("h1"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size"), *mark).where("h0 < h1 and r0 < r1")
    several = several.groupBy("mark0", "mark1", "size").agg(F.min("key").alias("key")).select("key")
    members = materialise(groups.join(several, "key", "left_semi").select(F.col("key").alias("cell"), "node", "home", "root"), "members", wide=True)
    drop(met, groups)
    joiner.settle(members)
    if joiner.links is None:
        return None

    # all links lie within classes, and every linked node's set is known
    roots = materialise(components(joiner.links), "roots")
    if not count:
        return roots, None
    member = materialise(roots.join(told.select("node", "n", "copies"), "node"), "linked")
    parts = member.groupBy("root").agg(F.greatest(_parts(F.count("*")), F.ceil(F.sum("n") / SQUARE_SHINGLES).cast("int")).alias("parts"))
    square = _squares(member.join(parts, "root").select(F.col("root").alias("cell"), "parts", "node", "n", "copies"))
    counted = joiner.in_cells(square.join(joiner.sets, "node")).mapInArrow(_by_cell(_count_links, _COUNTS), "node bigint, links bigint")
    return roots, materialise(counted.groupBy("node").agg(F.sum("links").alias("links")), "counts")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: bool = True) -> DataFrame:
    """Every row with n_shingles, component_id, the least id reachable by links, and n_links, how many other documents it links with.

    Texts link at a Jaccard similarity of 0.75 or more of their distinct 5-word
    shingles (A-Z in lower case; words between blanks). Equal sets link. A text of
    fewer words is one shingle; null, empty and blank texts have none and link with
    nothing. Rows without an id count no one, are counted by no one and get no class.
    Rows that share an id are one document if their texts are equal, and else link as
    their texts do, each with links of its own. An empty table gives an empty result.
    Without ``count``, links are only followed, and n_links is null.
    """
    small_batches(docs.sparkSession)
    rows = columns_as(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    described = materialise(rows.mapInArrow(_describe, f"id {kind}, n bigint, digest bigint, more int, sketch binary"), "described")
    rows = rows.where("id is not null")
    some = described.where("n > 0 and id is not null")
    # copies, however many, do not meet before they are counted
    copies = some.select("digest", "more", "id").distinct().groupBy("digest", "more").agg(F.count("*").alias("copies"))
    told = some.groupBy("digest", "more").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("sketch").alias("sketch")).join(copies, ["digest", "more"])
    told = materialise(told, "nodes")
    # a node's name is its digest; sets that share one, of which there are hundreds among 10**11, are named anew
    again = materialise(told.groupBy("digest").agg(F.count("*").alias("sets")).where("sets > 1").select("digest"), "again")
    collide = not again.isEmpty()

    def node_of(df: DataFrame) -> DataFrame:
        if not collide:
            return df.withColumn("node", F.col("digest"))
        return df.join(again.withColumn("named", F.lit(True)), "digest", "left").withColumn("node", F.when(F.col("named"), F.xxhash64("digest", "more")).otherwise(F.col("digest"))).drop("named")

    told = node_of(told)
    linked = link_nodes(rows, told, node_of, count)
    nodes = told.select("node", "id", "digest", "more", "copies")
    if linked is None:
        nodes = nodes.withColumn("root", F.col("node")).withColumn("links", F.lit(0))
    else:
        nodes = nodes.join(linked[0], "node", "left").withColumn("root", F.coalesce("root", "node"))
        nodes = nodes.join(linked[1], "node", "left") if count else nodes.withColumn("links", F.lit(None).cast("bigint"))
    nodes = materialise(nodes, "classes")
    least = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    n_links = ((F.coalesce("links", F.lit(0)) if count else F.lit(None).cast("bigint")) + F.col("copies") - 1).alias("n_links")
    classes = materialise(nodes.join(least, "root").select("digest", "more", "component_id", n_links), "classes")
    out = described.select("id", "n", "digest", "more").join(classes, ["digest", "more"], "left")
    own = (F.col("n") == 0) | F.col("component_id").isNull() | F.col("id").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(own, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the least id.

    Rows without an id, and texts without words, stay. Rows that share an id are one
    document: one of them stays, and none if a text of theirs links to a lesser id.
    """
    classes = materialise(jaccard_classes(docs, id_col, text_col, count=False), "classes")
    dropped = classes.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    kept = docs.join(materialise(dropped, "dropped"), id_col, "left_anti").select(*docs.columns)
    again = materialise(classes.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "again")
    if not again.limit(1).count():
        return kept
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(once)
