"""Language-model scoring with an Elias-Fano n-gram trie.

The first level is the training corpus's vocabulary: word hashes in order, as
Elias-Fano sequences, with exact counts; a word's id is its place. Level n has, for
every n-gram of the level before, the words that follow it: monotone pointers from a
context to its successors, the successors' ids made monotone by running sums, and
quantised smoothed probabilities. An n-gram's place in its level is its context in
the next, so a lookup is a chain of successor searches, each relative to the start of
its context's range. All levels lie in files in the shared folder, which workers map
into memory. Files are cut by training tokens; a word of more tokens than a file
takes has its n-grams parted by their second words.

The model interpolates with absolute discounting: P(w|h) = a(h, w) + g(h) P(w|h'),
h' the context without its first word, a(h, w) = (c(h, w) - D) / c(h) for kept n-grams
and else 0, g(h) what is left, and 1 for contexts that the trie does not have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .shared_files import map_arrays, qualified, write_arrays
from .words import SPACE, Words, by_bytes
from .workspace import columns_as, fresh_path, materialise, small_batches

#: Words of one vocabulary file, about.
SEGMENT_WORDS = 1 << 19
#: Tokens whose words, and whose n-grams, are counted in a worker before counts are sent on; characters, and bytes of batches, scored at once.
COUNT_TOKENS, GRAM_TOKENS, SCORE_CHARS = 1 << 21, 1 << 21, 1 << 23
#: Training tokens whose n-grams share a file, about: those of one pair of words are never parted.
FILE_TOKENS = 1 << 20
#: Least count of a kept n-gram if none is asked for, and the discount.
LEAST_PAIR, DISCOUNT = 2, 0.75
#: Log probabilities are kept as multiples of 1 / GRID in 16 bits.
GRID = 1024
POWERS = 10.0 ** (np.arange(1 << 16) * (-1.0 / GRID))
END = np.uint64(0xE4D0F7E47)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's end token last, and offsets per text."""
    w = Words(texts, SPACE, lower=True)
    return np.insert(w.hash, w.offset[1:], END), w.offset + np.arange(len(w.offset))


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key, in order of keys; each key's number among them; and how often each is there."""
    order = np.argsort(key)
    at = key[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    count = np.diff(np.append(start, len(at)))
    back = np.empty(len(key), dtype=np.int64)
    back[order] = np.repeat(np.arange(len(start)), count)
    return order[start], back, count


def distinct_rows(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_numbered``, of rows of numbers from -1 on; rows are in the order of their columns."""
    key, most = columns[0] + 1, int(columns[0].max(initial=-1)) + 2
    for c in columns[1:]:
        width = int(c.max(initial=-1)) + 2
        if most > (1 << 62) // width:
            at, key, _ = _numbered(key)
            most = len(at) + 1
        key = key * width + c + 1
        most *= width
    return _numbered(key)


class Codes:
    """Log probabilities in steps of 1 / GRID: a byte each for the 255 most frequent values, and the rest by place."""

    def __init__(self, x: list[np.ndarray]):
        self.byte, self.table, self.rare, self.code = x

    @staticmethod
    def build(p: np.ndarray) -> list[np.ndarray]:
        code = np.minimum(np.rint(-np.log10(np.maximum(p, 1e-60)) * GRID), 65535).astype(np.uint16)
        often = np.bincount(code, minlength=1 << 16)
        table = np.argsort(-often, kind="stable")[:255].astype(np.uint16)
        byte = np.full(1 << 16, 255, dtype=np.uint8)
        byte[table] = np.arange(len(table), dtype=np.uint8)
        rare = np.flatnonzero(byte[code] == 255)
        return [byte[code], table, rare.astype(np.uint32), code[rare]]

    def of(self, i: np.ndarray) -> np.ndarray:
        """Probabilities at places ``i``."""
        byte = self.byte[i]
        p = np.append(POWERS[self.table], np.zeros(256 - len(self.table)))[byte]
        rare = np.flatnonzero(byte == 255)
        p[rare] = POWERS[self.code[np.searchsorted(self.rare, i[rare].astype(np.uint32))]]
        return p


@dataclass
class Model:
    """Where the files are, and the few numbers that lookups need.

    File f of n-grams begins at the pair (``word[f]``, ``next[f]``) of ids; the last
    of these is the end. ``parted`` are the words whose n-grams fill several files,
    and ``left`` is g of each.
    """

    folder: str
    bits: int
    total: int
    order: int
    base: np.ndarray
    word: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    next: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    written: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    parted: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def distinct(self) -> int:
        return int(self.base[-1])

    def words(self, segment: int) -> str:
        return f"{self.folder}/words-{segment}"

    def grams(self, file: int) -> str:
        return f"{self.folder}/grams-{file}"

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), dtype=np.int64)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0) of each word hash; ``h`` is sorted."""
        ids, counts = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        edges = np.searchsorted(self.segment(h), np.arange(len(self.base)))
        for s in np.flatnonzero((np.diff(edges) > 0) & (np.diff(self.base) > 0)):
            a = map_arrays(self.words(s))
            part = slice(edges[s], edges[s + 1])
            at = EliasFano.of(a[:4]).find(h[part] & np.uint64((1 << (64 - self.bits)) - 1))
            known = at >= 0
            small = a[4][np.maximum(at, 0)].astype(np.int64)
            big = np.flatnonzero(known & (small == 255))
            small[big] = a[6][np.searchsorted(a[5], at[big])]
            ids[part] = np.where(known, at + self.base[s], -1)
            counts[part] = np.where(known, small, 0)
        return ids, counts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def edges(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Where the pairs of each file begin among these, which are in order; v may be -1."""
        at = np.searchsorted(u, self.word)
        for f in np.flatnonzero(self.next > 0):
            end = np.searchsorted(u, self.word[f], side="right")
            at[f] += np.searchsorted(v[at[f] : end], self.next[f])
        return at

    def last(self, file: int) -> int:
        """One past the last first word of a file."""
        return int(self.word[file + 1] + (self.next[file + 1] > 0))

    def walk(self, grams: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """a(h, w) and g(h) of each row's beginnings of 2, 3, ... ids; rows are distinct and in order, -1 is unknown or none but in the first column."""
        n = len(grams[0])
        a, g = [np.zeros(n) for _ in grams[1:]], [np.ones(n) for _ in grams[1:]]
        edges = self.edges(grams[0], grams[1])
        for f in np.flatnonzero((np.diff(edges) > 0) & self.written):
            rows = np.arange(edges[f], edges[f + 1])
            x = map_arrays(self.grams(f))
            context = grams[0][rows] - self.word[f]
            change = np.append(True, context[1:] != context[:-1])
            for j in range(1, len(grams)):
                w = grams[j][rows]
                change |= np.append(True, w[1:] != w[:-1])
                start = np.flatnonzero(change)
                size = np.diff(np.append(start, len(rows)))
                place, a_, g_ = _Level(x[16 * j - 16 : 16 * j]).follow(context[start], w[start])
                a[j - 1][rows], g[j - 1][rows] = np.repeat(a_, size), np.repeat(g_, size)
                # only n-grams that this level has are contexts of the next one
                found = np.repeat(place, size)
                go = found >= 0
                rows, context, change = rows[go], found[go], change[go]
                if not len(rows):
                    break
        if len(self.parted):
            at = np.minimum(np.searchsorted(self.parted, grams[0]), len(self.parted) - 1)
            g[0] = np.where(self.parted[at] == grams[0], self.left[at], g[0])
        return a, g


class _Level:
    """Successors of the level before: pointers from a context to its range, successors, and both kinds of probabilities."""

    def __init__(self, x: list[np.ndarray]):
        self.pointers, self.successors, self.a, self.g = EliasFano.of(x[:4]), EliasFano.of(x[4:8]), Codes(x[8:12]), Codes(x[12:16])

    @staticmethod
    def build(context: np.ndarray, w: np.ndarray, n: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """From n-grams in order and the counts of all contexts; and what each context has left."""
        p = (n - DISCOUNT) / counts[context]
        rest = 1 - np.bincount(context, p, len(counts))
        # a context's ids start from one past the last value of the context before
        first = np.append(True, context[1:] != context[:-1])[: len(context)]
        ends = np.flatnonzero(np.append(first[1:], True)[: len(context)])
        step = np.cumsum(w[ends] + 1)
        start = np.append(0, step)[np.cumsum(first) - 1]
        successors = EliasFano.build((start + w).astype(np.uint64), int(step[-1]) + 1 if len(step) else 1)
        pointers = EliasFano.build(np.append(0, np.cumsum(np.bincount(context, minlength=len(counts)))).astype(np.uint64), len(w) + 1)
        return [*pointers.arrays(), *successors.arrays(), *Codes.build(p), *Codes.build(rest)], rest

    def follow(self, context: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (or -1) and a of each n-gram, and g of its context; ``context`` is in order, ``w`` is -1 for unknown words."""
        place, a = np.full(len(context), -1, dtype=np.int64), np.zeros(len(context))
        # what a context has is looked up once for all words that are asked after it
        first = np.append(True, context[1:] != context[:-1])[: len(context)]
        of, context = np.cumsum(first) - 1, context[first]
        begin, end = (x.astype(np.int64) for x in self.pointers.range(context))
        # running sums start anew, from the last value before it, in each context's range
        start = np.zeros(len(context), dtype=np.uint64)
        # most long contexts have one successor, which is the step from the value before it: no search
        one = np.flatnonzero((end == begin + 1) & (begin > 0))
        only = np.full(len(context), -1, dtype=np.int64)
        before, value = self.successors.range(begin[one] - 1)
        only[one] = (value - before).astype(np.int64) - 1
        hit = np.flatnonzero((only[of] == w) & (w >= 0))
        place[hit] = begin[of[hit]]
        many = (end > begin) & (only < 0)
        late = np.flatnonzero(many & (begin > 0))
        start[late] = self.successors.access(begin[late] - 1) + np.uint64(1)
        some = np.flatnonzero(many[of] & (w >= 0))
        if len(some):
            at, c = self.successors.find(start[of[some]] + w[some].astype(np.uint64)), of[some]
            found = (at >= begin[c]) & (at < end[c])
            place[some[found]] = at[found]
        hit = np.flatnonzero(place >= 0)
        a[hit] = self.a.of(place[hit])
        return place, a, self.g.of(context)[of]


def _train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("held_out")).select("text")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush():
        w, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    for b in batches:
        texts = b.column("text").to_pylist()
        for lo, hi in by_bytes(texts):
            held.append(tokens(texts[lo:hi])[0])
            if sum(map(len, held)) >= COUNT_TOKENS:
                yield flush()
    if held:
        yield flush()


def _write_words(folder: str, bits: int, file_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        segment = table["segment"][0].as_py()
        word, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
        order = np.argsort(word)
        word, n = word[order], n[order]
        big = np.flatnonzero(n >= 255)
        span = 64 - bits
        ef = EliasFano.build(word & np.uint64((1 << span) - 1), 1 << span)
        write_arrays(f"{folder}/words-{segment}", [*ef.arrays(), np.minimum(n, 255).astype(np.uint8), big.astype(np.int64), n[big].astype(np.int64)])
        # a file of n-grams starts at the first word after so many tokens, and at and after words of more
        full = np.flatnonzero(n > file_tokens)
        cuts = np.union1d(np.flatnonzero(np.diff((np.cumsum(n) - n) // file_tokens)) + 1, np.concatenate([full, full + 1]))
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (cuts[(cuts > 0) & (cuts < len(n))], full, -(-n[full] // file_tokens))]
        return pa.table([pa.array([segment], pa.int64()), pa.array([len(word)], pa.int64()), *lists], names=["segment", "n", "cuts", "full", "parts"])

    return run


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers from 0 on, compressed byte plane by byte plane."""
    kind = np.uint32 if all(int(c.max(initial=0)) < 1 << 32 for c in columns) else np.uint64
    planes = np.stack([c.astype(kind) for c in columns]).view(np.uint8).reshape(-1, kind().itemsize)
    blob = np.ascontiguousarray(planes.T).tobytes()
    return np.array([kind().itemsize, len(columns), len(columns[0])], np.int64).tobytes() + pa.Codec("zstd", compression_level=1).compress(blob, asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    """The columns, one a row."""
    size, k, n = np.frombuffer(blob, np.int64, 3).tolist()
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[24:], size * k * n, asbytes=True), np.uint8).reshape(size, k * n)
    return np.ascontiguousarray(planes.T).view(np.uint32 if size == 4 else np.uint64).reshape(k, n).astype(np.int64)


def _starts(texts_of: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens that have another after them in their text, and for each the places of its n-gram's tokens, -1 past the text's end."""
    n = len(texts_of)
    i = np.flatnonzero(texts_of[1:] == texts_of[:-1])
    after = np.append(texts_of, np.full(order, -1))
    return i, [i, i + 1, *(np.where(after[i + k] == texts_of[i], np.minimum(i + k, n - 1), -1) for k in range(2, order))]


def _count_grams(model: Model):
    """Counts of n-grams, packed, with the file they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            h = np.concatenate([x for x, _ in held])
            doc = np.concatenate([np.repeat(np.arange(len(o) - 1), np.diff(o)) + (k << 32) for k, (_, o) in enumerate(held)])
            held.clear()
            at, number, _ = _numbered(h)
            ids = np.append(model.lookup(h[at])[0], -1)
            _, places = _starts(doc, model.order)
            number = np.append(number, -1)
            # words are numbered in the order of their ids
            grams = [number[p] for p in places]
            at, _, n = distinct_rows(grams)
            grams = [ids[g[at]] for g in grams]
            edges = model.edges(grams[0], grams[1])
            files = np.flatnonzero(np.diff(edges))
            blobs = [_packed([grams[0][lo:hi] - model.word[f], *(g[lo:hi] + 1 for g in grams[1:]), n[lo:hi]]) for f, lo, hi in zip(files, edges[files], edges[files + 1], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(blobs, pa.binary())], names=["file", "grams"])

        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in by_bytes(texts):
                held.append(tokens(texts[lo:hi]))
                if sum(len(x) for x, _ in held) >= GRAM_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return run


def _write_grams(model: Model, least: int):
    """Rows (file, grams) sorted by file in; files written, and what each leaves to its first word, out."""

    def write(file: int, blobs: list[bytes]) -> pa.RecordBatch:
        lo, hi = int(model.word[file]), model.last(file)
        segment = int(np.searchsorted(model.base, lo, side="right")) - 1
        words = map_arrays(model.words(segment))
        part = slice(lo - int(model.base[segment]), hi - int(model.base[segment]))
        counts = words[4][part].astype(np.int64)
        big = words[5][np.searchsorted(words[5], part.start) : np.searchsorted(words[5], part.stop)]
        counts[big - part.start] = words[6][np.searchsorted(words[5], big)]
        rows = np.concatenate([_unpacked(x) for x in blobs], axis=1)
        rows[1:-1] -= 1
        at, back, _ = distinct_rows(list(rows[:-1]))
        n, grams = np.bincount(back, rows[-1], len(at)).astype(np.int64), [c[at] for c in rows[:-1]]
        del rows, back
        arrays, left = [], 1.0
        context = grams[0]
        change = np.append(True, context[1:] != context[:-1])
        for j in range(1, model.order):
            w = grams[j]
            change = change | np.append(True, w[1:] != w[:-1])
            start = np.flatnonzero(change)
            times = np.add.reduceat(n, start)
            keep = (w[start] >= 0) & (context[start] >= 0) & (times >= least)
            level, rest = _Level.build(context[start][keep], w[start][keep], times[keep], counts)
            arrays += level
            left = float(rest[0]) if j == 1 else left
            context = np.repeat(np.where(keep, np.cumsum(keep) - 1, -1), np.diff(np.append(start, len(n))))
            counts = times[keep]
        write_arrays(model.grams(file), arrays)
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([left])], names=["file", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = -1
        for b in batches:
            for file, blob in zip(b.column("file").to_pylist(), b.column("grams"), strict=True):
                if file != now and held:
                    yield write(now, held)
                    held = []
                now = file
                held.append(blob.as_py())
        if held:
            yield write(now, held)

    return run


def train(docs: DataFrame, order: int = 2, least: int = LEAST_PAIR) -> Model:
    """The trie of ``docs`` (text, held_out): the rows that are not held out. N-grams of two words or more count from ``least`` times on."""
    spark = docs.sparkSession
    folder = qualified(spark, fresh_path(spark, "trie"))
    n_out = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _train_rows(docs).mapInArrow(_count_words, "word bigint, n bigint")
    vocabulary = materialise(counted.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    distinct, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (distinct // SEGMENT_WORDS).bit_length())
    # hashes are uniform, so their top bits cut the vocabulary into equal files
    segment = F.shiftrightunsigned("word", 64 - bits) if bits else F.lit(0).cast("bigint")
    written = vocabulary.withColumn("segment", segment).groupBy("segment").applyInArrow(_write_words(folder, bits, FILE_TOKENS), "segment bigint, n bigint, cuts array<bigint>, full array<bigint>, parts array<bigint>")
    files = {r.segment: r for r in written.collect()}
    base = np.concatenate([[0], np.cumsum([files[s].n if s in files else 0 for s in range(1 << bits)])]).astype(np.int64)
    cuts = {(int(b), 0) for b in base}
    parted = set()
    for s, r in files.items():
        first = int(base[s])
        cuts |= {(first + c, 0) for c in r.cuts}
        # a word's second words are parted where ids, which are in the order of hashes, are parted evenly
        cuts |= {(first + w, k * distinct // parts) for w, parts in zip(r.full, r.parts, strict=True) for k in range(parts)}
        parted |= {first + w for w in r.full}
    word, after = (np.array(x, dtype=np.int64) for x in zip(*sorted(cuts), strict=True))
    model = Model(folder, bits, total, order, base, word, after, np.zeros(len(word) - 1, dtype=bool), np.array(sorted(parted), dtype=np.int64), np.ones(len(parted)))
    grams = _train_rows(docs).mapInArrow(_count_grams(model), "file bigint, grams binary")
    # a worker has summed its own n-grams already; the one that gets a file's rows adds them up and writes it
    # files are of equal numbers of tokens, so partitions of equal numbers of files are even
    n_files = max(1, len(word) - 1)
    parts = min(n_files, 4 * n_out)
    place = F.floor(F.col("file") * parts / n_files).cast("int")
    grams = grams.repartitionById(parts, place).sortWithinPartitions("file").mapInArrow(_write_grams(model, least), "file bigint, left double")
    for r in grams.collect():
        model.written[r.file] = True
        at = int(np.searchsorted(model.parted, word[r.file]))
        if at < len(model.parted) and model.parted[at] == word[r.file]:
            model.left[at] -= 1 - r.left
    return model


def _score(model: Model):
    def score(texts: list[str | None]) -> tuple[np.ndarray, ...]:
        h, offset = tokens(texts)
        at, number, _ = _numbered(h)
        ids, counts = model.lookup(h[at])
        del h
        one = model.unigram(counts)
        doc = np.repeat(np.arange(len(texts)), np.diff(offset))
        base = np.bincount(doc, np.log10(one)[number], len(texts))
        known = np.bincount(doc, (counts > 0)[number], len(texts)).astype(np.int64)
        p = one[number]
        i, places = _starts(doc, model.order)
        # an unknown first word has no weight to fall back from; an unknown word ends what the trie may have
        some = ids[number[i]] >= 0
        i, places = i[some], [x[some] for x in places]
        if len(i):
            # words are numbered in the order of their ids, if they have any
            word = np.append(np.where(ids >= 0, np.arange(len(ids)), -1)[number], -1)
            grams = [word[x] for x in places]
            at, back, _ = distinct_rows(grams)
            ids = np.append(ids, -1)
            grams = [ids[x[at]] for x in grams]
            a, g = model.walk(grams)
            for k in range(1, model.order):
                there = np.flatnonzero(places[k] >= 0)
                to = places[k][there]
                p[to] = a[k - 1][back[there]] + g[k - 1][back[there]] * p[to]
        return np.diff(offset), known, base, np.bincount(doc, np.log10(p), len(texts))

    def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = [x for b in held for x in b.column("text").to_pylist()]
        ids, held_out = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in ("id", "held_out"))
        held.clear()
        out = [score(texts[lo:hi]) for lo, hi in by_bytes(texts, SCORE_CHARS)]
        n, known, base, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([ids, held_out, pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), model.total, dtype=np.int64)), pa.array(base), pa.array(scores)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each call visits every file of the trie, and its n-grams are looked up once: batches go together
        held: list[pa.RecordBatch] = []
        for b in batches:
            if held and sum(x.nbytes for x in held) + b.nbytes > SCORE_CHARS:
                yield scored(held)
            if b.num_rows:
                held.append(b)
        if held:
            yield scored(held)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, order: int = 2, least: int = LEAST_PAIR) -> DataFrame:
    """Every row with held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words of a text (A-Z in lower case, between blanks) and one end;
    a null text is empty and has only the end. Rows whose crc32 of the id as text
    leaves ``held_fold`` by ``folds`` are held out; a null id is the text ''. Both
    scores are log10 probabilities: base_score of the smoothed unigram model, score
    of the trie's. Repeated rows are counted and scored each by itself. ``order`` is 2 or more; n-grams of two words
    and more seen less than ``least`` times are left out, and none for 1. If nothing
    is left to train on, both scores are those of an empty vocabulary. An empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = columns_as(docs, id=id_col, text=text_col)
    rows = rows.withColumn("held_out", F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % folds == held_fold)
    model = train(rows, order, least)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.mapInArrow(_score(model), schema).withColumnRenamed("id", id_col)
