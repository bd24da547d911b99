"""Links per document, candidate groups and cells of the Jaccard join against plain versions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import jaccard_join as jj

from . import brute
from .test_operators import ROWS, by_id, docs  # noqa: F401


def plain_links(rows):
    """doc_id -> number of other documents it links with."""
    sets = {d: brute.shingle_set(t) for d, t in rows}
    out = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            out[a] += 1
            out[b] += 1
    return out


def near_copies(n, seed, words=90, most=9):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(500)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = [*base]
        for _ in range(rng.randrange(most)):
            w[rng.randrange(words)] = f"v{rng.randrange(500)}"
        rows.append((i, " ".join(w)))
    return rows


def check(spark, rows):
    got = by_id(jj.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)), "n_shingles", "component_id", "n_links")
    classes, links = brute.classes(rows), plain_links(rows)
    assert got == {d: (*classes[d], links[d]) for d, _ in rows}


def test_links_of_the_corpus(spark, docs):  # noqa: F811
    got = by_id(jj.jaccard_classes(docs), "n_links")
    assert got == {d: (n,) for d, n in plain_links([(r[0], r[1]) for r in ROWS]).items()}


@pytest.mark.parametrize("square", [512, 8])
def test_near_copies_and_passages(spark, monkeypatch, square):
    """Two families of near copies, exact copies of their members, and texts that share a long passage without a link; small squares split all of them."""
    monkeypatch.setattr(jj, "SQUARE", square)
    monkeypatch.setattr(jj, "SQUARE_SHINGLES", 3000 if square == 8 else jj.SQUARE_SHINGLES)
    rng = random.Random(8)
    rows = near_copies(70, 1) + [(100 + i, t) for i, t in near_copies(40, 2, words=300, most=40)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(20)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(300 + i, f"{' '.join(rng.choices('abcdefgh', k=30))} {passage} {' '.join(f'q{rng.randrange(900)}' for _ in range(30))}") for i in range(50)]
    check(spark, rows)


def test_chain_of_changes(spark):
    """Each text links with its neighbours only, so a class is a chain; ids are shuffled."""
    rng = random.Random(3)
    words = [f"u{i}" for i in range(60)]
    chain = []
    for i in range(40):
        words = [*words]
        words[(7 * i) % 60] = f"x{i}"
        chain.append(" ".join(words))
    ids = rng.sample(range(1000), 40)
    check(spark, list(zip(ids, chain, strict=True)))


def test_rows_grow_with_members_not_their_pairs(spark):
    """Twice the near copies, many shared blocks each: the cells of homes and of the rest have about twice the rows."""
    made = []
    real = jj.materialise

    def counted(df, tag, wide=False):
        out = real(df, tag, wide)
        if tag == "squares":
            made.append(out.count())
        return out

    jj.materialise = counted
    try:
        sizes = []
        for n in (150, 300):
            made.clear()
            jj.jaccard_classes(spark.createDataFrame(near_copies(n, 5, most=5), "doc_id bigint, text string")).count()
            sizes.append(sum(made))
    finally:
        jj.materialise = real
    assert sizes[1] <= 2.5 * sizes[0]


@pytest.mark.parametrize("held", [1 << 22, 40])
@pytest.mark.parametrize("seed", range(3))
def test_shared_keys(seed, held, monkeypatch):
    """Members of shared keys by buckets, copies given once or again, whether or not a bucket is held whole."""
    monkeypatch.setattr(jj, "HELD_KEYS", held)
    rng = np.random.default_rng(seed)
    keys = {d: np.unique(rng.integers(-(2**63), 2**63 - 1, 200)[rng.integers(0, 200, 12)] if d % 3 else rng.integers(0, 40, 12) << 55) for d in range(60)}
    monkeypatch.setattr(jj, "shingle_sets", lambda texts: iter([np.array([int(t)], dtype=np.uint64) for t in texts]))
    monkeypatch.setattr(jj, "digest_of", lambda s: (int(s[0]) * 7, int(s[0]) % 5))
    monkeypatch.setattr(jj, "block_keys", lambda s: keys[int(s[0])])
    texts = [str(int(d)) for d in rng.integers(0, 60, 150)]
    parts = [pa.RecordBatch.from_pydict({"text": texts[k : k + 40]}) for k in range(0, 150, 40)]
    sent = [r for half in (parts[:2], parts[2:]) for b in jj._keys(7)(iter(half)) for r in b.to_pylist()]
    sent.sort(key=lambda r: r["bucket"])
    schema = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])
    got = [r for b in jj._shared(pa.RecordBatch.from_pylist([r], schema=schema) for r in sent) for r in b.to_pylist()]
    owners = {}
    for d in {int(t) for t in texts}:
        for k in keys[d].tolist():
            owners.setdefault(k, set()).add((d * 7, d % 5))
    want = {(k, *o) for k, v in owners.items() if len(v) > 1 for o in v}
    assert {(r["key"], r["digest"], r["more"]) for r in got} == want
    if held > 1000:
        assert len(got) == len(want) and all(r["size"] == len(owners[r["key"]]) for r in got)


def test_tables_of_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = jj.common_shingles(sets)
    off = ~np.eye(30, dtype=bool)
    assert (got[off] == want[off]).all()
    assert (jj.common_shingles(sets[:10], sets[10:]) == want[:10, 10:]).all()


def test_distances_of_sketches():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (3, 20, 70, 200, 900, 900)]
    sketches = [np.frombuffer(jj.bit_sketch(s), np.uint8) for s in sets]
    size = np.array([len(x) for x in sketches])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    i, j = np.triu_indices(6, 1)
    far = jj.fold_distance(i, j, size, start, np.concatenate(sketches))
    for a, b, d in zip(i, j, far, strict=True):
        small = min(size[a], size[b])
        assert d == np.bitwise_count(jj._fold(sketches[a], small) ^ jj._fold(sketches[b], small)).sum()
        assert d <= len(np.setxor1d(sets[a], sets[b]))
