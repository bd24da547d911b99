"""Tries of three levels and more against plain counting."""

import collections
import math
import zlib

import numpy as np
import pytest

from driftline.llm import lm_scoring
from driftline.llm.queries import op8_lm_scoring

from ..test_catalog import SF
from . import brute
from .test_operators import ROWS, by_id, docs  # noqa: F401


def plain(rows, least, order=3):
    """doc_id -> score of the model of n-grams of up to ``order`` words seen ``least`` times or more."""
    tokens = {d: [*brute.WORD.findall(brute.lower(t)), None] for d, t in rows}
    c = collections.Counter()
    for d, w in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    rest = collections.defaultdict(lambda: 1.0)
    for g, x in c.items():
        if len(g) > 1 and x >= least:
            rest[g[:-1]] -= (x - 0.75) / c[g[:-1]]

    def p(g):
        if len(g) == 1:
            return (c[g] + 0.5) / (n + 0.5 * (v + 1))
        return ((c[g] - 0.75) / c[g[:-1]] if c[g] >= least else 0.0) + rest.get(g[:-1], 1.0) * p(g[1:])

    return {d: sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w))) for d, w in tokens.items()}


@pytest.mark.parametrize(("order", "least", "small"), [(3, 2, False), (3, 2, True), (3, 1, True), (2, 1, True), (4, 1, True), (5, 2, True)])
def test_orders(docs, monkeypatch, order, least, small):  # noqa: F811
    """Small files part the n-grams of frequent words."""
    if small:
        monkeypatch.setattr(lm_scoring, "SEGMENT_WORDS", 20)
        monkeypatch.setattr(lm_scoring, "FILE_TOKENS", 50)
    got = by_id(lm_scoring.score_documents(docs, order=order, least=least), "score", "n_tokens")
    want = plain([(r[0], r[1]) for r in ROWS], least, order)
    for d, s in want.items():
        assert abs(got[d][0] - s) <= 2e-3 * got[d][1]


def test_query_counts_every_ngram(spark):
    got = by_id(op8_lm_scoring(spark, SF), "score", "n_tokens")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for d, s in plain(rows, 1, 4).items():
        assert abs(got[d][0] - s) <= 2e-3 * got[d][1]


def test_scoring_visits_files_once_for_several_batches(spark, monkeypatch):
    """Every batch of texts visited every file of the trie by itself."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 30) % 50) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i % 5 == 1) for i, t in enumerate(texts)], "id long, text string, held_out boolean")
    model = lm_scoring.train(docs, 4, 1)
    batches = [pa.RecordBatch.from_pydict({"id": [i], "text": [t], "held_out": [i % 5 == 1]}) for i, t in enumerate(texts)]
    calls, walk = [], lm_scoring.Model.walk
    monkeypatch.setattr(lm_scoring.Model, "walk", lambda self, grams: calls.append(1) or walk(self, grams))
    together = [x for b in lm_scoring._score(model)(iter(batches)) for x in b.to_pylist()]
    assert len(calls) == 1
    alone = [x for t in batches for b in lm_scoring._score(model)(iter([t])) for x in b.to_pylist()]
    assert together == alone and [x["id"] for x in together] == list(range(60))


def test_followers_as_listed():
    """Contexts of none, one and many successors, the first one's range at the start; unknown words; repeated contexts."""
    rng = np.random.default_rng(6)
    for first in ([], [4], [2, 5, 9]):
        lists = [first, *[sorted(rng.choice(40, k, replace=False).tolist()) for k in (0, 1, 1, 7, 0, 30, 1)]]
        pairs = np.array([(c, w) for c, ws in enumerate(lists) for w in ws])
        times = rng.integers(1, 5, len(pairs))
        counts = np.bincount(pairs[:, 0], times, len(lists)).astype(np.int64) + 1
        arrays, rest = lm_scoring._Level.build(pairs[:, 0], pairs[:, 1], times, counts)
        c, w = (x.ravel() for x in np.meshgrid(np.arange(len(lists)), np.arange(-1, 42), indexing="ij"))
        place, a, g = lm_scoring._Level(arrays).follow(c, w)
        index = {(x, y): k for k, (x, y) in enumerate(pairs.tolist())}
        assert place.tolist() == [index.get(k, -1) for k in zip(c.tolist(), w.tolist())]
        want = np.where(place >= 0, ((times - lm_scoring.DISCOUNT) / counts[pairs[:, 0]])[place], 0)
        assert np.allclose(a, want, rtol=2e-3) and np.allclose(g, rest[c], rtol=2e-3)
