"""Pairs of vectors by matrices are those that sums in order give."""

import math

import numpy as np

from driftline.operators import similarity


def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), [float(x) for x in rng.normal(0, 1, 6)]) for i in range(120)]
    rows += [(200, 0, [0.0] * 6), (201, 0, None), (202, None, [1.0] * 6), (203, 1, [1e-200] * 6), (204, 1, [1e-200] * 5 + [2e-200]), (205, 2, [1.0, 2.0]), (206, 2, [2.0, 4.0]), (207, 2, [1.0, None]), (208, 2, []), (209, 0, [1e120] * 6), (210, 0, [1e120] * 5 + [9e119])]
    return rows, spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def brute(rows, least):
    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s = s + x * y
        return s

    out = {}
    for i, p, v in rows:
        for j, q, w in rows:
            if i < j and p == q and p is not None and v and w and len(v) == len(w) and None not in v + w:
                n = math.sqrt(dot(v, v)) * math.sqrt(dot(w, w))
                if n and dot(v, w) / n >= least:
                    out[i, j] = dot(v, w) / n
    return out


def test_as_sums_in_order(spark, monkeypatch):
    rows, df = vectors(spark)
    want = brute(rows, 0.3)
    for part, strip in ((2048, 512), (16, 3)):
        monkeypatch.setattr(similarity, "PART", part)
        monkeypatch.setattr(similarity, "STRIP", strip)
        found = [((r.a, r.b), r.cosine) for r in similarity.cosine_pairs(df, "label", 0.3).collect()]
        assert len(found) == len(want) and dict(found) == want


def test_no_pair_but_a_near_one_is_a_row(spark):
    """Every pair of a block was a row of a join, and its vectors were summed one by one."""
    _, df = vectors(spark)
    pairs = similarity.cosine_pairs(df, "label", 0.3)
    for found in (pairs, similarity.nearest(pairs), similarity.mutual_unique(pairs)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 1


def test_nearest_and_mutual(spark):
    pairs = spark.createDataFrame([(0, 1, 2, 0.5), (0, 1, 3, 0.5), (0, 4, 5, 0.9), (1, 6, 7, 0.4), (1, 7, 8, 0.6)], "block int, a long, b long, cosine double")
    assert {r.id: (r.partner, r.cosine) for r in similarity.nearest(pairs).collect()} == {1: (2, 0.5), 2: (1, 0.5), 3: (1, 0.5), 4: (5, 0.9), 5: (4, 0.9), 6: (7, 0.4), 7: (8, 0.6), 8: (7, 0.6)}
    assert [tuple(r[c] for c in ("block", "a", "b", "cosine")) for r in similarity.mutual_unique(pairs).collect()] == [(0, 4, 5, 0.9)]


def test_no_vectors(spark):
    assert similarity.cosine_pairs(vectors(spark)[1].where("vec_id < 0"), "label", 0.3).count() == 0


def test_best_and_only_pairs_by_groups(spark, monkeypatch):
    _, df = vectors(spark)
    for part in (2048, 16):
        monkeypatch.setattr(similarity, "PART", part)
        for least in (0.3, 0.5, 0.97):
            pairs = similarity.cosine_pairs(df, "label", least)
            for got, want in ((similarity.nearest_pairs(df, "label", least), similarity.nearest(pairs)), (similarity.mutual_unique_pairs(df, "label", least), similarity.mutual_unique(pairs))):
                assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_groups_send_a_row_for_a_vector():
    """All pairs of a group went on to be ranked or counted: their number grows with the square of a label."""
    import pyarrow as pa

    n = 300
    group = pa.table({"id": np.arange(n), "block": np.zeros(n, int), "v": [[1.0, 2.0]] * n, "size": np.full(n, 2), "part": np.zeros(n, int), "i": np.zeros(n, int), "j": np.zeros(n, int)})
    best, some = similarity._nearest_in_tile(0.3)(group), similarity._only_in_tile(0.3)(group)
    assert best["id"].to_pylist() == list(range(n)) and best["partner"].to_pylist() == [1] + [0] * (n - 1)
    assert some["__n"].to_pylist() == [n - 1] * n
