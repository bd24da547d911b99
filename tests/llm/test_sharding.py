"""Sharding against plain placement, and its law, groups and slots on awkward tables."""

import zlib

import numpy as np
import pytest

from driftline.llm import sharding
from driftline.llm.queries import op3_sharding

from ..test_catalog import SF
from .brute import WORD
from .test_operators import ROWS, docs  # noqa: F401


def placed(df, n):
    """Rows in pandas after the checks that hold for any table."""
    p = df.toPandas()
    assert set(p["shard"]) <= set(range(n))
    for _, g in p.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    p["digest"] = p["digest"].map(bytes)
    return p


def loads(p, n, column):
    return p.groupby("shard")[column].sum().reindex(range(n), fill_value=0)


def whole(p, n):
    """Groups of equal texts within a shard's mean of bytes and rows lie in one shard."""
    g = p.groupby("digest").agg(shards=("shard", "nunique"), rows=("shard", "size"), size=("size", "sum"))
    small = (g["rows"] <= len(p) / n) & (g["size"] <= p["size"].sum() / n)
    return (g["shards"][small] == 1).all()


def plain_pack(vectors, n):
    """One vector after another, by comparing the dot products of all shards."""
    left = [[1.0, 1.0, 1.0] for _ in range(n)]
    out = []
    for v in vectors:
        fit = [sum(a * b * w for a, b, w in zip(v, r, sharding.WEIGHTS, strict=True)) for r in left]
        s = max(range(n), key=lambda i: (round(fit[i], 12), -i))
        out.append(s)
        left[s] = [a - b for a, b in zip(left[s], v, strict=True)]
    return out


def test_pack_is_plain_placement():
    rng = np.random.default_rng(4)
    v = rng.exponential(1, (300, 3))
    v = v[np.argsort(-v[:, 0])] / v.sum(axis=0) * 7
    got = sharding.pack(v, np.ones((7, 3)))
    assert got.tolist() == plain_pack(v.tolist(), 7)
    load = np.stack([np.bincount(got, v[:, d], 7) for d in range(3)])
    assert load.max() < 1.05 and load.min() > 0.95


def test_shards(docs):  # noqa: F811
    p = placed(sharding.assign_shards(docs, 5), 5)
    assert sorted(p["doc_id"]) == sorted(r[0] for r in ROWS)
    text = {r[0]: r[1] or "" for r in ROWS}
    for d, n, c in zip(p["doc_id"], p["size"], p["text_crc32"], strict=True):
        assert (n, c) == (len(text[d].encode()) + 16, zlib.crc32(text[d].encode()))
    assert whole(p, 5)
    # the one very long text is more than a shard's share; the others share the rest evenly
    load = loads(p, 5, "size").sort_values().iloc[:-1]
    assert load.max() <= 1.2 * load.min()


def test_query_is_joint_and_keeps_groups(spark):
    """On a table ten times the smallest: no group torn, bytes, words and rows near equal."""
    sf = SF.replace("0.001", "0.01")
    p = placed(op3_sharding(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").withColumnRenamed("text", "digest").selectExpr("*", "unhex(md5(coalesce(digest, ''))) AS d").drop("digest").withColumnRenamed("d", "digest"), 40)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    p["words"] = [len(WORD.findall(texts[d] or "")) for d in p["doc_id"]]
    assert (p.groupby("digest")["shard"].nunique() == 1).all()
    for column, most in (("size", 0.05), ("words", 0.15)):
        load = loads(p, 40, column)
        assert abs(load / load.mean() - 1).max() < most
    rows = p.groupby("shard").size()
    assert abs(rows / rows.mean() - 1).max() < 0.1


@pytest.mark.parametrize("null_ids", [False, True])
@pytest.mark.parametrize("share", [50, 90, 100])
def test_hot_group_is_split_evenly(spark, share, null_ids):
    key = "CAST(NULL AS BIGINT)" if null_ids else "id"
    d = spark.range(4000).selectExpr(f"{key} AS doc_id", f"IF(id % 100 < {share}, 'the same text', concat('text ', id)) AS text").repartition(3)
    p = placed(sharding.assign_shards(d, 8), 8)
    load = loads(p, 8, "size")
    assert len(p) == 4000 and load.max() <= 1.02 * load.mean() and load.min() >= 0.98 * load.mean()


def test_levels_and_blocks(spark, monkeypatch):
    """Few groups a block and narrow levels: what one level leaves uneven, the next evens out."""
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 50)
    monkeypatch.setattr(sharding, "LEVEL_BITS", 4)
    d = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), CAST(1 + 2000 / (1 + id) AS INT)) AS text").repartition(3)
    load = loads(placed(sharding.assign_shards(d, 6), 6), 6, "size")
    assert load.max() <= 1.06 * load.min()


def test_carried_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", "z")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    out = sharding.assign_shards(d, 2, carry=True).select("doc_id", "shard", "document.*")
    assert sorted(((r[2], r[3], r[4]) for r in out.collect()), key=repr) == sorted(rows, key=repr)
    assert sharding.assign_shards(d.limit(0), 2, carry=True).collect() == []
