"""Every stage of the pipeline against a plain version on its own input; whole runs over odd tables."""

import random

import pytest

import corpus_pipeline
from driftline.llm.workspace import materialise

from . import brute
from .test_operators import ITEMS, ROWS, SCHEMA

LABELS = [(r[0], int(r[0] % 4 > 0), int(r[0] % 29 == 0)) for r in ROWS[:150]]


def written(spark, folder, rows, labels=LABELS, items=ITEMS):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_stage(spark, tmp_path):
    sf = written(spark, tmp_path, ROWS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = materialise(stage(spark, docs, sf), name, wide=True)
        ids = sorted(r.doc_id for r in after.select("doc_id").collect())
        if name == "quality":
            assert 0 < len(ids) < len(before) and set(ids) < {d for d, _ in before}
        if name == "near_duplicates":
            assert ids == sorted(d for d, (_, c) in brute.classes(before).items() if c == d)
        if name == "decontamination":
            assert ids == sorted(d for d, hit in brute.leaks(before, ITEMS).items() if not hit)
        if name == "mixing":
            assert set(ids) == {d for d, _ in before} and max(ids.count(d) for d in set(ids)) <= 2
        if name == "sharding":
            assert ids == sorted(d for d, _ in before)
            rows = after.collect()
            assert {(r.doc_id, r.text) for r in rows} == set(before)
            assert {r.shard for r in rows} <= set(range(40)) and all(r["size"] == len((r.text or "").encode()) + 16 for r in rows)
        else:
            assert after.columns == columns
        docs = after


ODD = [(None, None, None, None, None), (1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (1, "another text for that id", None, "s", None), (None, "a b c d e f g", None, "t", None), (2, "", "en", None, 0), (3, "word " * 30_000, None, "t", 6000), (4, "x\n\n\ny z", "en", "t", 3)]


@pytest.mark.parametrize("kind", ["empty", "odd", "no labels", "hot"])
def test_runs(spark, tmp_path, kind):
    rng = random.Random(5)
    rows, labels, items = {"empty": ([], LABELS, ITEMS), "odd": (ODD, [(1, 1, 0), (3, 0, 1), (None, 1, 0), (4, None, None)], []), "no labels": (ROWS, [], []), "hot": ([], LABELS, ITEMS)}[kind]
    if kind == "hot":
        # two thirds of the rows are one text of one source
        rows = [(i, "the very same text that all of these rows have in common" if i % 3 else " ".join(f"w{rng.randrange(400)}" for _ in range(60)), "en", "hot" if i % 3 else f"s{i % 5}", 50) for i in range(900)]
        labels = [(i, 1, 0) for i in range(0, 900, 7)]
    out = corpus_pipeline.run(spark, written(spark, tmp_path, rows, labels, items)).collect()
    ids = {r.doc_id for r in out}
    assert ids <= {r[0] for r in rows}
    for _, g in __import__("itertools").groupby(sorted(out, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        slots = [r.slot for r in g]
        assert slots == list(range(len(slots)))
    if kind == "empty":
        assert out == []
    if kind == "hot":
        assert sum(d % 3 > 0 for d in ids) == 1 and sum(d % 3 == 0 for d in ids) == 300
