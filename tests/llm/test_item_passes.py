"""Similarity with benchmark items does not depend on how many passes search them."""

from driftline.llm import decontamination


def test_one_pass_or_many(spark, monkeypatch):
    template = " ".join(f"common{i}" for i in range(12))
    items = [(k, f"{template} " + " ".join(f"item{k}word{i}" for i in range(24))) for k in range(6)]
    # the first words, all of the template, are others
    docs = spark.createDataFrame([(k, t.replace("common3", "other")) for k, t in items] + [(9, "")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")

    def found():
        rows = decontamination.find_leaks(docs, benchmark, threshold=0.5).collect()
        return {r.document.doc_id: sorted((x.item, round(x.similarity, 9)) for x in r.leaks) for r in rows}

    one = found()
    assert sum(map(len, one.values())) >= 6
    monkeypatch.setattr(decontamination, "ITEMS_A_PASS", 1)
    assert found() == one
