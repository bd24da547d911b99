"""The digest cache: stored counts are met, only distinct misses are encoded, and new ones are appended."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftline.llm import token_counts
from driftline.llm.queries import op1_token_counts

from ..test_catalog import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoded(monkeypatch, counts):
    """Notes how many texts each append encodes."""
    append = token_counts.DigestCache.append

    def noted(self, tokenizer, rows):
        append(self, tokenizer, rows)
        counts.append(self.spark.read.parquet(self.path).count() - sum(counts))

    monkeypatch.setattr(token_counts.DigestCache, "append", noted)


def test_query_meets_its_durable_cache(spark, tmp_path, monkeypatch):
    counts = []
    encoded(monkeypatch, counts)
    spark.conf.set("spark.driftline.tokenCache", str(tmp_path / "cache"))
    try:
        first = sorted(op1_token_counts(spark, SF).collect())
        second = sorted(op1_token_counts(spark, SF).collect())
    finally:
        spark.conf.unset("spark.driftline.tokenCache")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    # one append, of every distinct text; the second run encodes nothing
    assert counts == [len(set(texts.values()))]
    assert first == second
    t = Tokenizer.from_file(PATH)
    assert {r.doc_id: r.n_tokens for r in first} == {d: len(t.encode(x, add_special_tokens=False)) for d, x in texts.items()}


@pytest.mark.parametrize("few", [0, 100])
def test_only_misses_are_encoded(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW_MISSES", few)
    counts = []
    encoded(monkeypatch, counts)
    cache = token_counts.DigestCache(spark, str(tmp_path / "cache"))
    t = Tokenizer.from_file(PATH)

    def run(texts, path=PATH):
        rows = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), path, cache).collect()
        return [r.n_tokens for r in sorted(rows)]

    one = ["a b", None, "", "a b", "c " * 5000]
    two = [*one, "new", "new", "ünï"]
    assert run(one) == [len(t.encode(x or "", add_special_tokens=False)) for x in one]
    assert run(two) == [len(t.encode(x or "", add_special_tokens=False)) for x in two]
    assert run([]) == []
    assert counts == [3, 2]
    # another vocabulary has counts of its own
    assert len(run(["a b"], public_tokenizers.path("piece_bpe_32k.model"))) == 1
    assert counts == [3, 2, 1]
