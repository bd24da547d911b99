"""Operators against plain versions, on a small made-up corpus with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm import boosting, decontamination, elias_fano, jaccard_join, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, sharding, token_counts, warc
from driftline.llm.docstats import statistics
from driftline.llm.words import LOOSE, SPACE, Words

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made(seed=7, n=120):
    """Documents with exact and near copies, shared passages, nulls, blanks, repeats and one very long text."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Ünder", "ÉTÉ", "naïve", "日本"]
    say = lambda k: " ".join(rng.choices(vocab, k=k))
    passage = say(60)
    docs = []
    for i in range(n):
        docs.append((i, f"{say(rng.randint(3, 150))}\n{say(12)}", "en", f"s{i % 6}"))
    base = docs[5][1].split()
    for i in range(n, n + 12):  # near copies: chains of one-word changes
        base = [*base]
        base[rng.randrange(len(base))] = rng.choice(vocab)
        docs.append((i, " ".join(base), "en", "hot"))
    for i in range(n + 12, n + 40):  # exact copies
        docs.append((i, docs[8][1], "en", "hot"))
    for i in range(n + 40, n + 60):  # a shared passage in different texts
        docs.append((i, f"{say(rng.randint(5, 60))} {passage} {say(rng.randint(5, 60))}", "de", "hot"))
    odd = [None, "", "   \n\t ", "one", "two words", "A B C D", "a b c d", "\n\n\n", say(6000), "<|endoftext|> x", "same line\nsame line\nother"]
    docs += [(n + 60 + k, t, None if k % 2 else "en", None if k % 3 == 0 else "s1") for k, t in enumerate(odd)]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in docs]


ROWS = made()
ITEMS = [(0, " ".join(ROWS[10][1].split()[:30])), (1, "short item"), (2, None), (3, ""), (4, " ".join(ROWS[20][1].split()[:40]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], int(r[0] % 4 > 0), 0) for r in ROWS[:150]], "doc_id bigint, quality int, toxic int")


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_words_match_regular_expression():
    texts = [r[1] for r in ROWS]
    for sep, pattern, low in ((SPACE, brute.WORD, False), (LOOSE, brute.LOOSE, True)):
        w = Words(texts, sep, lower=low)
        for d, t in enumerate(texts):
            want = pattern.findall(brute.lower(t) if low else t or "")
            got = [bytes(w.raw[a:b]) for a, b in zip(w.start[w.offset[d] : w.offset[d + 1]], w.end[w.offset[d] : w.offset[d + 1]], strict=True)]
            assert [brute.lower(x.decode()) for x in got] == [brute.lower(x) for x in want]
    seen = {}
    w = Words(texts, SPACE, lower=True)
    for h, a, b in zip(w.hash, w.start, w.end, strict=True):
        assert seen.setdefault(int(h), brute.lower(bytes(w.raw[a:b]).decode())) == brute.lower(bytes(w.raw[a:b]).decode())


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    cache = token_counts.DigestCache(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/../cache-{random.random()}".replace("file:", "/tmp/pytest-cache-"))
    got = by_id(token_counts.count_tokens(docs, path, cache, limit=50), "n_bytes", "n_tokens", "over_limit")
    for d, text, *_ in ROWS:
        n = len(t.encode(text or "", add_special_tokens=False))
        assert got[d] == (len((text or "").encode()), n, n > 50)
    size = spark.read.parquet(cache.path).count()
    assert size == len({r[1] or "" for r in ROWS})
    more = spark.createDataFrame([(1, "quite new"), (2, ROWS[0][1])], "doc_id bigint, text string")
    assert token_counts.count_tokens(more, path, cache).count() == 2
    assert spark.read.parquet(cache.path).count() == size + 1


def test_token_counts_of_sentencepiece(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.count_tokens(docs, path), "n_tokens")
    assert got == {r[0]: (len(model.encode(r[1] or "")),) for r in ROWS}


def test_lines(docs):
    got = by_id(line_dedup.drop_boilerplate(docs, 2), "n_lines", "n_removed", "text")
    sites = {}
    for _, t, _, s, _ in ROWS:
        for line in (t or "").split("\n"):
            if s is not None and line.strip(" \t\r"):
                sites.setdefault(line.strip(" \t\r"), set()).add(s)
    for d, t, *_ in ROWS:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if len(sites.get(x.strip(" \t\r"), ())) < 2]
        assert got[d] == (len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept))


def test_decontamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r.document.doc_id: {x.item for x in r.leaks} for r in decontamination.find_leaks(docs, items).collect()}
    assert got == brute.leaks([(r[0], r[1]) for r in ROWS], ITEMS)
    assert got[10] == {0} and got[20] == {4}


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 1 << 62, (40, 20)).astype(np.uint64)
    index = decontamination.Index(decontamination.Items("k", tuple(range(40)), tuple(w.tobytes() for w in words)))
    prints = np.repeat(index.prints, 5, axis=0)
    for row in prints:
        for bit in rng.choice(128, int(rng.integers(0, 45)), replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    far = np.bitwise_count(prints[:, None, :] ^ index.prints[None]).sum(axis=2)
    want = {tuple(p) for p in np.argwhere(far <= decontamination.RADIUS)}
    w, i = index.near(prints, np.full(len(prints), 20))
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want


def test_classifier(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad, toxic = i % 5 == 0, i % 7 == 0
        words = [f"c{rng.randrange(200)}" for _ in range(60)]
        if toxic:
            words[rng.randrange(60)] = rng.choice(["vile", "foul"])
            words[rng.randrange(60)] = rng.choice(["vile", "foul"])
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "en", f"s{i % 9}", 0))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels[:500], "doc_id bigint, quality int, toxic int")
    got = {r.document.doc_id: r.kept for r in quality_classifier.classify(docs, known).collect()}
    right = [got[i] == bool(q and not t) for i, q, t in labels[500:]]
    assert np.mean(right) > 0.97


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 400 + [("low", "p", 0.1)] * 400 + [("one", "p", 0.1)]
    post, mean = quality_classifier.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    p = {r.host: r.path_quality for r in post.collect()}
    assert p["big"] > 0.88 and p["low"] < 0.12 and p["low"] < p["one"] < mean + 0.01


def test_jaccard(docs):
    got = by_id(jaccard_join.jaccard_classes(docs), "n_shingles", "component_id")
    assert got == brute.classes([(r[0], r[1]) for r in ROWS])


def test_jaccard_with_larger_groups(spark):
    """Many near copies of one text, so groups are compared in cells."""
    rng = random.Random(3)
    base = [f"v{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(60):
        w = [*base]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(90)] = f"v{rng.randrange(500)}"
        rows.append((i, " ".join(w)))
    got = by_id(jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string")), "n_shingles", "component_id")
    assert got == brute.classes(rows)


@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=300), st.integers(0, 40), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_sketches_bound_the_difference(values, drop, add):
    s = np.unique(np.array(values, dtype=np.uint64))
    t = np.unique(np.concatenate([s[drop % len(s) :], np.arange(add, dtype=np.uint64) + np.uint64(2**63 + 7)]))
    if not len(t):
        return
    a, b = (np.frombuffer(jaccard_join.bit_sketch(x), np.uint8) for x in (s, t))
    size = min(len(a), len(b))
    far = int(np.bitwise_count(jaccard_join._fold(a, size) ^ jaccard_join._fold(b, size)).sum())
    delta = len(np.setxor1d(s, t))
    assert far <= delta and (delta - far) % 2 == 0


@pytest.mark.parametrize("n", [3, 4, 8, 20, 50, 64, 100, 200, 300, 700, 1500])
def test_linked_sets_share_a_key(n):
    from driftline.llm.words import mix

    rng = np.random.default_rng(n)
    for _ in range(150):
        s = np.unique(mix(rng.integers(0, 2**62, n).astype(np.uint64)))
        gone, new = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 3 + 1))
        t = np.unique(np.concatenate([rng.permutation(s)[gone:], mix(rng.integers(0, 2**62, new).astype(np.uint64))]))
        if 4 * len(np.intersect1d(s, t)) >= 3 * len(np.union1d(s, t)):
            assert len(np.intersect1d(jaccard_join.block_keys(s), jaccard_join.block_keys(t)))


def test_keep_one(spark, docs):
    want = {d for d, (_, c) in brute.classes([(r[0], r[1]) for r in ROWS]).items() if d == c}
    twice = docs.unionByName(docs.where("doc_id = 3"))
    kept = jaccard_join.keep_one(twice)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@given(st.lists(st.lists(st.integers(0, 50), max_size=12).map(sorted), max_size=9))
@settings(max_examples=80, deadline=None)
def test_loser_tree(runs):
    got = [runs[r][i] for r, i in warc.LoserTree(runs)]
    assert got == sorted(x for r in runs for x in r)


def test_archives(spark, tmp_path):
    rows = [(1, "http://B.example.com/x?q#f", "a" * 1200), (2, "https://a.example.com", "a" * 1200), (3, None, None), (4, "odd", "é\r\n\r\nWARC/1.1\r\n\r\n" * 60), (5, "http://a.example.com/", "b" * 10), (6, "http://a.example.com/", "b" * 10), (7, "http://x.org/1", "é\r\n\r\nWARC/1.1\r\n\r\n" * 60), (None, "http://n.org", "a" * 1200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    path = str(tmp_path / "archives")
    got = {r.page_id: r for r in warc.archive_and_index(pages, path).collect()}
    for i, url, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None] if len(data) >= 1000 else []
        keeper = max(same, default=None)
        revisit = keeper is not None and i != keeper
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None)
    order = sorted(got.values(), key=lambda r: r.capture_rank)
    assert [r.capture_rank for r in order] == list(range(len(rows)))
    keys = [(r.url_key, r.time) for r in order]
    assert keys == sorted(keys)
    assert got[1].url_key == "com,example,b)/x?q" and got[2].url_key == "com,example,a)/"


def test_broken_archive():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_lm(docs):
    got = by_id(lm_scoring.score_documents(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for d, want in brute.lm([(r[0], r[1]) for r in ROWS]).items():
        assert got[d][:4] == want[:4]
        assert got[d][4] == pytest.approx(want[4], rel=1e-9)
        assert abs(got[d][5] - want[5]) <= 1e-3 * want[1]


@given(st.lists(st.integers(0, 2**40), max_size=400), st.integers(0, 2**40))
@settings(max_examples=80, deadline=None)
def test_elias_fano(values, probe):
    v = np.sort(np.array(values, dtype=np.uint64))
    ef = elias_fano.EliasFano.build(v, 2**40 + 1)
    if len(v):
        assert (ef.access(np.arange(len(v))) == v).all()
    at = ef.successor(np.array([probe], dtype=np.uint64))[0]
    assert at == np.searchsorted(v, probe)
    found = ef.find(np.array([probe, *values[:5]], dtype=np.uint64))
    assert (found[0] >= 0) == (probe in values) and (found[1:] >= 0).all()


def test_lm_in_several_files(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SEGMENT_WORDS", 20)
    got = by_id(lm_scoring.score_documents(docs), "score")
    for d, want in brute.lm([(r[0], r[1]) for r in ROWS]).items():
        assert abs(got[d][0] - want[5]) <= 1e-3 * want[1]


def test_statistics():
    texts = [r[1] for r in ROWS] + ["a b c d e f g h " * 3, "x\nx\n x\n\n", "#*$%&|<> Ünï"]
    counts, features = statistics(texts)
    assert [tuple(c) for c in counts.tolist()] == [brute.base_stats(t)[:5] for t in texts]
    assert np.isfinite(features).all()


def test_rules(docs, labels):
    got = by_id(quality_rules.apply_rules(docs, labels), *quality_rules.COUNTS, "base_failed", "kept")
    for d, t, *_ in ROWS:
        assert got[d][:6] == brute.base_stats(t)
        assert not (got[d][5] and got[d][6])


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, 3))
    y = (rng.uniform(0, 1, 3000) < 1 / (1 + np.exp(8 * x[:, 0] - 4 + 3 * np.sin(9 * x[:, 1])))).astype(float)
    model = boosting.fit(x, y, np.array([-1, 0, 0]))
    p = model.margin(x) > 0
    assert (p == (y == 1)).mean() > 0.8
    grid = np.repeat(x[:100], 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 100)
    assert (np.diff(model.margin(grid).reshape(100, 40), axis=1) <= 1e-12).all()
    assert np.allclose(boosting.fit(x, np.ones(3000), np.zeros(3)).margin(x[:2]), np.log((1 - 1e-6) / 1e-6))


def test_mixing(docs):
    rows = [(r.document.doc_id, r.source, r.n_tokens, r.quota, r.epoch, r.at_token) for r in mixing.mix_sources(docs, max_repeats=2.0, budget_tokens=None).collect()]
    times = {}
    for d, *_ in rows:
        times[d] = times.get(d, 0) + 1
    assert set(times) == {r[0] for r in ROWS} and max(times.values()) <= 2
    for s in {r[1] for r in rows}:
        mine = sorted((at, n) for _, src, n, _, _, at in rows if src == s)
        total = 0
        for at, n in mine:
            assert at <= total
            total = max(total, at + n)


def test_mixing_to_entropy(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    a = mixing.find_exponent(shares, None, 0.9, 1.0)
    p = np.array([0.7, 0.2, 0.1]) ** a
    p /= p.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(0.9 * np.log(3), abs=1e-5)
    assert mixing.find_exponent(shares, 10.0, None, 1.0) == 0.0


# --- odd tables -----------------------------------------------------------------------------

EXTRA = "document string, id bigint, node bigint, keys string, leaks string, kept boolean, score double, row string, block int, __text string, held_out string, digest string, n string"


def operators(spark, labels_rows=True):
    import public_tokenizers

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0), (4, None, None)] if labels_rows else [], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame(ITEMS if labels_rows else [], "item_id bigint, text string")
    return {
        "token_counts": lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
        "line_dedup": lambda d: line_dedup.drop_boilerplate(d, 2),
        "sharding": lambda d: sharding.assign_shards(d, 3),
        "decontamination": lambda d: decontamination.find_leaks(d, items),
        "classifier": lambda d: quality_classifier.classify(d, labels),
        "jaccard": jaccard_join.jaccard_classes,
        "keep_one": jaccard_join.keep_one,
        "lm": lm_scoring.score_documents,
        "rules": lambda d: quality_rules.apply_rules(d, labels),
        "mixing": lambda d: mixing.mix_sources(d, budget_tokens=None),
    }


NAMES = ["token_counts", "line_dedup", "sharding", "decontamination", "classifier", "jaccard", "keep_one", "lm", "rules", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    d = spark.createDataFrame([], SCHEMA)
    for with_rows in (True, False):
        assert operators(spark, with_rows)[name](d).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_nulls_repeats_and_clashing_columns(spark, name):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (None, None, None, None, None), (None, "a b c d e f g", None, "s", None), (2, "", "en", None, 0), (3, "x " * 3000, None, "t", 6000)]
    d = spark.createDataFrame(rows, SCHEMA)
    for c in EXTRA.split(", "):
        n, kind = c.split()
        from pyspark.sql import functions as F

        d = d.withColumn(n, F.lit(None).cast(kind))
    out = operators(spark)[name](d).collect()
    assert len(out) >= (5 if name == "keep_one" else 6)
    if name != "mixing":
        assert len(out) == (5 if name == "keep_one" else 6)


def test_empty_pages(spark):
    assert warc.archive_and_index(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_many_lines(spark):
    """A text of very many lines, some of them boilerplate; empty lines stay where they are."""
    lines = [f"line {i}" if i % 3 else ("shared" if i % 2 else "") for i in range(60_000)]
    rows = [(0, "\n".join(lines), "a"), (1, "shared\nown", "b"), (2, "\nshared\n", "c"), (3, None, "d"), (4, "", "e")]
    got = by_id(line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), 3), "n_lines", "n_removed", "text")
    kept = [x for x in lines if x != "shared"]
    assert got == {0: (60_000, 60_000 - len(kept), "\n".join(kept)), 1: (2, 1, "own"), 2: (3, 1, "\n"), 3: (0, 0, None), 4: (1, 0, "")}


def test_mixing_of_wordless_and_nameless_rows(spark, monkeypatch):
    """A source of many rows without words has blocks by its rows; rows without ids are taken each by itself."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    rows = [(None, None, "hot")] * 500 + [(None, "a b", "s")] * 50 + [(i, "c d e", "s") for i in range(50)]
    out = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA.split(", lang")[0] + ", source string")).collect()
    assert sum(r.source == "hot" for r in out) == 500 and sum(r.source == "s" for r in out) >= 100
    assert len({r.at_token for r in out if r.source == "s" and r.epoch == 0}) == 100
