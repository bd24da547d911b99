"""The classifier against plain versions of its parts; scores do not depend on how rows are dealt."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import quality_classifier as qc
from driftline.llm import quality_rules

from ..test_catalog import SF

SCHEMA = "doc_id bigint, text string, lang string, source string"


def made(n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"w{rng.randrange(150)}" for _ in range(rng.randint(5, 60))] + (["junk"] * 3 if bad else [])
        rows.append((i, " ".join(words) + ("\n!!" if bad else ""), f"p{i % 3}", f"h{i % 7}"))
        labels.append((i, int(not bad), int(i % 50 == 0)))
    # near copies, two texts with one id, nulls
    rows += [(n + i, rows[5][1] + f" w{i}", "p0", "h0") for i in range(30)] + [(3, "another text", "p1", "h1"), (None, "no id", None, None), (n + 40, None, "p1", None), (n + 41, "", None, "h9")]
    labels += [(n + i, 1, 0) for i in range(30)] + [(None, 1, 0), (3, 1, 0)]
    return rows, labels


def scores(spark, parts, seed):
    rows, labels = made()
    random.Random(seed).shuffle(rows), random.Random(seed).shuffle(labels)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").repartition(parts)
    out = qc.classify(docs, known).select("document.*", "doc_quality", "host_quality", "path_quality", "score", "kept")
    rules = quality_rules.apply_rules(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), known)
    return sorted(map(repr, out.collect())), sorted(map(repr, rules.select("doc_id", "quality", "kept").where("doc_id <> 3").collect()))


def test_any_order_and_partitioning(spark):
    one = scores(spark, 1, 0)
    for parts, seed in ((3, 1), (7, 2)):
        assert scores(spark, parts, seed) == one


def test_query_on_any_partitioning(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = [sorted(map(repr, qc.classify(docs.repartition(n), labels.repartition(n), carry=["doc_id"]).collect())) for n in (2, 7)]
    assert got[0] == got[1]


def plain_posteriors(rows):
    """Both levels by loops over lists."""
    def strength(groups, means):
        n = sum(len(g) for g in groups)
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, means, strict=True))
        within = sum(m * (1 - m) for m in means)
        return min(max(within / len(groups) / max((between - within) / n, 1e-9) - 1, qc.LEAST_STRENGTH), qc.MOST_STRENGTH)

    hosts, paths = {}, {}
    for h, p, x in rows:
        hosts.setdefault(h, []).append(x), paths.setdefault((h, p), []).append(x)
    mean = sum(x for *_, x in rows) / len(rows)
    k = strength(list(hosts.values()), [mean] * len(hosts))
    top = {h: (k * mean + sum(v)) / (k + len(v)) for h, v in hosts.items()}
    k = strength(list(paths.values()), [top[h] for h, _ in paths])
    return {(h, p): (top[h], (k * top[h] + sum(v)) / (k + len(v))) for (h, p), v in paths.items()}


def test_posteriors(spark):
    rng = random.Random(4)
    rows = [(f"h{i % 11}", f"p{rng.randrange(4)}", min(1.0, rng.random() * (1 + i % 11) / 9)) for i in range(900)]
    got, _ = qc.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    want = plain_posteriors(rows)
    assert {(r.host, r.path) for r in got.collect()} == set(want)
    for r in got.collect():
        assert (r.host_quality, r.path_quality) == pytest.approx(want[r.host, r.path], abs=1e-6)


def plain_fit(docs, x, y, used, rounds=300, ridge=0.1, rate=0.3):
    """The same descent with lists: docs are sets of buckets."""
    share = sum(y) / len(y)
    mean = [sum(c) / len(c) for c in zip(*x, strict=True)]
    scale = [max(math.sqrt(sum((v - m) ** 2 for v in c) / len(c)), 1e-6) for c, m in zip(zip(*x, strict=True), mean, strict=True)]
    xs = [[min(max((v - m) / s, -4), 4) for v, m, s in zip(r, mean, scale, strict=True)] for r in x]
    w, v, b = dict.fromkeys(used, 0.0), [0.0] * len(mean), 0.0
    gw, gv, gb = dict.fromkeys(used, 1e-8), [1e-8] * len(mean), 1e-8
    for _ in range(rounds):
        r = []
        for d, row, label in zip(docs, xs, y, strict=True):
            m = sum(w[t] for t in d if t in w) + sum(p * q for p, q in zip(row, v, strict=True)) + b
            r.append((0.5 / share if label else 0.5 / (1 - share)) * (1 / (1 + math.exp(-min(max(m, -30), 30))) - label))
        dw = {t: sum(e for e, d in zip(r, docs, strict=True) if t in d) + ridge * w[t] for t in w}
        dv = [sum(e * row[j] for e, row in zip(r, xs, strict=True)) + ridge * v[j] for j in range(len(v))]
        db = sum(r)
        gw, gv, gb = {t: gw[t] + dw[t] ** 2 for t in w}, [g + d * d for g, d in zip(gv, dv, strict=True)], gb + db * db
        w = {t: w[t] - rate * dw[t] / math.sqrt(gw[t]) for t in w}
        v = [p - rate * d / math.sqrt(g) for p, d, g in zip(v, dv, gv, strict=True)]
        b -= rate * db / math.sqrt(gb)
    return w, v, b


def test_fit_and_margin(spark):
    rows, labels = made(120)
    texts, y = [t for _, t, *_ in rows[:120]], np.array([q for _, q, _ in labels[:120]], dtype=float)
    buckets, offsets = qc.word_sets(texts)
    x = qc.statistics(texts)[1]
    model = qc.fit(buckets, offsets, x, y, 1 - y, rounds=40)
    docs = [set(buckets[lo:hi].tolist()) for lo, hi in zip(offsets, offsets[1:], strict=False)]
    used = np.flatnonzero(model.words).tolist()
    assert used and set(used) <= set(qc.telling_words(buckets, offsets, y).tolist())
    w, v, b = plain_fit(docs, x.tolist(), y.tolist(), qc.telling_words(buckets, offsets, y).tolist(), rounds=40)
    assert model.dense == pytest.approx(v, rel=1e-6, abs=1e-9) and model.bias == pytest.approx(b, rel=1e-6)
    z = np.clip((x - model.mean) / model.scale, -4, 4)
    want = [min(max(sum(w.get(t, 0.0) for t in d) + float(sum(p * q for p, q in zip(row, v, strict=True))) + b, -30), 30) for d, row in zip(docs, z.tolist(), strict=True)]
    assert model.margin(texts) == pytest.approx(want, abs=1e-4)
    assert [model.margin([t])[0] for t in texts] == model.margin(texts).tolist()


def test_kept_follows_the_score(spark):
    rows, labels = made()
    out = qc.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.kept == (r.score >= 0.5 and any(c.isalnum() for c in r.document.text or ""))
    bad = [r.kept for r in out if "junk" in (r.document.text or "")]
    assert np.mean(bad) < 0.1
