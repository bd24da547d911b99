"""Quality classifier by hierarchical empirical Bayes.

A logistic model over hashed words and document statistics gives each document's
evidence. Grouped sums of that evidence give every host and every path under it a
posterior quality rate: a path is shrunk toward its host and a host toward the
corpus, the more the sparser it is, with strengths estimated from the data. The
final log-odds are the document's, moved by its path's log-odds against the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .docstats import FEATURES, statistics
from .words import LOOSE, Words, by_bytes, mix, shingles
from .workspace import bounded_sample, columns_as, materialise, small_batches

#: Labelled documents that the model is fitted on at most, chosen by a hash of their id.
MAX_TRAIN = 20_000
BUCKET_BITS = 18
#: Word buckets of less evidence than this (chance would give one in 130 thousand so much) are noise to the model.
LEAST_G2 = 20.0
#: Bounds of the estimated prior strengths, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6


def word_sets(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of each text: values, and offsets per text."""
    w = Words(texts, LOOSE, lower=True)
    keys = np.unique((w.doc.astype(np.int64) << BUCKET_BITS) | (w.hash >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    offsets = np.searchsorted(keys >> BUCKET_BITS, np.arange(len(texts) + 1))
    return (keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32), offsets


def min_hashes(texts: Sequence[str | None]) -> np.ndarray:
    """Two min-hashes of each text's 5-word shingles (of the words, where there are fewer)."""
    w = Words(texts, LOOSE, lower=True)
    out = np.zeros((len(texts), 2), dtype=np.uint64)
    for d in range(len(texts)):
        h = w.hash[w.offset[d] : w.offset[d + 1]]
        if len(h):
            s = shingles(h, min(5, len(h)))
            out[d] = s.min(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).min()
    return out.view(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's values, which does not depend on the texts around it."""
    out = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values.astype(np.float64), offsets[some])
    return out


@dataclass
class Logistic:
    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    bias: float

    def margin(self, texts: Sequence[str | None]) -> np.ndarray:
        buckets, offsets = word_sets(texts)
        x = np.clip((statistics(texts)[1] - self.mean) / self.scale, -4, 4)
        return np.clip(_sums(self.words[buckets], offsets) + (x * self.dense).sum(axis=1) + self.bias, -30, 30)


def telling_words(buckets: np.ndarray, offsets: np.ndarray, y: np.ndarray, least: float = LEAST_G2) -> np.ndarray:
    """Buckets that tell the classes apart beyond chance: likelihood ratio statistic G2 of the 2 x 2 table of ``least`` or more.

    A model over all words would learn the rare ones of its sample by heart.
    """
    n, good = len(y), float(y.sum())
    with_word = np.bincount(buckets, minlength=1 << BUCKET_BITS).astype(float)
    in_good = np.bincount(buckets, np.repeat(y, np.diff(offsets)), 1 << BUCKET_BITS)
    table = [(in_good, with_word * good / n), (with_word - in_good, with_word * (n - good) / n), (good - in_good, (n - with_word) * good / n), (n - good - with_word + in_good, (n - with_word) * (n - good) / n)]
    g2 = sum(2 * o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300)) * (o > 0) for o, e in table)
    return np.flatnonzero(g2 >= least)


def unlike(marks: np.ndarray) -> np.ndarray:
    """Rows, in a fixed order, of which no earlier row has either of the two min-hashes: near copies would count as so many witnesses for their words."""
    seen: set[tuple[int, int]] = set()
    keep = np.zeros(len(marks), dtype=bool)
    for i, pair in enumerate(marks.tolist()):
        named = [(j, m) for j, m in enumerate(pair)]
        keep[i] = not any(x in seen for x in named)
        seen.update(named)
    return keep


def fit(buckets: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray, toxic: np.ndarray, ridge: float = 0.1, rounds: int = 300, rate: float = 0.3) -> Logistic:
    """L2-regularised logistic regression by AdaGrad over the whole sample, on its telling words and the statistics.

    One class only, or no rows: a model without weights whose bias is the share.
    """
    words, d = np.zeros(1 << BUCKET_BITS, dtype=np.float32), len(FEATURES)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if len(y) < 2 or y.min() == y.max():
        return Logistic(words, np.zeros(d), np.ones(d), np.zeros(d), bias)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    xs = np.clip((x - mean) / scale, -4, 4)
    used = np.union1d(telling_words(buckets, offsets, y), telling_words(buckets, offsets, toxic))
    place = np.full(1 << BUCKET_BITS, -1)
    place[used] = np.arange(len(used))
    col = place[buckets]
    row = np.repeat(np.arange(len(y)), np.diff(offsets))[col >= 0]
    col = col[col >= 0]
    # rare classes weigh as much as common ones; the bias is put right for it at the end
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, v, b = np.zeros(len(used)), np.zeros(d), 0.0
    gw, gv, gb = np.full(len(used), 1e-8), np.full(d, 1e-8), 1e-8
    for _ in range(rounds):
        m = np.bincount(row, w[col], len(y)) + xs @ v + b
        r = weight * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y)
        dw, dv, db = np.bincount(col, r[row], len(used)) + ridge * w, xs.T @ r + ridge * v, float(r.sum())
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
        w, v, b = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv), b - rate * db / np.sqrt(gb)
    words[used] = w
    return Logistic(words, mean, scale, v, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, quality_col: str, toxic_col: str, max_train: int = MAX_TRAIN) -> Logistic:
    """The document model for P(quality = 1 and not toxic) on at most ``max_train`` labelled documents.

    Nothing depends on how rows are dealt or in which order they arrive: of several
    texts with one id the least counts, and documents are taken in the order of a
    hash of their ids.
    """
    y = columns_as(labels, id=id_col, q=quality_col, t=toxic_col).where("q is not null and id is not null")
    y = y.groupBy("id").agg(F.min("q").alias("q"), F.coalesce(F.max("t"), F.lit(0)).alias("t"))
    y = materialise(bounded_sample(materialise(y, "labels"), "id", max_train), "sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in by_bytes(texts):
                buckets, offsets = word_sets(texts[lo:hi])
                x = statistics(texts[lo:hi])[1]
                marks = min_hashes(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in ("rank", "key", "q", "t")], pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * 2), pa.array(marks.ravel())), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(buckets)), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["rank", "key", "q", "t", "marks", "words", "x"])

    # the sample has max_train rows of a number each at most: a proven bound for broadcasting
    rows = columns_as(docs, id=id_col, text=text_col).join(F.broadcast(y), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("q").alias("q"), F.min("t").alias("t"))
    rows = rows.select("text", F.xxhash64("id").alias("rank"), F.col("id").cast("string").alias("key"), F.col("q").cast("int").alias("q"), F.col("t").cast("int").alias("t"))
    told = rows.mapInArrow(features, "rank bigint, key string, q int, t int, marks array<bigint>, words array<int>, x array<double>")
    # the sample is bounded, so one task fits the model; only the model comes back
    got = told.repartition(1).mapInArrow(_fit_sample, "words binary, mean array<double>, scale array<double>, dense array<double>, bias double").first()
    if got is None:
        none = np.zeros(0)
        return fit(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros((0, len(FEATURES))), none, none)
    return Logistic(np.frombuffer(got.words, np.float32), *(np.array(got[c]) for c in ("mean", "scale", "dense")), got.bias)


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (rank, key, q, t, marks, words, x), taken in the order of rank and key; nothing for no rows."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).sort_by([("rank", "ascending"), ("key", "ascending")]).combine_chunks()
    table = table.filter(pa.array(unlike(table["marks"].combine_chunks().flatten().to_numpy().reshape(-1, 2)))).combine_chunks()
    words, x = (table[c].combine_chunks() for c in ("words", "x"))
    offsets = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())]).astype(np.int64)
    quality, toxic = (table[c].to_numpy().astype(float) for c in ("q", "t"))
    m = fit(words.flatten().to_numpy(), offsets, x.flatten().to_numpy().reshape(-1, len(FEATURES)), quality * (1 - toxic), toxic)
    lists = [pa.array([v.astype(float).tolist()], pa.list_(pa.float64())) for v in (m.mean, m.scale, m.dense)]
    yield pa.RecordBatch.from_arrays([pa.array([m.words.tobytes()], pa.binary()), *lists, pa.array([float(m.bias)])], names=["words", "mean", "scale", "dense", "bias"])


def _scored(rows: DataFrame, model: Logistic) -> DataFrame:
    """``rows`` with the document's log-odds in place of its text (``__text``)."""
    names = [c for c in rows.columns if c != "__text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__text").to_pylist()
            m = np.concatenate([model.margin(texts[lo:hi]) for lo, hi in by_bytes(texts)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(m)], names=[*names, "__logit"])

    schema = StructType([f for f in rows.schema if f.name != "__text"] + [StructField("__logit", DoubleType())])
    return rows.mapInArrow(score, schema)


#: Probabilities are summed as whole multiples of 1 / UNIT, other terms as decimals, so that sums do not depend on the order of rows.
UNIT = 1 << 24
_EXACT = "decimal(38,12)"


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength by the method of moments: how many documents the level above is worth to these groups (n, s)."""
    mean = f"CAST({mean} AS DOUBLE)"
    spread = (F.col("n") * F.pow(F.col("s") / F.col("n") - F.expr(mean), F.lit(2))).cast(_EXACT)
    noise = F.expr(f"({mean}) * (1 - ({mean}))").cast(_EXACT)
    n, between, within, count = groups.agg(F.sum("n"), F.sum(spread), F.sum(noise), F.count("*")).first()
    if not n:
        return LEAST_STRENGTH
    return float(np.clip(float(within) / count / max((float(between) - float(within)) / n, 1e-9) - 1, LEAST_STRENGTH, MOST_STRENGTH))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Posterior quality of every (host, path) from ``scored`` (host, path, p), and the corpus mean.

    Rates are shrunk: path toward host, host toward the corpus.
    """
    units = F.sum(F.round(F.col("p") * UNIT).cast("bigint"))
    paths = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), units.alias("units")), "paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("units").alias("units")), "hosts")
    total, n = hosts.agg(F.sum("units"), F.sum("n")).first()
    mean = float(np.clip(total / UNIT / n if n else 0.5, 1e-3, 1 - 1e-3))
    paths, hosts = (x.withColumn("s", F.col("units") / float(UNIT)) for x in (paths, hosts))
    k = _strength(hosts, repr(mean))
    posterior = hosts.select("host", ((k * mean + F.col("s")) / (k + F.col("n"))).alias("host_quality"))
    under = paths.join(posterior, "host")
    k = _strength(under, "host_quality")
    return under.select("host", "path", "host_quality", ((k * F.col("host_quality") + F.col("s")) / (k + F.col("n"))).alias("path_quality")), mean


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", path_col: str | None = "lang", quality_col: str = "quality", toxic_col: str = "toxic", threshold: float = 0.5, max_train: int = MAX_TRAIN, carry: Sequence[str] | None = None) -> DataFrame:
    """Every row as a struct ``document`` of its columns (all, or those of ``carry``), with doc_quality, host_quality, path_quality, score and kept.

    Documents without a word (null or empty texts) carry no evidence of quality and
    are rejected. A null host or path is the host or path ''. Rows are judged each
    by itself, whatever their id. Without labels of both classes the document model
    is a constant. An empty table gives an empty result. Scores are the same to the
    last bit however the rows are dealt. Texts are read once to fit and once to
    score; rows are written with their evidence, and then meet their site's posterior.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, quality_col, toxic_col, max_train)

    def site(c: str | None):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c else F.lit("")

    def sigmoid(x):
        return 1 / (1 + F.exp(-x))

    text = F.col(f"`{text_col}`")
    has_word = F.coalesce(text.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    columns = docs.columns if carry is None else list(carry)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("document"), site(host_col).alias("host"), site(path_col).alias("path"), has_word.alias("has_word"), text.alias("__text"))
    rows = materialise(_scored(rows, model), "evidence", wide=True)
    posteriors, mean = site_posteriors(rows.select("host", "path", sigmoid(F.col("__logit")).alias("p")))
    posteriors = materialise(posteriors, "posteriors")
    shift = F.log(F.col("path_quality") / (1 - F.col("path_quality"))) - float(np.log(mean / (1 - mean)))
    rows = rows.join(posteriors, ["host", "path"]).withColumn("score", sigmoid(F.col("__logit") + shift))
    return rows.select("document", sigmoid(F.col("__logit")).alias("doc_quality"), "host_quality", "path_quality", "score", (F.col("has_word") & (F.col("score") >= threshold)).alias("kept"))
