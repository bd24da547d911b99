"""Temperature mixing of sources, realised as budgeted block permutations.

Built-in functions only. A source's weight is its token share to the power of an
exponent. The exponent is bisected on a grid of 2**-20 for the flattest mix that
keeps a repetition limit, or for a target entropy. Each source then gets a token
quota, filled epoch by epoch with its blocks in a permuted order; the last epoch is
cut at the quota, so a source larger than its quota is read in part and a smaller
one is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise

#: The exponent is a multiple of 2**-20, found in 4 rounds of 32 equal parts.
ROUNDS, PARTS = 4, 32
#: Tokens and rows of one block, about: what is ordered within one task.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 17, 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _draw(*parts: Column) -> Column:
    """A 32-bit number from the MD5 of the parts: any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def find_exponent(shares: DataFrame, max_repeats: float | None, entropy_share: float | None, budget_share: float | None) -> float:
    """The least exponent in [0, 1] whose mix keeps the limit; 1.0 (the corpus as it is) if none does.

    ``shares`` has one row per source: p, its share of all tokens. With
    ``max_repeats``, no source is read more than so often; with ``entropy_share``,
    the mix's entropy is at most that part of the uniform mix's. ``budget_share`` is
    the budget over all tokens; None is the least budget that reads every source whole.
    """
    at, step = 0, 1 << 20
    for _ in range(ROUNDS):
        step //= PARTS
        grid = shares.select("p", F.explode(F.sequence(F.lit(at), F.lit(at + (PARTS - 1) * step), F.lit(step))).alias("k")).withColumn("a", F.col("k") / float(1 << 20))
        sums = grid.groupBy("k").agg(
            F.sum(F.pow("p", "a")).alias("z"),
            F.sum(F.pow("p", "a") * F.log("p") * F.col("a")).alias("zl"),
            F.max(F.pow(F.col("p"), F.col("a") - 1)).alias("most"),
            F.max(F.pow(F.col("p"), 1 - F.col("a"))).alias("cover"),
            F.count("*").alias("n"),
        )
        repeats = F.col("most") * (F.col("cover") if budget_share is None else F.lit(float(budget_share)) / F.col("z"))
        ok = F.lit(True)
        if max_repeats is not None:
            ok = ok & (repeats <= max_repeats)
        if entropy_share is not None:
            ok = ok & (F.log("z") - F.col("zl") / F.col("z") <= entropy_share * F.log(F.col("n").cast("double")))
        failing = sums.where(~ok).agg(F.max("k")).first()[0]  # the condition holds from some exponent on
        if failing is None:
            return at / float(1 << 20)
        at = failing
    return min(1.0, (at + 1) / float(1 << 20))


def source_quotas(sources: DataFrame, max_repeats: float | None, entropy_share: float | None, budget_tokens: int | None) -> DataFrame:
    """``sources`` (source, tokens > 0) with weight and quota, in tokens."""
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sources.withColumns({"weight": F.lit(0.0), "quota": F.lit(0).cast("bigint")})
    shares = sources.withColumn("p", F.col("tokens") / float(total))
    budget_share = None if budget_tokens is None else budget_tokens / total
    a = find_exponent(shares, max_repeats, entropy_share, budget_share)
    z, cover = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.pow(F.col("p"), F.lit(1 - a)))).first()
    budget = total * z * cover if budget_tokens is None else float(budget_tokens)
    weight = F.pow("p", F.lit(a)) / z
    # with the least budget the largest source is read whole: rounding must not cost it a document
    quota = F.floor(weight * budget) if budget_tokens is not None else F.greatest(F.floor(weight * budget), F.col("tokens"))
    return shares.select("source", "tokens", weight.alias("weight"), quota.cast("bigint").alias("quota"))


def mix_sources(docs: DataFrame, max_repeats: float | None = 2.0, entropy_share: float | None = None, budget_tokens: int | str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] | None = None) -> DataFrame:
    """Rows of the mix, one per document and epoch: ``document`` (a struct of all input columns, or of those in ``carry``), source, n_tokens, quota, epoch, at_token.

    at_token is where the document starts in its source's stream of ``quota``
    tokens; at_token / quota orders the whole mix with every source evenly spread.
    A document that starts before the quota's end is taken whole. A null source is
    the source ''. Documents without words (null, empty) cost no tokens and are
    taken wherever their block's turn comes, at least once if the source is read
    whole; a source without any words is taken once. Repeated rows are taken each
    by itself; rows without an id are told apart by where they lie. An empty table
    gives an empty result. ``budget_tokens`` None is the least budget that reads
    every document once, "corpus" the corpus's own tokens. Texts are read once.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("document"),
        F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"),
        n_words(F.col(f"`{text_col}`")).alias("n_tokens"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))).alias("key"),
    )
    rows = materialise(rows, "counted", wide=True)
    sources = materialise(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    if budget_tokens == "corpus":
        budget_tokens = sources.agg(F.sum("tokens")).first()[0]
    some = source_quotas(sources.where("tokens > 0").select("source", "tokens"), max_repeats, entropy_share, budget_tokens).select("source", "tokens", "quota")
    none = sources.where("tokens = 0").select("source", "tokens", F.lit(0).cast("bigint").alias("quota"))
    blocks = F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("bigint") + 1
    plan = some.unionByName(none).join(sources.select("source", "rows"), "source").withColumn("blocks", blocks).drop("rows")
    plan = materialise(plan, "quotas")
    # the key alone decides the block, so a hot source spreads over its blocks before any shuffle needs the source whole
    blocked = rows.join(plan.select("source", "blocks"), "source").withColumn("block", _draw(F.lit("block"), F.col("key")) % F.col("blocks")).drop("blocks")
    sizes = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    last = F.greatest(F.ceil(F.col("quota") / F.greatest(F.col("tokens"), F.lit(1))).cast("int") - 1, F.lit(0))
    epochs = plan.select("source", "quota", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("epoch"))
    turn = Window.partitionBy("source", "epoch").orderBy(_draw(F.col("source"), F.col("block"), F.col("epoch")), "block")
    start = F.coalesce(F.sum("block_tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = sizes.join(epochs, "source").withColumn("at", (F.col("epoch") * F.col("tokens") + start).cast("bigint"))
    order = materialise(order.where((F.col("at") < F.col("quota")) | (F.col("epoch") == 0) & (F.col("quota") >= F.col("tokens"))).select("source", "block", "epoch", "quota", "tokens", "at"), "block_order")
    picked = blocked.join(order, ["source", "block"])
    within = Window.partitionBy("source", "block", "epoch").orderBy(_draw(F.col("key"), F.col("epoch")), "key").rowsBetween(Window.unboundedPreceding, -1)
    picked = picked.withColumn("at_token", (F.col("at") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).cast("bigint"))
    picked = picked.where((F.col("at_token") < F.col("quota")) | (F.col("epoch") == 0) & (F.col("quota") >= F.col("tokens")))
    return picked.select("document", "source", "n_tokens", "quota", "epoch", "at_token")


def _sql() -> str:
    rounds = ["r0 AS (SELECT CAST(0 AS BIGINT) AS lo)"]
    step = 1 << 20
    for i in range(1, ROUNDS + 1):
        step //= PARTS
        rounds.append(f"""r{i} AS (
  SELECT coalesce(max(k), (SELECT lo FROM r{i - 1})) AS lo FROM (
    SELECT k, max(pow(p, k / 1048576.0 - 1)) / sum(pow(p, k / 1048576.0)) AS repeats
    FROM share, (SELECT r{i - 1}.lo + j * {step} AS k FROM r{i - 1}, generate_series(0, {PARTS - 1}) g(j)) grid
    GROUP BY k) WHERE repeats > 2.0)""")
    return f"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(doc_id AS VARCHAR) AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens
  FROM documents
), src AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_rows FROM doc GROUP BY source),
tot AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t FROM src WHERE tokens > 0),
share AS (SELECT source, tokens, tokens / (SELECT t FROM tot) AS p FROM src WHERE tokens > 0),
{', '.join(rounds)},
expo AS (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM (SELECT max(1 / p) / count(*) AS repeats FROM share) WHERE repeats > 2.0) THEN 0.0
                ELSE least(1.0, (lo + 1) / 1048576.0) END AS a FROM r{ROUNDS}),
quota AS (
  SELECT source, tokens, CAST(floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM share, expo) * (SELECT t FROM tot)) AS BIGINT) AS quota FROM share, expo
  UNION ALL SELECT source, tokens, 0 FROM src WHERE tokens = 0
), blocked AS (
  SELECT d.*, quota, tokens, CAST('0x' || md5('block:' || key)[1:8] AS BIGINT) % (CAST(greatest(ceil(tokens / {BLOCK_TOKENS}.0), ceil(n_rows / {BLOCK_ROWS}.0)) AS BIGINT) + 1) AS block
  FROM doc d JOIN quota USING (source) JOIN (SELECT source, n_rows FROM src) USING (source)
), size AS (SELECT source, block, quota, tokens, sum(n_tokens) AS block_tokens FROM blocked GROUP BY ALL),
ep AS (
  SELECT *, unnest(generate_series(0, greatest(CAST(ceil(quota / greatest(tokens, 1)) AS BIGINT) - 1, 0))) AS epoch FROM size
), ord AS (
  SELECT source, block, epoch, epoch * tokens + coalesce(sum(block_tokens) OVER (
    PARTITION BY source, epoch ORDER BY CAST('0x' || md5(source || ':' || block || ':' || epoch)[1:8] AS BIGINT), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ep
), placed AS (
  SELECT b.doc_id, source, b.n_tokens, b.quota, b.tokens, o.epoch, o.start + coalesce(sum(b.n_tokens) OVER (
    PARTITION BY source, block, o.epoch ORDER BY CAST('0x' || md5(key || ':' || o.epoch)[1:8] AS BIGINT), key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_token
  FROM blocked b JOIN ord o USING (source, block)
)
SELECT doc_id, source, n_tokens, quota, CAST(epoch AS INTEGER) AS epoch, CAST(at_token AS BIGINT) AS at_token
FROM placed WHERE at_token < quota OR (epoch = 0 AND quota >= tokens)
"""


SQL = _sql()
