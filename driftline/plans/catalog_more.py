"""Queries of findings, lanes, verdicts, scoring, grouping, similarity, metadata, inference and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata, precision
from ..operators import brackets, consensus, gaps, grouping, inference, lanes, legacy, quality, robust, scoring, similarity, summary, targets
from ..schema import TrackingSettings
from .catalog import SCALE, SETTINGS, TL_ENDS, TRACKLET_SQL, WITH_KIN, WITH_OBS, WITH_SUM, obs, query, r, rounded, tracklets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def summed(spark, sf_dir):
    return summary.track_summary(obs(spark, sf_dir), SCALE, SETTINGS)


def plain(found: DataFrame) -> DataFrame:
    return found.select("severity", "code", "title", "frame", "track_id")


COUNT_SQL = "counts AS (SELECT CAST(f AS INTEGER) AS frame, (SELECT count(*) FROM obs WHERE obs.frame = f) AS n_objects FROM (SELECT unnest(generate_series(0, (SELECT max(frame) FROM obs))) AS f))"
LINK_SQL = "link AS (SELECT * FROM (SELECT *, lag(frame) OVER w AS pf, lag(area_px) OVER w AS pa FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame)) WHERE pf IS NOT NULL)"
RULE_SQL = {
    "count_jump": "SELECT 'warning' AS severity, 'count_jump' AS code, 'Object count jumps from ' || a.n_objects || ' to ' || b.n_objects || ' at frame ' || b.frame AS title, b.frame AS frame, CAST(NULL AS BIGINT) AS track_id FROM counts a JOIN counts b ON b.frame = a.frame + 1 WHERE abs(b.n_objects - a.n_objects) >= 2 AND abs(b.n_objects - a.n_objects) >= 0.5 * a.n_objects",
    "segmentation_gap": "SELECT 'warning' AS severity, 'segmentation_gap' AS code, 'No cells found in a frame between detections' AS title, frame, CAST(NULL AS BIGINT) AS track_id FROM counts WHERE n_objects = 0 AND frame > (SELECT min(frame) FROM counts WHERE n_objects > 0) AND frame < (SELECT max(frame) FROM counts WHERE n_objects > 0)",
    "gap_bridged": "SELECT 'info' AS severity, 'gap_bridged' AS code, 'Track ' || track_id || ' reacquired after ' || (frame - pf - 1) || ' missing frame(s)' AS title, frame, track_id FROM link WHERE frame - pf > 1",
    "likely_missed_detection": "SELECT 'warning' AS severity, 'likely_missed_detection' AS code, 'Frame ' || (pf + 1) || ' is a likely missed detection' AS title, pf + 1 AS frame, track_id FROM link WHERE frame - pf = 2",
    "long_reacquisition": "SELECT 'warning' AS severity, 'long_reacquisition' AS code, 'Track ' || track_id || ' was reacquired after ' || (frame - pf - 1) || ' missing frames' AS title, frame, track_id FROM link WHERE frame - pf > 2",
    "size_jump": "SELECT 'warning' AS severity, 'size_jump' AS code, 'Track ' || track_id || '''s area changes sharply at frame ' || frame AS title, frame, track_id FROM link WHERE pa > 0 AND area_px > 0 AND (area_px / pa > 2.45960311115695 OR area_px / pa < 1.0 / 2.45960311115695)",
    "fast_track": "SELECT 'warning' AS severity, 'fast_track' AS code, 'Track ' || track_id || ' moves close to the speed limit' AS title, last_frame AS frame, track_id FROM summary WHERE max_speed_um_per_min > 4.0",
    "fragment": "SELECT 'info' AS severity, 'fragment' AS code, 'Track ' || track_id || ' has only ' || n_observations || ' observation(s)' AS title, first_frame AS frame, track_id FROM summary WHERE flags = 'fragment'",
    "gap_dominated_track": "SELECT 'warning' AS severity, 'gap_dominated_track' AS code, 'Track ' || track_id || ' is missing more often than it is seen' AS title, first_frame AS frame, track_id FROM summary WHERE total_missing_frames > 0 AND total_missing_frames >= n_observations",
    "fallback_dependent_track": "SELECT 'warning' AS severity, 'fallback_dependent_track' AS code, 'Track ' || track_id || ' depends on the extra detection passes' AS title, first_frame AS frame, track_id FROM summary WHERE n_observations >= 2 AND n_borrowed > 0 AND n_borrowed * 2 >= n_observations",
    "stationary_track": "SELECT 'warning' AS severity, 'stationary_track' AS code, 'Track ' || track_id || ' barely moves' AS title, first_frame AS frame, track_id FROM summary WHERE n_observations >= 2 AND net_displacement_um < 4.0 AND duration_min >= 30.0",
    "no_tracks": "SELECT 'info' AS severity, 'no_tracks' AS code, 'No trajectories in this dataset' AS title, CAST(NULL AS INTEGER) AS frame, CAST(NULL AS BIGINT) AS track_id WHERE (SELECT count(*) FROM summary) = 0",
}
WITH_RULES = f"{WITH_SUM}, {COUNT_SQL}, {LINK_SQL}"


def _rule(code, make):
    def run(spark, sf_dir):
        return plain(make(spark, sf_dir))

    run.__name__ = f"qc_{code}"
    return query(f"{WITH_RULES} {RULE_SQL[code]}")(run)


_counts = lambda s, d: summary.objects_per_frame(obs(s, d))
_links = lambda s, d: quality.links(obs(s, d))
_RULES = {
    "count_jump": lambda s, d: quality.count_jump(_counts(s, d)),
    "segmentation_gap": lambda s, d: quality.segmentation_gap(_counts(s, d)),
    "gap_bridged": lambda s, d: quality.gap_bridged(_links(s, d)),
    "likely_missed_detection": lambda s, d: quality.likely_missed_detection(_links(s, d)),
    "long_reacquisition": lambda s, d: quality.long_reacquisition(_links(s, d)),
    "size_jump": lambda s, d: quality.size_jump(_links(s, d), SETTINGS),
    "fast_track": lambda s, d: quality.fast_track(summed(s, d), SETTINGS),
    "fragment": lambda s, d: quality.fragment(summed(s, d)),
    "gap_dominated_track": lambda s, d: quality.gap_dominated(summed(s, d)),
    "fallback_dependent_track": lambda s, d: quality.fallback_dependent(summed(s, d), SETTINGS),
    "stationary_track": lambda s, d: quality.stationary(summed(s, d), SETTINGS),
    "no_tracks": lambda s, d: quality.no_tracks(summed(s, d)),
}
for _code, _make in _RULES.items():
    _rule(_code, _make)


@query(f"{WITH_SUM} SELECT 'warning' AS severity, 'fast_track' AS code, 'Track ' || track_id || ' moves close to the speed limit' AS title, last_frame AS frame, track_id FROM summary WHERE max_speed_um_per_min > 0.4")
def qc_fast_track_slow_gate(spark, sf_dir):
    return plain(quality.fast_track(summed(spark, sf_dir), TrackingSettings(max_speed_um_per_min=0.5)))


@query(f"{WITH_OBS}, {TRACKLET_SQL} SELECT 'info' AS severity, 'fragment' AS code, 'Track ' || track_id || ' has only ' || count(*) || ' observation(s)' AS title, min(frame) AS frame, track_id FROM tl GROUP BY track_id HAVING count(*) < 2")
def qc_fragment_tracklets(spark, sf_dir):
    return plain(quality.fragment(summary.track_summary(tracklets(spark, sf_dir), SCALE, SETTINGS)))


@query(f"{WITH_OBS}, t AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS k, 1 + y_px / 50.0::DOUBLE AS aspect, 0.5 + x_c % 50 / 100.0::DOUBLE AS solidity FROM obs), u AS (SELECT *, lag(aspect) OVER w AS a0, lag(solidity) OVER w AS s0 FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame)) SELECT 'warning' AS severity, 'morphology_discontinuity' AS code, 'Track ' || track_id || ' changes shape abruptly at frame ' || frame AS title, frame, track_id FROM u WHERE k > 1 AND pow(ln(aspect / a0) / 0.35, 2) + pow((solidity - s0) / 0.10, 2) > -2 * ln(0.01)")
def qc_morphology_discontinuity(spark, sf_dir):
    shaped = obs(spark, sf_dir).withColumns({"aspect": 1 + F.col("y_px") / 50.0, "solidity": 0.5 + F.col("x_c") % 50 / 100.0})
    return plain(quality.morphology_discontinuity(shaped, SETTINGS))


@query(f"{WITH_OBS}, {TRACKLET_SQL}, {TL_ENDS}, p AS (SELECT b.track_id, b.f0 AS frame, a.track_id AS c, row_number() OVER (PARTITION BY b.track_id ORDER BY a.f1 DESC, sqrt((b.sx - a.ex) * (b.sx - a.ex) + (b.sy - a.ey) * (b.sy - a.ey)), a.track_id) AS k FROM ends b JOIN ends a ON a.f1 < b.f0 WHERE b.f0 > 0) SELECT 'info' AS severity, 'unlinked_start' AS code, 'Track ' || track_id || ' starts at frame ' || frame || ' and was not joined to track ' || c AS title, frame, track_id FROM p WHERE k = 1")
def qc_unlinked_start(spark, sf_dir):
    return plain(quality.unlinked_start(gaps.unlinked_starts(tracklets(spark, sf_dir), SETTINGS, SCALE), SETTINGS))


@query("SELECT 'critical' AS severity, unnest(['no_pixel_size', 'no_frame_interval']) AS code, unnest(['No pixel size: lengths are in pixels only', 'No frame interval: times are in frames only']) AS title, CAST(NULL AS INTEGER) AS frame, CAST(NULL AS BIGINT) AS track_id UNION ALL SELECT 'info', 'multichannel_field', '5 lanes: links across lanes are refused', NULL, NULL")
def qc_run_level(spark, sf_dir):
    from ..schema import Scale

    return plain(quality.run_findings(spark, Scale.of(), n_lanes=5, lanes_applied=True))


_ALL = ("count_jump", "segmentation_gap", "gap_bridged", "likely_missed_detection", "long_reacquisition", "size_jump", "fast_track", "fragment", "gap_dominated_track", "fallback_dependent_track", "stationary_track", "no_tracks")


def _all_findings(s, d):
    o = obs(s, d)
    counts, link, sums = summary.objects_per_frame(o), quality.links(o), summary.track_summary(o, SCALE, SETTINGS)
    return quality.united([
        quality.segmentation_gap(counts), quality.count_jump(counts), quality.gap_bridged(link), quality.likely_missed_detection(link), quality.long_reacquisition(link), quality.size_jump(link, SETTINGS),
        quality.fast_track(sums, SETTINGS), quality.fragment(sums), quality.gap_dominated(sums), quality.fallback_dependent(sums, SETTINGS), quality.stationary(sums, SETTINGS), quality.no_tracks(sums),
    ])


@query(f"{WITH_RULES}, f AS ({' UNION ALL '.join(RULE_SQL[c] for c in _ALL)}) SELECT severity, code, title, frame, track_id, CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS severity_rank FROM f")
def qc_all_ordered(spark, sf_dir):
    return _all_findings(spark, sf_dir).drop("rule_seq")


@query(f"{WITH_RULES}, f AS ({' UNION ALL '.join(RULE_SQL[c] for c in _ALL)}) SELECT s.severity, count(f.code) AS n_findings FROM (SELECT unnest(['critical', 'warning', 'info']) AS severity) s LEFT JOIN f USING (severity) GROUP BY s.severity")
def qc_severity_counts(spark, sf_dir):
    return quality.severity_counts(_all_findings(spark, sf_dir))


@query(f"""{WITH_OBS}, {COUNT_SQL}, g AS (SELECT frame, count(*) AS n_gaps FROM (SELECT CAST(unnest(generate_series(frame + 1, nx - 1)) AS INTEGER) AS frame FROM (SELECT track_id, frame, lead(frame) OVER (PARTITION BY track_id ORDER BY frame) AS nx FROM obs) WHERE nx > frame + 1) GROUP BY frame),
h AS (SELECT c.frame, n_objects, coalesce(n_gaps, 0) AS n_gaps, lag(n_objects) OVER (ORDER BY c.frame) AS b, lead(n_objects) OVER (ORDER BY c.frame) AS a FROM counts c LEFT JOIN g ON g.frame = c.frame),
j AS (SELECT frame, n_objects, n_gaps, CASE WHEN n_objects = 0 AND b > 0 AND a > 0 THEN 1 ELSE 0 END AS zero_between, coalesce(abs(n_objects - CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE (b + a) / 2 END), 0.0)::DOUBLE AS jump FROM h)
SELECT *, 3.0 * zero_between + n_gaps + 0.5 * jump AS score FROM j""")
def hard_frame_rank(spark, sf_dir):
    o = obs(spark, sf_dir)
    return quality.hard_frames(summary.objects_per_frame(o), gaps.gaps_per_frame(o))


LANES = [(i, 10.0 + 20 * i, 0.0, 0.0, 1.0, 10.0) for i in range(5)]
LANE_SQL = "CAST(CASE WHEN x_px < 0 OR x_px > 100 THEN -1 ELSE greatest(0, least(4, ceil(x_px / 20) - 1)) END AS INTEGER)"


@query(f"{WITH_OBS} SELECT track_id, frame, {LANE_SQL} AS channel FROM obs")
def lane_assign(spark, sf_dir):
    return lanes.with_lane(obs(spark, sf_dir), LANES).select("track_id", "frame", "channel")


@query(f"{WITH_OBS}, l AS (SELECT track_id, frame, {LANE_SQL} AS channel FROM obs), s AS (SELECT *, lag(channel) OVER (PARTITION BY track_id ORDER BY frame) AS from_channel FROM l) SELECT track_id, frame, from_channel, channel FROM s WHERE from_channel >= 0 AND channel >= 0 AND from_channel <> channel")
def cross_lane_steps(spark, sf_dir):
    return lanes.cross_lane_steps(lanes.with_lane(obs(spark, sf_dir), LANES)).select("track_id", "frame", "from_channel", "channel")


CLASSES = ("STATIC_BACKGROUND", "CHANNEL_WALL", "OUTSIDE_DEVICE", "ARTIFACT", "VALID_CELL_REGION", "UNKNOWN")


def evidence(spark, sf_dir):
    """Evidence rows made of observations: every branch of the verdict occurs."""
    rows = obs(spark, sf_dir)
    cls = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("det_label") % 6 + 1).cast("int"))
    return rows.select(
        "track_id", "frame", (F.col("det_label") % 7 > 0).alias("present_now"), F.when(F.col("x_c") % 5 > 0, (F.col("x_px") - 20) / 10).alias("cellprob"), cls.alias("atlas_class"),
        (F.col("frame") % 10 / 10.0).alias("atlas_wall_fraction"), (F.col("track_id") % 10 / 10.0).alias("atlas_class_confidence"), (F.col("x_c") % 2 == 0).alias("past_support"), (F.col("x_c") % 3 == 0).alias("future_support"),
        F.col("y_px").alias("speed"), F.lit(80.0).alias("max_speed"), (F.col("x_c") % 11 > 0).alias("shape_plausible"), F.when(F.col("frame") % 4 > 0, F.col("y_px") / 100).alias("structure_match"),
    )


EV_SQL = """ev AS (SELECT track_id, frame, det_label % 7 > 0 AS present_now, CASE WHEN x_c % 5 <> 0 AND x_c % 5 > 0 THEN (x_px - 20) / 10 END AS cellprob, ['STATIC_BACKGROUND', 'CHANNEL_WALL', 'OUTSIDE_DEVICE', 'ARTIFACT', 'VALID_CELL_REGION', 'UNKNOWN'][det_label % 6 + 1] AS cls,
  frame % 10 / 10.0::DOUBLE AS wall, track_id % 10 / 10.0::DOUBLE AS conf, x_c % 2 = 0 AS past, x_c % 3 = 0 AS fut, y_px > 80 AS fast, x_c % 11 <= 0 AS odd, CASE WHEN frame % 4 > 0 THEN y_px / 100 END AS structure FROM obs),
v AS (SELECT *, cls = 'CHANNEL_WALL' AND wall >= 0.5 AND conf >= 0.7 AS iswall, cls = 'OUTSIDE_DEVICE' AND conf >= 0.7 AS isout,
  CAST(coalesce(cellprob >= 2, false) AS INT) + CAST(cls = 'VALID_CELL_REGION' AS INT) + CAST(past OR fut AS INT) AS n_support,
  CAST(coalesce(cellprob < 0, false) AS INT) + CAST(cls = 'ARTIFACT' AND conf >= 0.7 AS INT) + CAST(fast AS INT) + CAST(odd AS INT) AS n_against FROM ev),
st AS (SELECT track_id, frame, CASE WHEN present_now AND NOT iswall AND NOT isout THEN n_support END AS n_support, CASE WHEN present_now AND NOT iswall AND NOT isout THEN n_against END AS n_against,
  CASE WHEN NOT present_now THEN CASE WHEN past AND fut AND coalesce(structure >= 0.5, false) AND NOT fast THEN 'TEMPORAL_RECOVERY_CANDIDATE' ELSE 'REJECTED' END
       WHEN iswall OR isout THEN 'REJECTED' WHEN n_against >= 1 THEN CASE WHEN n_support >= 1 THEN 'AMBIGUOUS' ELSE 'REJECTED' END
       WHEN n_support >= 2 THEN 'CONFIRMED' WHEN n_support = 1 THEN 'LIKELY' ELSE 'AMBIGUOUS' END AS state FROM v)"""


@query(f"{WITH_OBS}, {EV_SQL} SELECT * FROM st")
def referee_states(spark, sf_dir):
    return consensus.verdict(evidence(spark, sf_dir)).select("track_id", "frame", "n_support", "n_against", "state")


@query(f"{WITH_OBS}, {EV_SQL} SELECT s.state, count(st.frame) AS n_objects FROM (SELECT unnest(['CONFIRMED', 'LIKELY', 'AMBIGUOUS', 'REJECTED', 'TEMPORAL_RECOVERY_CANDIDATE']) AS state) s LEFT JOIN st USING (state) GROUP BY s.state")
def state_counts(spark, sf_dir):
    return consensus.state_counts(consensus.verdict(evidence(spark, sf_dir)))


@query(f"{WITH_OBS}, c AS (SELECT track_id, CAST(y_px AS INT) % 5 AS class_code, count(*) AS n FROM obs GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, class_code) AS k FROM c) SELECT track_id AS object_id, max(CASE WHEN k = 1 THEN class_code END) AS dominant, round(max(n) / sum(n), 6) AS share, round(sum(CASE WHEN class_code = 1 THEN n ELSE 0 END) / sum(n), 6) AS wall_share FROM m GROUP BY track_id")
def atlas_dominant_class(spark, sf_dir):
    votes = obs(spark, sf_dir).select(F.col("track_id").alias("object_id"), (F.col("y_px").cast("int") % 5).alias("class_code"))
    return rounded(consensus.dominant_class(votes))


@query(f"{WITH_OBS} SELECT track_id, frame, {r('floor_px')}, y_px / floor_px < 3 AS below FROM (SELECT track_id, frame, y_px, 1.4142135623730951 * sqrt((0.55 / sqrt(area_px)) * (0.55 / sqrt(area_px)) + 0.01::DOUBLE) AS floor_px FROM obs)")
def precision_floor(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("floor_px", precision.displacement_floor(F.col("area_px"), 0.5, 0.1, 0.1))
    return rounded(rows.select("track_id", "frame", "floor_px", precision.below_floor(F.col("y_px"), F.col("floor_px"), 3.0).alias("below")))


LABELLED = "d AS (SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def scored_docs(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") >= 500).alias("predicted"))


@query(f"WITH {LABELLED}, s AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars >= 500) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars < 500) AS fn FROM d GROUP BY lang) SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM s")
def score_prf(spark, sf_dir):
    return rounded(scoring.prf(scored_docs(spark, sf_dir), "lang"))


@query(f"WITH {LABELLED}, s AS (SELECT count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars >= 500) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars < 500) AS fn FROM d) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s")
def score_pooled(spark, sf_dir):
    return rounded(scoring.pooled(scoring.prf(scored_docs(spark, sf_dir), "lang")))


THRESHOLDS = [0.5 + 0.05 * i for i in range(10)]


@query(f"WITH {LABELLED}, m AS (SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (n_chars % 101) / 100.0::DOUBLE END AS o FROM d), t AS (SELECT o, unnest({[round(t, 2) for t in THRESHOLDS]}::DOUBLE[]) AS threshold FROM m) SELECT threshold, count(*) FILTER (WHERE o >= threshold) AS tp, CAST(sum(CASE WHEN o IS NULL OR o >= threshold THEN 1 ELSE 2 END) AS BIGINT) AS \"union\", round(count(*) FILTER (WHERE o >= threshold) / sum(CASE WHEN o IS NULL OR o >= threshold THEN 1 ELSE 2 END), 6) AS ap FROM t GROUP BY threshold")
def average_precision(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") % 101 / 100.0).alias("overlap"))
    return rounded(scoring.average_precision(rows, [round(t, 2) for t in THRESHOLDS]), 6, "threshold")


@query(f"WITH {LABELLED}, e AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c FROM d WHERE quality = 1), b AS (SELECT CAST(n_chars > a AS INT) + CAST(n_chars > b AS INT) + CAST(n_chars > c AS INT) AS bin, quality = 1 AS t, n_chars >= 500 AS p FROM d, e) SELECT bin, count(*) FILTER (WHERE t) AS truth, round(CASE WHEN count(*) FILTER (WHERE t) > 0 THEN count(*) FILTER (WHERE t AND p) / count(*) FILTER (WHERE t) END, 4) AS recall, count(*) FILTER (WHERE p) AS pred, round(CASE WHEN count(*) FILTER (WHERE p) > 0 THEN count(*) FILTER (WHERE t AND p) / count(*) FILTER (WHERE p) END, 4) AS precision FROM b GROUP BY bin")
def breakdown_by_quartile(spark, sf_dir):
    rows = scored_docs(spark, sf_dir)
    edges = list(scoring.quartile_edges(rows.where("truth"), "n_chars").first())
    side = lambda s, c: rows.where(c).select(F.lit(s).alias("side"), "n_chars", (F.col("truth") & F.col("predicted")).alias("matched"))
    return scoring.breakdown(side("truth", "truth").unionByName(side("pred", "predicted")), "n_chars", edges)


@query("SELECT quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders")
def quartile_edges(spark, sf_dir):
    return scoring.quartile_edges(table(spark, sf_dir, "orders"), "o_totalprice")


@query(f"WITH {LABELLED}, c AS (SELECT source, count(*) AS n FROM d WHERE (quality = 1) <> (n_chars >= 500) GROUP BY source) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_errors, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, source LIMIT 5)) / sum(n), 6) AS top_share FROM c")
def error_concentration(spark, sf_dir):
    rows = scored_docs(spark, sf_dir)
    return rounded(scoring.error_concentration(rows.where(F.col("truth") != F.col("predicted")), "source"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return grouping.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT sha256(text) AS unit, count(DISTINCT source) AS n_groups FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def split_straddle_guard(spark, sf_dir):
    return grouping.straddling(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("unit"), "source"), "unit", "source")


@query("SELECT doc_id, lang FROM documents WHERE source NOT IN ('src0', 'src3')")
def heldout_contamination(spark, sf_dir):
    never = spark.createDataFrame([("src0",), ("src3",)], "source string")
    return grouping.held_out(table(spark, sf_dir, "documents"), never, "source").select("doc_id", "lang")


@query("SELECT source AS split, count(DISTINCT lang) AS n_units, count(*) AS n_rows FROM documents GROUP BY source")
def split_summary(spark, sf_dir):
    return grouping.split_summary(table(spark, sf_dir, "documents").withColumnRenamed("source", "split"), "split", "lang")


@query("WITH RECURSIVE up(node, depth) AS (SELECT max(doc_id), 0 FROM documents UNION ALL SELECT e.parent, depth + 1 FROM up JOIN (SELECT doc_id AS child, doc_id // 2 AS parent FROM documents WHERE doc_id > 0) e ON e.child = node) SELECT node, min(depth) AS depth FROM up GROUP BY node")
def lineage(spark, sf_dir):
    """All ancestors of the newest document, where each comes from the one of half its number."""
    docs = table(spark, sf_dir, "documents")
    edges = docs.where("doc_id > 0").select(F.col("doc_id").alias("child"), F.expr("doc_id div 2").alias("parent"))
    return grouping.lineage(edges, docs.agg(F.max("doc_id").alias("node")))


def _same_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"), F.md5(F.concat_ws("|", "source", "lang", F.expr("n_chars div 8"))).alias("m"))
    star = lambda c: d.groupBy(c).agg(F.min("doc_id").alias("a")).join(d.hint("merge"), c).select("a", F.col("doc_id").alias("b")).where("a < b")
    return star("k").unionByName(star("m"))


@query("""WITH RECURSIVE k AS (SELECT doc_id, md5(text) AS k, source || '|' || lang || '|' || (n_chars // 8) AS m FROM documents),
e AS (SELECT min(doc_id) OVER (PARTITION BY k) AS a, doc_id AS b FROM k UNION SELECT min(doc_id) OVER (PARTITION BY m), doc_id FROM k), u AS (SELECT a, b FROM e WHERE a < b UNION SELECT b, a FROM e WHERE a < b),
reach(node, hit) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.hit)
SELECT node, min(hit) AS root FROM reach GROUP BY node""")
def components(spark, sf_dir):
    return grouping.components(_same_text(spark, sf_dir))


COS_SQL = "p AS (SELECT a.label AS block, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::DOUBLE * z::DOUBLE)))) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id), q AS (SELECT * FROM p WHERE cosine >= 0.3)"


@query(f"WITH {COS_SQL} SELECT block, a, b, {r('cosine')} FROM q")
def cosine_pairs(spark, sf_dir):
    return rounded(similarity.cosine_pairs(table(spark, sf_dir, "embeddings"), "label", 0.3))


@query(f"WITH {COS_SQL}, s AS (SELECT a AS id, b AS partner, cosine FROM q UNION ALL SELECT b, a, cosine FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, partner) AS k FROM s) SELECT id, partner, {r('cosine')} FROM k WHERE k = 1")
def nearest_pair(spark, sf_dir):
    return rounded(similarity.nearest_pairs(table(spark, sf_dir, "embeddings"), "label", 0.3))


@query(f"WITH {COS_SQL.replace('0.3', '0.5')}, c AS (SELECT id FROM (SELECT a AS id FROM q UNION ALL SELECT b FROM q) GROUP BY id HAVING count(*) = 1) SELECT block, a, b, {r('cosine')} FROM q WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)")
def mutual_unique_pairs(spark, sf_dir):
    return rounded(similarity.mutual_unique_pairs(table(spark, sf_dir, "embeddings"), "label", 0.5))


@query("SELECT label, CAST(k - 1 AS INTEGER) AS k, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var_pop, round(var_samp(x), 6) AS var_samp FROM (SELECT label, unnest(generate_series(1, len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, k")
def centroid_covariance(spark, sf_dir):
    return rounded(similarity.centroids(table(spark, sf_dir, "embeddings"), "label"))


TURN_SQL = "c AS (SELECT conv_id, turn, role, turn % 3 = 0 AS l FROM conversations), b AS (SELECT *, max(CASE WHEN l THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(CASE WHEN l THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM c)"


def _turns(spark, sf_dir):
    return brackets.brackets(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("turn") % 3 == 0, 3)


@query(f"WITH {TURN_SQL} SELECT conv_id, turn, before, after, round(CAST(turn - before AS DOUBLE) / (after - before), 6) AS fraction, CASE WHEN before IS NULL THEN 'first labelled time' WHEN after IS NULL THEN 'last labelled time' WHEN after - before > 3 THEN 'bracket too long' ELSE '' END AS why FROM b")
def bracket_fraction(spark, sf_dir):
    return rounded(_turns(spark, sf_dir).select("conv_id", "turn", "before", "after", "fraction", "why"))


@query(f"WITH {TURN_SQL} SELECT conv_id, turn, role FROM b WHERE NOT l AND before IS NOT NULL AND after IS NOT NULL AND after - before <= 3")
def unlabelled_between_labelled(spark, sf_dir):
    return _turns(spark, sf_dir).where("ok and turn % 3 <> 0").select("conv_id", "turn", "role")


@query(r"WITH t AS (SELECT page_id, string_split(regexp_replace(coalesce(nullif(regexp_extract(url, '[?]([^#]*)', 1), ''), 'none'), '&', chr(10), 'g'), chr(10)) AS l FROM pages), x AS (SELECT page_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS line FROM t), m AS (SELECT page_id, pos, regexp_extract(line, '^\s*([A-Za-z0-9_ .#()\-]+?)\s*=\s*(.+?)\s*$', 1) AS name, regexp_extract(line, '^\s*([A-Za-z0-9_ .#()\-]+?)\s*=\s*(.+?)\s*$', 2) AS value FROM x WHERE regexp_matches(line, '^\s*([A-Za-z0-9_ .#()\-]+?)\s*=\s*(.+?)\s*$')) SELECT page_id, name, arg_min(value, pos) AS value FROM m GROUP BY page_id, name")
def metadata_key_values(spark, sf_dir):
    block = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract("url", r"[?]([^#]*)", 1), F.lit("")), F.lit("none")), "&", "\n")
    return metadata.settings(table(spark, sf_dir, "pages").select("page_id", block.alias("block")), "page_id", "block")


UNITS = ["µm", "um", "micron", "nm", "mm", "cm", "m", "inch", "s", "sec", "ms", "min", "h", "hr", "us"]


@query(f"SELECT u AS unit, CASE u WHEN 'µm' THEN 1.0 WHEN 'um' THEN 1.0 WHEN 'micron' THEN 1.0 WHEN 'nm' THEN 0.001 WHEN 'mm' THEN 1000.0 WHEN 'cm' THEN 10000.0 WHEN 'm' THEN 1000000.0 END::DOUBLE AS um, round(CASE u WHEN 's' THEN 1.0::DOUBLE / 60 WHEN 'sec' THEN 1.0::DOUBLE / 60 WHEN 'ms' THEN 1.0::DOUBLE / 60000 WHEN 'min' THEN 1 WHEN 'h' THEN 60 WHEN 'hr' THEN 60 WHEN 'us' THEN 1.0::DOUBLE / 60000000 END::DOUBLE, 12) AS minutes FROM (SELECT unnest({UNITS}) AS u)")
def unit_conversion(spark, sf_dir):
    rows = spark.createDataFrame([(u,) for u in UNITS], "unit string")
    return rows.select("unit", precision.um_per_unit(F.col("unit")).alias("um"), F.round(precision.min_per_unit(F.col("unit")), 12).alias("minutes"))


@query("WITH l AS (SELECT conv_id, list(CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'untitled' ELSE 't:' || (turn + 3) || '/' || (turn + 40) || ' - ' || role END ORDER BY turn) AS labels FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN list_bool_and(list_transform(labels, lambda x: regexp_matches(x, 't:[0-9]+/[0-9]+'))) THEN array_to_string(list_transform(labels, lambda x: regexp_extract(x, 't:([0-9]+)/', 1)), ';') END AS frames, CAST(nullif(regexp_extract(labels[-1], '/([0-9]+)', 1), '') AS INTEGER) AS total FROM l")
def source_frame_labels(spark, sf_dir):
    label = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), "untitled").otherwise(F.concat(F.lit("t:"), (F.col("turn") + 3).cast("string"), F.lit("/"), (F.col("turn") + 40).cast("string"), F.lit(" - "), F.col("role")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", label.alias("label")))), lambda x: x["label"]).alias("labels"))
    return rows.select("conv_id", F.array_join(metadata.source_frames(F.col("labels")).cast("array<string>"), ";").alias("frames"), metadata.frame_total(F.col("labels")).alias("total"))


@query("WITH m AS (SELECT *, median(l_extendedprice) OVER (PARTITION BY l_suppkey) AS mid FROM lineitem), s AS (SELECT l_suppkey, any_value(mid) AS mid, 1.4826::DOUBLE * median(abs(l_extendedprice - mid)) AS sigma FROM m GROUP BY l_suppkey) SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, round(s.mid, 6) AS median, round(s.sigma, 4) AS sigma FROM lineitem l JOIN s USING (l_suppkey) WHERE s.sigma > 0 AND abs(l.l_extendedprice - s.mid) > 1.5 * s.sigma")
def robust_mad_outliers(spark, sf_dir):
    out = robust.outliers(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice", 1.5)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", F.round("median", 6).alias("median"), F.round("sigma", 4).alias("sigma"))


@query("WITH p AS (SELECT source AS name, (1 + count(*) FILTER (WHERE n_chars > 2000)) / (1000.0::DOUBLE + count(*)) AS p FROM documents GROUP BY source), k AS (SELECT *, row_number() OVER (ORDER BY p, name) - 1 AS i, count(*) OVER () AS m FROM p) SELECT name, round(p, 9) AS p, round(max(least(1.0, (m - i) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS p_adjusted FROM k")
def holm_adjust(spark, sf_dir):
    tests = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(((1 + F.count_if(F.col("n_chars") > 2000)) / (1000.0 + F.count("*"))).alias("p"))
    return rounded(inference.holm(tests), 9)


@query("WITH k AS (SELECT source, abs(n_chars - 1000.0::DOUBLE) AS a, row_number() OVER (PARTITION BY source ORDER BY abs(n_chars - 1000.0::DOUBLE)) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, coalesce(max(CASE WHEN k = ceil((n + 1) * 0.9::DOUBLE) THEN a END), 'infinity'::DOUBLE) AS quantile, any_value(n) AS n FROM k GROUP BY source")
def conformal_quantile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", (F.col("n_chars") - 1000.0).alias("residual"))
    return inference.conformal_quantile(rows, "source", 0.1)


@query("SELECT d.source, (1 + count(*) FILTER (WHERE d.n_chars >= o.observed - 1e-9 * greatest(1.0, abs(o.observed)))) / (count(*) + 1) AS p, count(*) AS n_null FROM documents d JOIN (SELECT source, avg(n_chars) AS observed FROM documents GROUP BY source) o USING (source) GROUP BY d.source")
def permutation_p(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("n_chars").cast("double").alias("score"))
    return inference.permutation_p(d, d.groupBy("source").agg(F.avg("score").alias("score")), "source")


@query("SELECT o_orderpriority AS fold, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(CASE WHEN y BETWEEN p - 100000 AND p + 100000 THEN 1.0 ELSE 0 END), 6) AS coverage, 200000.0::DOUBLE AS width FROM (SELECT o_orderpriority, o_totalprice::DOUBLE AS y, 150000.0::DOUBLE + o_custkey AS p FROM orders) GROUP BY 1")
def regression_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("fold"), F.col("o_totalprice").cast("double").alias("y"), (150000.0 + F.col("o_custkey")).alias("pred"))
    out = inference.regression_scores(rows.withColumns({"low": F.col("pred") - 100000, "high": F.col("pred") + 100000}), "fold")
    return out.select("fold", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("coverage", 6).alias("coverage"), F.round("width", 4).alias("width"))


@query(f"WITH {LABELLED}, s AS (SELECT avg(CASE WHEN quality = 1 THEN CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0 END END) AS sensitivity, avg(CASE WHEN quality <> 1 THEN CASE WHEN n_chars < 500 THEN 1.0 ELSE 0 END END) AS specificity, avg(CASE WHEN (quality = 1) = (n_chars >= 500) THEN 1.0 ELSE 0 END) AS accuracy FROM d) SELECT round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(accuracy, 6) AS accuracy, round((sensitivity + specificity) / 2, 6) AS balanced_accuracy FROM s")
def classification_metrics(spark, sf_dir):
    return rounded(inference.classification_scores(scored_docs(spark, sf_dir)))


@query(f"""{WITH_KIN}, b AS (SELECT *, sum(CASE WHEN source <> 'primary' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame) AS bo FROM kin), n AS (SELECT *, unnest([1, 3, 6]) AS horizon FROM b)
SELECT n.track_id, n.frame, n.horizon, round(sqrt((t.x_px - n.x_px) * (t.x_px - n.x_px) + (t.y_px - n.y_px) * (t.y_px - n.y_px)) * 0.5, 6) AS disp_um, round((t.cumulative_path_px - n.cumulative_path_px) * 0.5 / n.horizon, 6) AS speed_um_per_hr,
       sqrt((t.x_px - n.x_px) * (t.x_px - n.x_px) + (t.y_px - n.y_px) * (t.y_px - n.y_px)) * 0.5 / n.horizon >= 6.0 AS migrating, t.observation_index - n.observation_index < n.horizon AS target_gap, t.bo > n.bo AS target_recovered
FROM n LEFT JOIN b t ON t.track_id = n.track_id AND t.frame = n.frame + n.horizon""")
def horizon_targets(spark, sf_dir):
    return rounded(targets.horizon_targets(obs(spark, sf_dir), SCALE))


@query(f"""{WITH_KIN}, h AS (SELECT *, coalesce(lag(x_px, 3) OVER w, lag(x_px, 2) OVER w, lag(x_px) OVER w) AS bx, coalesce(lag(y_px, 3) OVER w, lag(y_px, 2) OVER w, lag(y_px) OVER w) AS b_y, coalesce(lag(frame, 3) OVER w, lag(frame, 2) OVER w, lag(frame) OVER w) AS bf,
  avg(speed_um_per_hr) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hist_mean FROM kin WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, round(speed_um_per_hr, 6) AS hist_speed_last, {r('hist_mean')}, round(sqrt((x_px - bx) * (x_px - bx) + (y_px - b_y) * (y_px - b_y)) * 0.5 / (frame - bf), 6) AS hist_net FROM h WHERE observation_index > 0""")
def motion_history(spark, sf_dir):
    return rounded(targets.motion_history(obs(spark, sf_dir), SCALE))


@query(f"{WITH_OBS} SELECT track_id, frame, round(x_px * 0.6 - y_px * 0.8, 6) AS dx_px, round(x_px * 0.8 + y_px * 0.6, 6) AS dy_px, round(x_px * 60.0, 6) AS implied_speed_um_per_hr FROM obs")
def legacy_upgrade(spark, sf_dir):
    old = obs(spark, sf_dir).select("track_id", "frame", F.col("x_px").alias("along_channel_px"), F.col("y_px").alias("across_channel_px"), F.col("x_px").alias("implied_speed_um_per_min"))
    return rounded(legacy.upgrade_unlinked(old, 0.6, 0.8).select("track_id", "frame", "dx_px", "dy_px", "implied_speed_um_per_hr"))


@query("WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) SELECT o_custkey, o_orderkey, CAST(k - 1 AS INTEGER) AS observation_index, round(o_totalprice - p, 2) AS step FROM o")
def order_trajectories(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return rows.select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("observation_index"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("step"))


@query("SELECT n_name, c_custkey, spent, place FROM (SELECT n.n_name, c.c_custkey, CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spent, CAST(row_number() OVER (PARTITION BY n.n_name ORDER BY sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) DESC, c.c_custkey) AS INTEGER) AS place FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name, c.c_custkey) WHERE place <= 3")
def segment_topk(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    spent = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("spent"))
    rows = spent.join(c.select("c_custkey", "c_nationkey"), "c_custkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return similarity.top_by(rows.select("n_name", "c_custkey", "spent"), "n_name", [F.desc("spent"), F.col("c_custkey")], 3)


@query("SELECT tumbling, event_type, n FROM (SELECT date_trunc('hour', ts) AS tumbling, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def events_tumbling(spark, sf_dir):
    from ..streaming.windows import tumbling_counts

    return tumbling_counts(table(spark, sf_dir, "events"), "1 hour").select(F.col("start").alias("tumbling"), "event_type", "n")


@query("WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, k")
def activity_sessions(spark, sf_dir):
    from ..streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), 4 * 3600)
