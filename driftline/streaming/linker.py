"""The frame-by-frame linker as a stateful stream: one key per movie, frames in order.

Gap closing looks at whole tracks and stays a batch step (operators.linking).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.linking import COST, Linker, LinkSettings, table
from ..schema import Scale

LINKED = "movie bigint, track_id int, frame int, label int, x double, y double, match_cost double"


def link_stream(detections: DataFrame, scale: Scale, settings: LinkSettings = LinkSettings(close_gaps=False), late: str = "error", n_frames: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Detections (movie and the columns of a detection), arriving frame by frame, to linked ones.

    A movie's state is its live tracks only: one that was not seen for the gap limit
    is dropped, so state does not grow with the stream, and with ``idle_ms`` a movie
    without rows for so many milliseconds is let go whole. A detection of a frame that was linked already is an
    error that ends the query; with ``late`` "report" it comes out without a track,
    as does one of a frame before 0 or from ``n_frames`` on, so that they can be
    counted.
    """
    if late not in ("error", "report"):
        raise ValueError(f"late must be error or report, not {late}")
    columns = [c.split()[0] for c in LINKED.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        linker, last = pickle.loads(state.get[0]) if state.exists else (Linker(scale, settings, margins=False), -1)
        pdf = pd.concat(list(batches)).sort_values(["frame", "label"])
        outside = (pdf["frame"] < 0) | (pdf["frame"] >= (n_frames if n_frames is not None else float("inf")))
        behind = ~outside & (pdf["frame"] <= last)
        if late == "error" and behind.any():
            raise ValueError(f"movie {key[0]}: frame {int(pdf.loc[behind, 'frame'].iloc[0])} came after frame {last}")
        unlinked = pdf[outside | behind]
        out = [(key[0], None, int(r.frame), r.label, r.x, r.y, None) for r in unlinked.itertuples()]
        for frame, rows in pdf[~(outside | behind)].groupby("frame"):
            found, label = table([rows])
            last = int(frame)
            track, evidence = linker.step(last, found)
            out += zip(repeat(key[0]), track.tolist(), repeat(last), label, found["x"], found["y"], evidence[:, COST])
            linker.closed, linker.events, linker.flags = [], {}, {}
        state.update((pickle.dumps((linker, last)),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns).astype({"track_id": "Int32"})

    return detections.groupBy("movie").applyInPandasWithState(run, LINKED, "state binary", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
