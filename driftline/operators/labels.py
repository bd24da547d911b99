"""Label images from several passes in one: the first claim on a pixel stands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _pieces(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Number of the 8-connected piece of each pixel: labels fall to the least of their neighbours until none changes."""
    place = {p: k for k, p in enumerate(zip(y.tolist(), x.tolist(), strict=True))}
    a, b = zip(*[(k, place[q]) for (py, px), k in place.items() for q in ((py, px + 1), (py + 1, px - 1), (py + 1, px), (py + 1, px + 1)) if q in place], strict=True) if len(place) > 1 else ((), ())
    a, b = np.array(a, dtype=int), np.array(b, dtype=int)
    label = np.arange(len(y))
    while len(a):
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low), np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def merge_passes(pixels: DataFrame, most_overlap: float = 0.3, least_piece: int = 20) -> DataFrame:
    """Pixels (frame, pass_no, label, y, x) of several passes as one label image: frame, y, x, label, pass_no.

    Objects come by pass and label. One of which more than ``most_overlap`` is taken
    already is the same cell seen again; one that is merely clipped keeps the largest
    piece of what is free, if that has ``least_piece`` pixels. Labels are new, from 1.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[tuple[int, int]] = set()
        out = []
        for (number, _), g in pdf.sort_values(["pass_no", "label", "y", "x"]).groupby(["pass_no", "label"]):
            at = list(zip(g["y"].tolist(), g["x"].tolist(), strict=True))
            free = [p for p in at if p not in taken]
            if len(at) - len(free) > most_overlap * len(at):
                continue
            if len(free) < len(at):
                y, x = np.array(free).T
                piece = _pieces(y, x)
                largest = int(np.bincount(piece).argmax())
                free = [p for p, k in zip(free, piece.tolist(), strict=True) if k == largest]
                if len(free) < least_piece:
                    continue
            taken.update(free)
            out.append((free, int(number)))
        rows = [(pdf["frame"].iloc[0], y, x, k, number) for k, (some, number) in enumerate(out, 1) for y, x in some]
        return pd.DataFrame(rows, columns=["frame", "y", "x", "label", "pass_no"])

    return pixels.groupBy("frame").applyInPandas(run, "frame int, y int, x int, label int, pass_no int")
