"""Exact values at given ranks by counting rounds, for numbers that tasks derive from their rows.

A round divides the bracket of every slot into ``CELLS`` equal cells; tasks count their numbers per cell, with the least and the
largest, and one aggregation adds the counts up. The bracket then shrinks to the cell that holds the wanted rank. No number moves:
a round shuffles at most ``CELLS`` rows a slot and task, whatever the rows, and a value that most rows share is one cell.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1024
COUNTS = "slot int, cell int, n long, mn double, mx double"

# From the batches of a task: a slot, some of its values, and how many rows have each.
Measure = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def _count(batches: Iterator[pa.RecordBatch], measure: Measure, brackets: dict) -> Iterator[pa.RecordBatch]:
    n = {s: np.zeros(CELLS, dtype=np.int64) for s in brackets}
    low = {s: np.full(CELLS, np.inf) for s in brackets}
    high = {s: np.full(CELLS, -np.inf) for s in brackets}
    for slot, values, counts in measure(batches):
        if slot not in brackets:
            continue
        lo, hi = brackets[slot]
        inside = (values >= lo) & (values <= hi)
        v, c = values[inside], counts[inside]
        if not len(v):
            continue
        if np.isfinite(lo) and hi > lo:
            # Halves of the width, so that it does not overflow; the cell never falls as the value grows.
            cell = np.minimum((v / 2 - lo / 2) / (hi / 2 - lo / 2) * CELLS, CELLS - 1).astype(np.int64)
        else:
            cell = np.zeros(len(v), dtype=np.int64)
        n[slot] += np.bincount(cell, weights=c, minlength=CELLS).astype(np.int64)
        np.minimum.at(low[slot], cell, v)
        np.maximum.at(high[slot], cell, v)
    for s in brackets:
        at = np.flatnonzero(n[s])
        if len(at):
            yield pa.record_batch([pa.array(np.full(len(at), s, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(n[s][at]),
                                   pa.array(low[s][at]), pa.array(high[s][at])], names=["slot", "cell", "n", "mn", "mx"])


def quantiles_of(rows: DataFrame, measure: Measure, slots: list[int], prob: float,
                 within: dict[int, tuple[float, float]] | None = None) -> dict[int, float]:
    """The ``prob`` quantile (linear interpolation, as ``percentile``) of the numbers that ``measure`` derives from the Arrow batches
    of ``rows``, for every slot that has any.

    The numbers must be finite, and the same whenever a task runs again. ``within`` are bounds that no number of a slot exceeds, if they
    are known: they save the round that would find them. The driver holds ``CELLS`` rows a slot.
    """
    brackets = dict(within) if within is not None else dict.fromkeys(slots, (-np.inf, np.inf))
    below, wanted, out = dict.fromkeys(slots, 0), {}, {}
    while brackets:
        held = dict(brackets)
        counted = rows.mapInArrow(lambda b, held=held: _count(b, measure, held), COUNTS).groupBy("slot", "cell").agg(
            F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
        found = counted.toPandas().sort_values(["slot", "cell"])
        of, n, mn, mx = (found[c].to_numpy() for c in ("slot", "n", "mn", "mx"))
        for s in held:
            a, b = np.searchsorted(of, [s, s + 1])
            if a == b:  # no number at all: told by the first round
                del brackets[s]
                continue
            upto = below[s] + n[a:b].cumsum()
            wanted.setdefault(s, prob * (int(upto[-1]) - 1))
            first, last = int(np.floor(wanted[s])), int(np.ceil(wanted[s]))
            ends = {}
            for rank in {first, last}:
                k = int(np.searchsorted(upto, rank, side="right"))
                least, most, start = float(mn[a + k]), float(mx[a + k]), int(upto[k] - n[a + k])
                # Only the ends of a cell are known; a rank between them asks for another round in this cell.
                ends[rank] = (least if rank == start or least == most else most if rank == upto[k] - 1 else None, least, most, start)
            open_ = [ends[k] for k in (first, last) if ends[k][0] is None]
            if open_:
                # One rank may be known already: it is an end of the next bracket then, or of a neighbour of it.
                lo, hi = min(e[1] for e in (ends[first], ends[last])), max(e[2] for e in (ends[first], ends[last]))
                brackets[s], below[s] = (lo, hi), ends[first][3]
            else:
                lo, hi = ends[first][0], ends[last][0]
                out[s] = lo if lo == hi else (last - wanted[s]) * lo + (wanted[s] - first) * hi
                del brackets[s]
    return out
