"""Scores of Arrow batches of vectors stored by (cell, ring) against the questions that can reach them.

A batch is cut into runs of one group, cell and ring. A run's smallest and largest angle to its centroid say which questions'
reach it can lie in; those alone meet its vectors, and a task returns its own k best per question
(:class:`sifter.operators.batch_scores.Best`).
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from sifter.operators.batch_scores import ROWS, Asked, Best, _dense, _floats, group_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARGIN = 2e-6


@dataclass
class Reach:
    """The questions of one group: ``seeds`` holds the questions of every (cell, ring) looked at for the threshold, else ``reach`` is the
    largest angle at which a vector can be among the first k and ``theta`` the threshold (NaN without one)."""
    asked: Asked
    seeds: dict | None = None
    reach: np.ndarray | None = None
    theta: np.ndarray | None = None


class Seeker:
    """One task's vectors of one group."""

    def __init__(self, plan: Reach, units: dict, no_cell: int, k: int):
        self.plan, self.units, self.no_cell, n_q = plan, units, no_cell, len(plan.asked.ids)
        self.best = Best(plan.asked, k)
        if plan.theta is not None:
            self.best.floor = np.where(np.isnan(plan.theta), -np.inf, plan.theta - MARGIN)
        self.visited, self.multiplied = np.zeros(n_q, np.int64), np.zeros(n_q, np.int64)
        self.angles: tuple = (None, None)
        self.q = np.zeros((0, n_q))

    def questions(self, width: int) -> np.ndarray:
        """The question vectors as columns of a matrix."""
        asked = self.plan.asked
        if len(asked.dims) and asked.dims.max() >= width:
            raise ValueError("a question vector is wider than a document's")
        if len(self.q) != width:
            self.q = np.zeros((width, len(asked.ids)))
            self.q[asked.dims, asked.rows] = asked.weights
            self.whole = (self.q == np.rint(self.q)).all()
        return self.q

    def phi(self, cell: int) -> np.ndarray:
        """Every question's angle to a cell's centroid."""
        if self.angles[0] != cell:
            unit = np.asarray(self.units[cell])
            with np.errstate(all="ignore"):
                self.angles = (cell, np.arccos(np.clip(unit @ self.questions(len(unit)) / self.plan.asked.norms, -1.0, 1.0)))
        return self.angles[1]

    def add(self, rows: pa.RecordBatch) -> None:
        cells, rings = rows.column("cell").to_numpy(), rows.column("ring").to_numpy(zero_copy_only=False)
        angle, norm, ids = _floats(rows.column("angle")), _floats(rows.column("vnorm")), rows.column("doc_id")
        empty = rows.column("vec").is_null().to_numpy(zero_copy_only=False)
        dense, sizes = _dense(rows.column("vec"))
        if dense.shape[1] and (sizes[sizes > 0] != dense.shape[1]).any():
            self.questions(int(sizes[sizes > 0].min()))     # raises when a question is wider than the shortest
        whole = (dense == np.rint(dense)).all()
        new = np.append(True, (cells[1:] != cells[:-1]) | (rings[1:] != rings[:-1]))
        starts = np.append(np.nonzero(new)[0], len(cells))
        for lo, hi in zip(starts[:-1], starts[1:]):
            self.run(int(cells[lo]), int(rings[lo]), angle[lo:hi], norm[lo:hi], empty[lo:hi], dense[lo:hi], whole, ids.slice(lo, hi - lo))

    def run(self, cell: int, ring: int, angle, norm, empty, dense, whole: bool, ids: pa.Array) -> None:
        plan, odd = self.plan, np.isnan(norm) & ~empty      # a NaN ranks first, wherever it lies
        if plan.seeds is not None:
            mine, mask = plan.seeds.get((cell, ring)), None
            if mine is None:
                return
        else:
            if cell == self.no_cell:        # vectors without a direction: a right angle away, so to speak
                near = np.full(len(plan.reach), 0.0 if odd.any() else math.pi / 2)
            else:
                phi = self.phi(cell)
                near = np.maximum(0.0, np.maximum(phi - angle.max(), angle.min() - phi))
            mine = np.nonzero((near <= plan.reach) & (plan.asked.norms > 0))[0]
            if len(mine) == 0:
                return
            if cell == self.no_cell:
                mask = (plan.reach[mine] >= math.pi / 2)[None, :] | odd[:, None]
            else:
                mask = np.abs(phi[mine][None, :] - angle[:, None]) <= plan.reach[mine][None, :]
        q = self.questions(dense.shape[1])[:, mine] if dense.shape[1] else np.zeros((0, len(mine)))
        with np.errstate(all="ignore"):
            if whole and (not dense.shape[1] or self.whole):
                dots = dense @ q                            # whole numbers: exact in any order
            else:
                dots = np.zeros((len(dense), len(mine)))    # in dimension order, as the row expression adds
                for d in range(dense.shape[1]):
                    dots += dense[:, d][:, None] * q[d][None, :]
            score = dots / (plan.asked.norms[mine][None, :] * norm[:, None])
        score[norm == 0] = 0.0
        score = np.where(np.isnan(score), np.inf, score)
        score[empty] = -np.inf
        keep = score >= self.best.floor[mine][None, :]
        if mask is not None:
            self.visited[mine] += len(dense)
            self.multiplied[mine] += mask.sum(0)
            keep &= mask
        row, col = np.nonzero(keep)
        if len(row):
            self.best.keep(mine[col], score[row, col], ids.take(pa.array(row)))


def seek(batches, plans: dict, units: dict, no_cell: int, k: int, group: str | None):
    """``group, question ids, document ids, scores, seeker`` of every group among a task's batches."""
    seekers: dict = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for name, rows in group_rows(batch.slice(at, ROWS), group):
                plan = plans.get(name) if name is not None or not group else None    # a null group joins with nothing
                if plan is None:
                    continue
                if name not in seekers:
                    seekers[name] = Seeker(plan, units, no_cell, k)
                seekers[name].add(rows)
    for name, seeker in seekers.items():
        yield name, seeker.best.rows(), seeker


def nearest_parts(asked: Asked, cells: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, rings: np.ndarray,
                  units: dict, no_cell: int, wanted: int):
    """Question and part of the parts nearest to every question, until they hold ``wanted`` vectors."""
    whos, parts = [], []
    order = np.array(sorted(units), dtype=np.int64)
    matrix = np.array([units[c] for c in order]) if len(order) else np.zeros((0, 0))
    real = cells != no_cell
    at = np.searchsorted(order, np.where(real, cells, order[0] if len(order) else 0))
    q = np.zeros((max(matrix.shape[1], int(asked.dims.max()) + 1 if len(asked.dims) else 0), len(asked.ids)))
    q[asked.dims, asked.rows] = asked.weights
    for i in range(len(asked.ids)):
        if not asked.norms[i] > 0 or not len(cells):
            continue
        near, phi = np.full(len(cells), math.pi / 2), np.zeros(len(cells))
        if len(order):
            angle = np.arccos(np.clip(matrix @ q[:matrix.shape[1], i] / asked.norms[i], -1.0, 1.0))
            phi = np.where(real, angle[at], 0.0)
            near = np.where(real, np.maximum(0.0, np.maximum(phi - high, low - phi)), near)
        by = np.lexsort((rings, cells, phi, near))
        found = by[np.cumsum(n[by]) - n[by] < wanted]
        whos.append(np.full(len(found), i))
        parts.append(found)
    none = np.zeros(0, np.int64)
    return (np.concatenate(whos), np.concatenate(parts)) if whos else (none, none)
