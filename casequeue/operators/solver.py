"""Logistic models of all classes at once, fitted in passes over packed sparse rows.

Rows are packed into blocks of a few hundred, once. A pass over the blocks returns loss and gradient of every class
model at the weights it is sent: a task adds up its rows, cuts its gradient into blocks of features, and
those are added by block. Only weights (features times classes) are on the driver. A step is one pass,
so jobs grow with the number of steps and not with the number of classes.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from casequeue.session import bound_batches

PACKED_ROWS = 512  # of a block at most; batches are bounded by bytes, so blocks of long texts have fewer
GRADIENT_BLOCK = 4_096  # features of a block of the gradient
MEMORY = 5  # steps that shape the next direction
DECREASE = 1e-4  # of the slope that a step has to reach at least
HALVINGS = 25

_PACKED = "labels binary, starts binary, indices binary, vals binary"


@dataclass(frozen=True)
class Balance:
    """Weights of rows by class: a model's own class against the rest.

    A class weighs `n / (K * n_c)` against 1 for the rest. Two classes need one model, the second
    one's, whose sides are both balanced.
    """

    targets: tuple[int, ...]
    own: tuple[float, ...]
    rest: tuple[float, ...]
    rows: int

    @staticmethod
    def of(sizes: dict[str, int]) -> Balance:
        rows, count = sum(sizes.values()), len(sizes)
        even = [rows / (count * n) for n in sizes.values()]
        if count == 2:
            return Balance((1,), (even[1],), (even[0],), rows)
        return Balance(tuple(range(count)), tuple(even), (1.0,) * count, rows)


def pack_rows(vectors: DataFrame) -> DataFrame:
    """Blocks of rows with `label_index, indices, values`."""
    bound_batches(vectors.sparkSession)

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PACKED_ROWS):
                rows = batch.slice(start, PACKED_ROWS)
                labels = rows.column("label_index").to_numpy(zero_copy_only=False).astype(np.int32)
                lists = rows.column("indices")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.concatenate(([0], np.cumsum(sizes)))
                parts = (
                    labels,
                    starts,
                    lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32),
                    rows.column("values").flatten().to_numpy(zero_copy_only=False),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.tobytes()], pa.binary()) for p in parts],
                    names=["labels", "starts", "indices", "vals"],
                )

    return vectors.select("label_index", "indices", "values").mapInArrow(pack, _PACKED)


def loss_and_gradient(labels, starts, indices, values, weights, balance: Balance):
    """Sums over the rows of a block; the last row of `weights` holds the intercepts."""
    n, width = len(labels), weights.shape[1]
    row_of = np.repeat(np.arange(n), np.diff(starts))
    gradient = np.zeros_like(weights)
    loss = np.zeros(width)
    for k in range(width):
        margin = weights[-1, k] + np.bincount(row_of, values * weights[indices, k], n)
        own = labels == balance.targets[k]
        weight = np.where(own, balance.own[k], balance.rest[k])
        loss[k] = (weight * np.logaddexp(0.0, np.where(own, -margin, margin))).sum()
        slope = weight * (0.5 * (1.0 + np.tanh(0.5 * margin)) - own)
        gradient[:-1, k] = np.bincount(indices, values * slope[row_of], len(weights) - 1)
        gradient[-1, k] = slope.sum()
    return loss, gradient


class Objective:
    """Mean weighted logistic loss with a squared penalty on all but the intercepts."""

    def __init__(self, packed: DataFrame, features: int, balance: Balance, alpha: float):
        bound_batches(packed.sparkSession)  # a task holds a few blocks at a time, not all of its own
        self.packed, self.features, self.balance, self.alpha = packed, features, balance, alpha
        self.shape = (features + 1, len(balance.targets))
        self.passes = 0

    def __call__(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss and gradient of each class model at its column of weights."""
        balance, shape = self.balance, self.shape
        sent = self.packed.sparkSession.sparkContext.broadcast(weights)  # features times classes

        def add_rows(batches):
            loss, gradient = np.zeros(shape[1]), np.zeros(shape)
            met = False
            for batch in batches:
                for block in zip(*batch.select(["labels", "starts", "indices", "vals"]).columns, strict=True):
                    met = True
                    labels, starts, indices, values = (x.as_buffer() for x in block)
                    part = loss_and_gradient(
                        np.frombuffer(labels, np.int32),
                        np.frombuffer(starts, np.int64),
                        np.frombuffer(indices, np.int32),
                        np.frombuffer(values, np.float64),
                        sent.value,
                        balance,
                    )
                    loss += part[0]
                    gradient += part[1]
            if met:
                blocks = range(0, shape[0], GRADIENT_BLOCK)
                parts = [loss, *(gradient[b : b + GRADIENT_BLOCK] for b in blocks)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(-1, len(parts) - 1), pa.int32()),
                        pa.array([p.tobytes() for p in parts], pa.binary()),
                    ],
                    names=["block", "sums"],
                )

        def add_blocks(key, table):
            total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("sums"))
            return pa.table({"block": [key[0].as_py()], "sums": [total.tobytes()]}, _BLOCK)

        parts = self.packed.mapInArrow(add_rows, "block int, sums binary")
        sums = parts.groupBy("block").applyInArrow(add_blocks, "block int, sums binary").collect()
        sent.destroy()
        self.passes += 1
        ordered = [np.frombuffer(r["sums"], np.float64) for r in sorted(sums, key=lambda r: r["block"])]
        rows = self.balance.rows
        inner = weights.copy()
        inner[-1] = 0.0
        loss = ordered[0] / rows + 0.5 * self.alpha * (inner**2).sum(axis=0)
        return loss, np.concatenate(ordered[1:]).reshape(shape) / rows + self.alpha * inner


_BLOCK = pa.schema([("block", pa.int32()), ("sums", pa.binary())])


def descend(objective: Objective, steps: int, rate: float) -> np.ndarray:
    """Weights after full-batch steps of one length from zero."""
    weights = np.zeros(objective.shape)
    for _ in range(steps):
        weights = weights - rate * objective(weights)[1]
    return weights


def _direction(gradient: np.ndarray, history) -> np.ndarray:
    """Limited-memory quasi-Newton direction of each column.

    A column's step with too little curvature has `rho` 0 and counts for nothing.
    """
    q = gradient.copy()
    kept = []
    for s, y, rho in reversed(history):
        a = rho * (s * q).sum(axis=0)
        q -= a * y
        kept.append(a)
    if history:
        s, y, rho = history[-1]
        squares = (y * y).sum(axis=0)
        q *= np.where(rho > 0, (s * y).sum(axis=0) / np.where(squares > 0, squares, 1.0), 1.0)
    for (s, y, rho), a in zip(history, reversed(kept), strict=True):
        q += s * (a - rho * (y * q).sum(axis=0))
    return -q


def minimize(objective, iterations: int, tolerance: float) -> np.ndarray:
    """Weights of all class models, each column with a step length and an end of its own.

    A column ends when a step lowers its loss by less than `tolerance` of it.
    """
    weights = np.zeros(objective.shape)
    loss, gradient = objective(weights)
    going = np.ones(objective.shape[1], bool)
    history: deque = deque(maxlen=MEMORY)
    for _ in range(iterations):
        direction = _direction(gradient, history)
        slope = (gradient * direction).sum(axis=0)
        uphill = slope >= 0
        direction = np.where(uphill, -gradient, direction)
        slope = np.where(uphill, -(gradient**2).sum(axis=0), slope)
        length = np.ones(len(loss))
        if not history:
            length = 1.0 / np.maximum(1e-12, np.sqrt((gradient**2).sum(axis=0)))
        trying = going & (slope < 0)
        new_weights, new_loss, new_gradient = weights.copy(), loss.copy(), gradient.copy()
        for _ in range(HALVINGS):
            if not trying.any():
                break
            trial = np.where(trying, weights + length * direction, new_weights)
            at, slopes = objective(trial)
            done = trying & (at <= loss + DECREASE * length * slope)
            new_weights[:, done], new_loss[done] = trial[:, done], at[done]
            new_gradient[:, done] = slopes[:, done]
            trying &= ~done
            length = np.where(trying, length / 2, length)
        moved, turned = new_weights - weights, new_gradient - gradient
        curved = (moved * turned).sum(axis=0)
        usable = curved > 1e-10 * np.sqrt((moved**2).sum(axis=0) * (turned**2).sum(axis=0))
        history.append((moved, turned, np.where(usable, 1.0 / np.where(usable, curved, 1.0), 0.0)))
        going &= loss - new_loss > tolerance * np.maximum(np.abs(new_loss), 1e-12)
        weights, loss, gradient = new_weights, new_loss, new_gradient
        if not going.any():
            break
    return weights
