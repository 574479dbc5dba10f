"""Leading eigenvectors of large symmetric operators by block Lanczos.

An operator is S - g g', where S is a sparse symmetric matrix of entries and g the
indicator of its members: what is subtracted everywhere is never stored. All
keys (regions) are solved together. The Krylov basis is an array column by bin, so a
step is one product with the entries and one pass for the inner products; only
matrices as wide as the basis reach the driver.

Each new block is orthogonalised against the whole basis, and the inner products of
the basis are measured and not assumed, so Ritz values come from a generalised
problem and lost orthogonality does no harm. A full basis is replaced by its
best Ritz vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import BROADCAST_ROWS
from ..sources.workspace import Kept

BLOCK, BASIS, STEPS, TOL, NOISE, KEYS_AT_ONCE, TASKS = 16, 256, 60, 1e-7, 1e-13, 256, 64


@dataclass
class Small:
    """One key's side of the iteration: inner products of its basis, its projected operator and the next map."""

    size: int
    gram: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    projected: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0))
    turn: np.ndarray = None  # of the basis, before the new block
    take: np.ndarray = None  # what the new block takes off the raw one
    scale: np.ndarray = None
    shift: np.ndarray = None  # sums of the new block
    done: bool = False
    values: np.ndarray = None
    mix: np.ndarray = None  # of the basis as it is, into the vectors
    later: np.ndarray = None  # of the basis after the turn

    def measured(self, inner: np.ndarray, width: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes in the inner products of (basis, raw block, ones) with (last block, raw block)."""
        last = slice(width - block, width) if width else slice(0, 0)
        own, raw = inner[:, :block], inner[:, block:]
        if width:
            self.gram[:, last] = own[:width]
            self.gram[last, :] = own[:width].T
            self.projected[:, last] = raw[:width]
            self.projected[last, :] = raw[:width].T
            self.sums[last] = own[-1]
        return raw[:width], raw[width : width + block], raw[-1]

    def step(self, inner: np.ndarray, width: int, block: int, n: int, tol: float, room: bool) -> None:
        """Plans the next block, or finds the leading values and how the basis makes their vectors."""
        with_basis, with_raw, raw_sums = self.measured(inner, width, block)
        used = np.flatnonzero(np.diag(self.gram) > 0.25)  # blocks that ran out hold zero columns
        take = np.zeros((width, block))
        theta, ritz = np.zeros(0), np.zeros((width, 0))
        if len(used):
            g, h = self.gram[np.ix_(used, used)], self.projected[np.ix_(used, used)]
            half = np.linalg.cholesky(g)
            inverse = np.linalg.inv(half)
            take[used] = inverse.T @ (inverse @ with_basis[used])
            theta, y = np.linalg.eigh(inverse @ ((h + h.T) / 2) @ inverse.T)
            order = np.argsort(-np.abs(theta), kind="stable")
            theta = theta[order]
            ritz = np.zeros((width, len(used)))
            ritz[used] = (inverse.T @ y)[:, order]
        rest = with_raw - take.T @ with_basis - with_basis.T @ take + take.T @ self.gram @ take
        power, turn = np.linalg.eigh((rest + rest.T) / 2)
        keep = power > NOISE * max(1e-300, float(np.trace(with_raw)))
        if len(used):
            tail = ritz[width - block :, :n]
            error = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", tail, rest, tail), 0)) if width else np.full(n, np.inf)
            settled = len(theta) >= n and np.all(error <= tol * np.maximum(np.abs(theta[:n]), 1e-300))
            self.mix = self.later if self.done else ritz[:, :n]
            if not self.done:
                self.done, self.values = bool(settled or not keep.any() or len(used) >= self.size), theta[:n]
        else:
            self.done = not keep.any()
        scale = np.zeros((block, block))
        scale[:, keep] = turn[:, keep] / np.sqrt(power[keep])
        if self.done:
            scale[:] = 0
        kept = np.eye(width) if room else np.pad(ritz[:, : 2 * block], ((0, 0), (0, max(0, 2 * block - ritz.shape[1]))))
        self.turn, self.take, self.scale = kept, take, scale
        self.shift = (raw_sums - self.sums @ take) @ scale
        wide = kept.shape[1] + block
        if self.mix is not None:
            found = self.mix.shape[1]
            if not room:
                self.turn[:, :found] = self.mix
            self.later = np.eye(wide, found) if not room else np.pad(self.mix, ((0, wide - width), (0, 0)))
        gram, projected = np.zeros((wide, wide)), np.zeros((wide, wide))
        gram[:-block, :-block], projected[:-block, :-block] = self.turn.T @ self.gram @ self.turn, self.turn.T @ self.projected @ self.turn
        self.gram, self.projected, self.sums = gram, projected, np.r_[self.sums @ self.turn, self.shift]


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _inner(table: DataFrame, width: int, block: int) -> DataFrame:
    """(key, at, x): inner products of (basis, raw block, ones) with (last block, raw block), summed where they lie."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _lists(batch.column("w"))
            basis = _lists(batch.column("v")) if width else np.zeros((batch.num_rows, 0))
            left = np.hstack([basis, raw, np.ones((len(raw), 1))])
            right = np.hstack([basis[:, width - block :] if width else np.zeros((len(raw), block)), raw])
            codes = batch.column("key").dictionary_encode()
            of = codes.indices.to_numpy()
            for c, key in enumerate(codes.dictionary.to_pylist()):
                mine = of == c
                held[key] = held.get(key, 0) + left[mine].T @ right[mine]
        for key, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * x.size), pa.array(np.arange(x.size)), pa.array(x.ravel())], ["key", "at", "x"])

    return table.coalesce(TASKS).mapInArrow(run, "key string, at long, x double").groupBy("key", "at").agg(F.sum("x").alias("x"))


def _next(table: DataFrame, plans: dict[str, tuple], width: int) -> DataFrame:
    """(key, bin_id, v): the basis turned, with the new block."""

    def run(batches):
        for batch in batches:
            raw = _lists(batch.column("w"))
            basis = _lists(batch.column("v")) if width else np.zeros((batch.num_rows, 0))
            codes = batch.column("key").dictionary_encode()
            of = codes.indices.to_numpy() if batch.num_rows else np.zeros(0, int)
            out = None
            for c, key in enumerate(codes.dictionary.to_pylist()):
                turn, take, scale = plans[key]
                mine = of == c
                new = np.hstack([basis[mine] @ turn, (raw[mine] - basis[mine] @ take) @ scale])
                out = np.zeros((batch.num_rows, new.shape[1])) if out is None else out
                out[mine] = new
            if out is not None:
                offsets = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("bin_id"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["key", "bin_id", "v"])

    return table.mapInArrow(run, "key string, bin_id long, v array<double>")


def product(entries: DataFrame, block: DataFrame, width: int, rows: int) -> DataFrame:
    """(key, bin_id, y): the products of upper-triangle entries (key, i, j, s) with the columns of x (key, bin_id, x)."""
    hint = F.broadcast if rows * (width + 2) <= 4 * BROADCAST_ROWS else (lambda df: df)
    a, b = (hint(block.select("key", F.col("bin_id").alias(k), F.col("x").alias(f"x{k}"))) for k in "ij")
    met = entries.join(a, ["key", "i"]).join(b, ["key", "j"])
    side = lambda own, other, s: F.struct(F.col(own).alias("bin_id"), *((s * F.col(f"x{other}")[k]).alias(f"y{k}") for k in range(width)))
    s = F.col("s")
    sides = met.select("key", F.explode(F.array(side("i", "j", s), side("j", "i", F.when(F.col("i") == F.col("j"), 0.0).otherwise(s)))).alias("e"))
    sums = sides.groupBy("key", F.col("e.bin_id").alias("bin_id")).agg(*(F.sum(f"e.y{k}").alias(f"y{k}") for k in range(width)))
    return sums.select("key", "bin_id", F.array(*(f"y{k}" for k in range(width))).alias("y"))


def leading(entries: DataFrame, members: DataFrame, n: int, *, block: int = BLOCK, basis: int = BASIS, steps: int = STEPS, tol: float = TOL) -> tuple[dict[str, np.ndarray], DataFrame]:
    """The n eigenvalues of largest magnitude by key, and (key, bin_id, v) with their unit vectors in that order.

    entries (key, i, j, s) with i <= j hold S, members (key, bin_id) the bins of g.
    A key of too few members, or of rank below n, has fewer values. It ends with the best vectors so
    far after so many steps; ``residuals`` says how good they are.
    """
    spark = entries.sparkSession
    kept = Kept(spark)
    entries, members = kept.table(entries.select("key", "i", "j", "s")), kept.table(members.select("key", "bin_id"))
    sizes = {r.key: r.n for r in members.groupBy("key").agg(F.count("*").alias("n")).collect()}  # a row a key
    if len(sizes) > KEYS_AT_ONCE:
        raise ValueError(f"{len(sizes)} regions are too many at once; solve them in parts of {KEYS_AT_ONCE}")
    rows, block = sum(sizes.values()), max(block, n)
    basis = max(basis, 4 * block)
    solved = {key: Small(size) for key, size in sizes.items()}
    start = F.array(*((F.xxhash64("bin_id", F.lit(k)) / 2.0**63) for k in range(block)))
    table, width = kept.table(members.select("key", "bin_id", F.array().cast("array<double>").alias("v"), start.alias("w"))), 0
    for turn in range(steps):
        inner = {key: np.zeros((width + block + 1, 2 * block)) for key in sizes}
        for r in _inner(table, width, block).collect():  # a few thousand numbers a key
            inner[r.key].flat[r["at"]] = r.x
        room = width + block <= basis
        for key, small in solved.items():
            small.step(inner[key], width, block, n, tol, room)
        if all(s.done for s in solved.values()) or turn == steps - 1:
            break
        plans = {key: (s.turn, s.take, s.scale) for key, s in solved.items()}
        grown = _next(table, plans, width)
        width = (width if room else 2 * block) + block
        new = grown.select("key", "bin_id", F.slice("v", width - block + 1, block).alias("x"))
        shifts = spark.createDataFrame([(key, s.shift.tolist()) for key, s in solved.items()], "key string, shift array<double>")
        y = product(entries, new, block, rows)
        w = F.array(*(F.coalesce(F.col("y")[k], F.lit(0.0)) - F.col("shift")[k] for k in range(block)))
        before, table = table, kept.table(grown.join(y, ["key", "bin_id"], "left").join(F.broadcast(shifts), "key").select("key", "bin_id", "v", w.alias("w")))
        kept.drop(before)
    for s in solved.values():
        if s.values is None or s.mix is None:
            s.values, s.mix = np.zeros(0), np.zeros((width, 0))
    mixes = {key: (s.mix, np.zeros((width, block)), np.zeros((block, 0))) for key, s in solved.items()}
    padded = {key: (np.pad(m, ((0, 0), (0, n - m.shape[1]))), t, c) for key, (m, t, c) in mixes.items()}
    return {key: s.values for key, s in solved.items()}, kept.table(_next(table, padded, width))


def residuals(entries: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(key, k, eigval, norm, residual) of vectors (key, bin_id, k, eigval, value; k from 1): the length of each, and |M v - eigval v| / |eigval v| by a product of its own."""
    known = found.where("value is not null")
    by_k = F.sort_array(F.collect_list(F.struct("k", "value")))  # n numbers
    x = known.groupBy("key", "bin_id").agg(by_k.alias("e")).where(F.size("e") == n).select("key", "bin_id", F.transform("e", lambda e: e["value"]).alias("x"))
    y = product(entries.select("key", "i", "j", "s"), x, n, x.count())
    totals = known.groupBy("key", "k").agg(F.sum("value").alias("total"))
    each = known.join(y, ["key", "bin_id"], "left").join(F.broadcast(totals), ["key", "k"])
    off = F.coalesce(F.col("y")[F.col("k") - 1], F.lit(0.0)) - F.col("total") - F.col("eigval") * F.col("value")
    sums = each.groupBy("key", "k", "eigval").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.sqrt(F.sum(off * off)).alias("off"))
    return sums.select("key", "k", "eigval", "norm", (F.col("off") / F.abs(F.col("eigval") * F.col("norm"))).alias("residual"))
