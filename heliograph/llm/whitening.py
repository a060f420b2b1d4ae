"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of all vectors are found without forming V: each pass over the stored
vectors gives V Q for a block Q of some 32 columns, as the sum over tasks of (X - mean)'((X - mean) Q). A round puts
Q through a Chebyshev polynomial of V, one pass a degree by its three-term recurrence, which is small on [0, b], the
unwanted part of the spectrum, and grows fast above it; then come a QR factorisation and a Rayleigh-Ritz step. The more
vectors there are, the closer lie the eigenvalues of their noise: the degree follows the distance of the last wanted one
from b, and a block that still converges slowly gets more columns, up to all dimensions. Rounds go on until the residual norms |V q - e q| of all wanted pairs are at rounding level; then the guard columns are drawn
anew and one more round must find no greater eigenvalue that was missed.

Only matrices of dimension times block pass through the driver. Vectors are held as exact whole numbers minus the
floor of their mean, in blocks of about BLOCK_BYTES, so centring loses nothing and a pass decodes few, large rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.session import cut_lineage

SCALE, OFFSET = 1024.0, 100_000
# Scaled entries beyond this are set to it; a double holds whole numbers up to 2**53.
LIMIT = float(1 << 52)
BLOCK_BYTES = 1 << 21
COMPONENTS, GUARD, DEGREE, ROUNDS = 8, 24, 10, 80
# Growth over the unwanted part that a round is to give the last wanted pair, by a degree up to MOST_DEGREE at which the
# first pair grows SPREAD times as much at most.
GROWTH, MOST_DEGREE, SPREAD = 1e3, 40, 1e6
# Slow rounds in a row after which the block has twice the columns, and entries of a block at most.
SLOW_ROUNDS, BLOCK_ENTRIES = 4, 1 << 17
# Residual, relative to the largest eigenvalue, below which a pair is certified; STALLED is taken if it falls no further.
CERTIFIED, STALLED = 2e-14, 1e-11
SEED = 20_240_613
# Arrays of partial sums that one task adds up.
FAN_IN = 64

_LOW = 20  # bits of the lower limb of exact sums


def _blocks(dim: int):
    """Rows (vec_id, x) of one dimension to blocks (ids, x) of bytes; ids as int64 with a flag byte for null."""
    rows = max(1, BLOCK_BYTES // (8 * dim))

    def work(batches):
        for batch in batches:
            ids, x = batch.column(0), batch.column(1)
            for i in range(0, len(ids), rows):
                part, some = x.slice(i, rows), ids.slice(i, rows)
                numbers = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                none = np.asarray(some.is_null())
                kept = some.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.record_batch([pa.array([kept.tobytes()], pa.binary()), pa.array([none.astype(np.uint8).tobytes()], pa.binary()), pa.array([numbers.tobytes()], pa.binary())], ["ids", "none", "x"])

    return work


def _numbers(batch: pa.RecordBatch, dim: int):
    for ids, none, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        yield np.frombuffer(ids, np.int64), np.frombuffer(none, np.uint8).astype(bool), np.frombuffer(x, np.int64).reshape(-1, dim)


def summed(blocks: DataFrame, n_blocks: int, dim: int, function, shape: tuple[int, ...], kind=np.float64) -> np.ndarray:
    """The sum of ``function(x)`` over all blocks. Tasks add up their blocks; of more than FAN_IN blocks a second row of
    tasks adds up what those give, so the driver receives FAN_IN arrays at most."""

    def first(batches):
        total = np.zeros(shape, kind)
        for batch in batches:
            for _, _, x in _numbers(batch, dim):
                total += function(x)
        if total.any():
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])

    def again(batches):
        total = np.zeros(shape, kind)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part, kind).reshape(shape)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = blocks.mapInArrow(first, "total binary")
    if n_blocks > FAN_IN:
        parts = parts.repartition(min(FAN_IN, n_blocks // FAN_IN + 1)).mapInArrow(again, "total binary")
    total = np.zeros(shape, kind)
    for row in sorted(bytes(r.total) for r in parts.collect()):
        total += np.frombuffer(row, kind).reshape(shape)
    return total


def filtered(q: np.ndarray, product, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the operator that is at most one on [low, high], scaled to one at ``top``, on q."""
    half, middle = (high - low) / 2, (high + low) / 2
    first = scale = half / (top - middle)
    before, now = q, (product(q) - middle * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (product(now) - middle * now) * (2 * following / half) - before * (scale * following)
        scale = following
    return now


def _degree(least: float, high: float, top: float) -> tuple[int, float]:
    """The degree of a round, and how much more ``least`` grows by it than what is at or below ``high``."""
    if least <= high:
        return DEGREE, 1.0
    at, first = np.arccosh(2 * least / high - 1), np.arccosh(2 * top / high - 1)
    degree = min(np.arccosh(GROWTH) / at, np.log(SPREAD) / max(first - at, 1e-9), MOST_DEGREE)
    degree = max(DEGREE, int(degree))
    return degree, float(np.cosh(min(degree * at, 700.0)))


def leading(product, dim: int, wanted: int = COMPONENTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, largest relative residual) of a symmetric operator without
    negative eigenvalues, given as ``product`` on blocks. Directions of eigenvalue zero, to rounding, are left out."""
    rng = np.random.default_rng(seed)
    wanted, width = min(wanted, dim), min(dim, wanted + GUARD)
    q, _ = np.linalg.qr(rng.standard_normal((dim, width)))
    narrow, last, sure, probed, growth, slow = 1.0, np.inf, None, False, np.inf, 0
    for _ in range(ROUNDS):
        vq = product(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = values[0]
        if not top > 0:
            return np.empty(0), np.empty((dim, 0)), 0.0
        residual = float(np.sqrt(((vq - q * values)[:, :wanted] ** 2).sum(axis=0)).max() / top)
        done = residual <= CERTIFIED or (residual <= STALLED and residual > last / 4)
        if done or width == dim:
            sure = (values[:wanted], q[:, :wanted], residual) if sure is None or width == dim else sure
        if sure is not None:
            if width == dim or (probed and np.all(values[:wanted] <= sure[0] + 1e-10 * top)):
                keep = sure[0] > 16 * dim * np.finfo(float).eps * top
                return sure[0][keep], sure[1][:, keep], sure[2]
            if probed:
                sure = None  # the probe met a greater eigenvalue
        slow = slow + 1 if residual > last / 10 else 0
        if slow and growth < 2:
            narrow = max(narrow * 0.8, 0.05)
        last = residual
        probed = sure is not None
        if slow >= SLOW_ROUNDS and not probed and dim * min(dim, 2 * width) <= BLOCK_ENTRIES:
            q, _ = np.linalg.qr(np.concatenate([q, rng.standard_normal((dim, min(dim, 2 * width) - width))], axis=1))
            width, narrow, last, growth, slow = q.shape[1], 1.0, np.inf, np.inf, 0
            if width == dim:
                continue
        if probed:
            q = np.concatenate([sure[1], rng.standard_normal((dim, width - wanted))], axis=1)
        high = max(values[-1] * narrow, 1e-8 * top)
        degree, growth = _degree(values[wanted - 1], high, top)
        q, _ = np.linalg.qr(filtered(q, product, 0.0, high, top, degree))
        q, _ = np.linalg.qr(q)
    raise RuntimeError(f"no certified eigenvectors after {ROUNDS} rounds; residual {last}")


def _deviation(x: np.ndarray, rest: np.ndarray, n: int) -> list:
    """The sum over dimensions of (n x - rest)**2, exact; None beyond 38 digits."""
    bound = (int(np.abs(x).max(initial=0)) + 1) * n
    if bound * bound * x.shape[1] < 1 << 62:
        sums = ((x * n - rest) ** 2).sum(axis=1).tolist()
    elif bound < 1 << 51 and x.shape[1] <= 1024:
        d = x * n - rest
        high, low = d >> 26, d & ((1 << 26) - 1)
        # products below 2**52, so sums over a dimension are exact
        limbs = [(a * b).sum(axis=1).astype(object) for a, b in ((high, high), (high, low), (low, low))]
        sums = ((limbs[0] << 52) + (limbs[1] << 27) + limbs[2]).tolist()
    else:
        d = x.astype(object) * n - rest.astype(object)
        sums = (d * d).sum(axis=1).tolist()
    return [str(s) if s < 10**38 else None for s in sums]


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error.

    Each entry c becomes floor(1024 c) + 100000 (entries whose product is beyond 2**52 are set to it). A vector that is
    null, empty or holds null or non-finite entries gives no rows, nor does one whose dimension is not the commonest one
    (of equally common ones the largest). The rest are the fit list, repeated rows each counted. Directions without
    variance are no components, so equal vectors alone give no rows, like an empty table. deviation is null beyond 38
    digits. Columns other than vec_id and embedding are not read; a null vec_id stays null.
    """
    whole = F.col("embedding").cast("array<double>")
    fit = F.coalesce((F.size("embedding") > 0) & F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    bounded = F.transform(whole, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + F.lit(OFFSET).cast("long"))
    rows = cut_lineage(embeddings.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), bounded.alias("x")))
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim, n = int(common.dim), int(common.n)
    blocks = cut_lineage(rows.where(F.size("x") == dim).mapInArrow(_blocks(dim), "ids binary, none binary, x binary"))
    n_blocks = blocks.count()

    limbs = summed(blocks, n_blocks, dim, lambda x: np.stack([(x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0)]), (2, dim), np.int64)
    sums = [(int(h) << _LOW) + int(low) for h, low in zip(*limbs, strict=True)]
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    shift = rest / n  # the mean is base + shift

    def product(q: np.ndarray) -> np.ndarray:
        def part(x):
            c = (x - base) - shift
            return c.T @ (c @ q)

        return summed(blocks, n_blocks, dim, part, q.shape) / n

    values, vectors, _ = leading(product, dim, components)
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])  # the largest entry is positive
    weights = vectors / np.sqrt(values)
    trace = float(summed(blocks, n_blocks, dim, lambda x: (((x - base) - shift) ** 2).sum(axis=0), (dim,)).sum()) / n
    middle = summed(blocks, n_blocks, dim, lambda x: (((x - base) - shift) @ weights).sum(axis=0), (k,)) / n

    def spread(x):
        w = ((x - base) - shift) @ weights - middle
        return w.T @ w

    error = float(np.abs(summed(blocks, n_blocks, dim, spread, (k, k)) / n - np.eye(k)).max())
    explained = values / trace

    def project(batches):
        for batch in batches:
            for ids, none, x in _numbers(batch, dim):
                w = ((x - base) - shift) @ weights
                m = len(ids)
                each = np.repeat(np.arange(m), k)
                exact = pa.array(_deviation(x - base, rest, n), pa.string()).take(pa.array(each))
                yield pa.record_batch([
                    pa.array(ids[each], pa.int64(), mask=none[each]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), exact, pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = blocks.mapInArrow(project, schema.replace("decimal(38,0)", "string"))
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
