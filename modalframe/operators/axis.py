"""Long ordered axes cut into blocks: smoothing with a halo and nearest crossings through block minima.

Places on an axis are numbered from 0 without gaps (column ``pos``; ``n_lines`` is the length of the axis). A block holds `BLOCK`
places, or more on very long axes, so that an axis has a few hundred blocks at most; each block is worked on by itself.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096
MOST_BLOCKS = 256
#: Windows up to this many places are summed directly, longer ones by differences of running sums.
DIRECT = 1025


def block_size(n_lines: Column, least: Column | int = 1) -> Column:
    return F.greatest(F.lit(BLOCK), F.ceil(n_lines / MOST_BLOCKS), F.lit(least) if isinstance(least, int) else least).cast("bigint")


def window_moments(y: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of y, t y and t t y over the ``2 half + 1`` places around each full centre (t counts from the centre)."""
    t = np.arange(-half, half + 1, dtype=float)
    if len(t) <= DIRECT:
        return tuple(np.correlate(y, w, "valid") for w in (np.ones_like(t), t, t * t))
    x = np.arange(len(y), dtype=float) - len(y) / 2
    run = [np.concatenate(([0.0], np.cumsum(v))) for v in (y, x * y, x * x * y)]
    s0, s1, s2 = (r[2 * half + 1 :] - r[: -2 * half - 1] for r in run)
    c = x[half : len(y) - half]
    return s0, s1 - c * s0, s2 - 2 * c * s1 + c * c * s0


def local_quadratic(y: np.ndarray, first: int, at: np.ndarray, half: int, n: int) -> np.ndarray:
    """Least-squares quadratic at the places ``at`` of an axis of ``n``; ``y`` holds the places from ``first`` on.

    Inside the axis the window is centred; near its ends the polynomial of the first or last window is evaluated off-centre.
    """
    if half < 2:
        return y[at - first]
    s0, s1, s2 = window_moments(y, half)
    centre = np.clip(at, half, n - 1 - half)
    k, t, m = centre - first - half, (at - centre).astype(float), 2 * half + 1
    sum2 = half * (half + 1) * m / 3
    sum4 = sum2 * (3 * half * half + 3 * half - 1) / 5
    mean2 = sum2 / m
    return s0[k] / m + t * s1[k] / sum2 + (t * t - mean2) * (s2[k] - mean2 * s0[k]) / (sum4 - m * mean2 * mean2)


def smooth(lines: DataFrame, keys: list[str], value: str, half: Column, name: str) -> DataFrame:
    """Add ``name``, the local quadratic of ``value`` with ``half`` places on each side, to lines with ``pos`` and ``n_lines``.

    A block takes along two half windows of its neighbours, so each axis is smoothed by as many tasks as it has blocks.
    """
    d = lines.withColumn("_half", half.cast("bigint"))
    size = block_size(F.col("n_lines"), 2 * F.col("_half") + 1)
    block = lambda p: F.floor(p / F.col("_size"))
    reach = F.sequence(F.greatest(block(F.col("pos") - 2 * F.col("_half")), F.lit(0)), F.least(block(F.col("pos") + 2 * F.col("_half")), block(F.col("n_lines") - 1)))
    d = d.withColumn("_size", size).withColumn("_own", block(F.col("pos"))).withColumn("_block", F.explode(reach))
    out = [*lines.columns, name]
    schema = T.StructType([*lines.schema.fields, T.StructField(name, T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        pos, y = table.column("pos").to_numpy(), table.column(value).to_numpy().astype(float)
        mine = table.column("_own").to_numpy() == table.column("_block").to_numpy()
        made = local_quadratic(y, int(pos[0]), pos[mine], int(table.column("_half")[0].as_py()), int(table.column("n_lines")[0].as_py()))
        return table.filter(pa.array(mine)).append_column(name, pa.array(made)).select(out)

    return d.groupBy(*keys, "_block").applyInArrow(run, schema)


class Minima:
    """Minima (and maxima) of every stretch of an array, by tables over powers of two."""

    def __init__(self, v: np.ndarray):
        self.low, self.high = [v], [v]
        width = 1
        while len(self.low[-1]) > width:
            self.low.append(np.minimum(self.low[-1][:-width], self.low[-1][width:]))
            self.high.append(np.maximum(self.high[-1][:-width], self.high[-1][width:]))
            width *= 2

    @staticmethod
    def _clear(values: np.ndarray, level: np.ndarray, inclusive: bool) -> np.ndarray:
        return values > level if inclusive else values >= level

    def back(self, stop: np.ndarray, level: np.ndarray, inclusive: bool) -> np.ndarray:
        """Last place before ``stop`` whose value is below the level (``inclusive``: or equal to it); -1 without one."""
        at = stop.copy()
        for k in range(len(self.low) - 1, -1, -1):
            begin = at - (1 << k)
            ok = begin >= 0
            ok[ok] = self._clear(self.low[k][begin[ok]], level[ok], inclusive)
            at[ok] = begin[ok]
        return at - 1

    def ahead(self, start: np.ndarray, level: np.ndarray, inclusive: bool) -> np.ndarray:
        """First place from ``start`` on whose value is below the level (or equal to it); the length without one."""
        at, n = start.copy(), len(self.low[0])
        for k in range(len(self.low) - 1, -1, -1):
            ok = at + (1 << k) <= n
            ok[ok] = self._clear(self.low[k][at[ok]], level[ok], inclusive)
            at[ok] += 1 << k
        return at

    def top(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Greatest value of the places [a, b); NaN for an empty stretch."""
        out = np.full(len(a), np.nan)
        wide = b - a
        for k in range(len(self.high)):
            m = (wide >= (1 << k)) & (wide < (2 << k))
            out[m] = np.maximum(self.high[k][a[m]], self.high[k][b[m] - (1 << k)])
        return out


def _answers(inclusive: bool, keys: list[str], value: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = [*keys, "pos", "side", "left", "left_top", "right", "right_top"]

    def run(lines: pa.Table, asked: pa.Table) -> pa.Table:
        if not (lines.num_rows and asked.num_rows):
            none = [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64())]
            return pa.table([*(asked.column(k).slice(0, 0) for k in keys), *none], names=names)
        lines = lines.sort_by("pos")
        first, n = lines.column("pos")[0].as_py(), lines.num_rows
        tables = Minima(lines.column(value).to_numpy().astype(float))
        pos, side, level = (asked.column(c).to_numpy() for c in ("pos", "side", "level"))
        level, mid = level.astype(float), asked.column("mid").to_numpy(zero_copy_only=False).astype(float)
        hit = asked.column("hit").to_numpy(zero_copy_only=False).astype(bool)
        here = pos - first
        stop, start = np.where(side == 0, here, n), np.where(side == 0, here + 1, 0)
        left, right = tables.back(stop, level, inclusive), tables.ahead(start, level, inclusive)
        left_top, right_top = tables.top(left + 1, stop), tables.top(start, right)
        to_left, to_right = (side == 0) | (side < 0), (side == 0) | (side > 0)
        left_top, right_top = np.where(hit, left_top, np.nan), np.where(hit, right_top, np.nan)
        left_top, right_top = np.fmax(left_top, mid), np.fmax(right_top, mid)

        def shown(values, ok):
            return pa.array(values, mask=~ok | (np.isnan(values) if values.dtype.kind == "f" else False))

        return pa.table([*(asked.column(k) for k in keys), asked.column("pos"), asked.column("side"), shown(left + first, to_left & hit & (left >= 0)), shown(left_top, to_left),
                         shown(right + first, to_right & hit & (right < n)), shown(right_top, to_right)], names=names)

    return run


def nearest_below(lines: DataFrame, requests: DataFrame, keys: list[str], value: str, inclusive: bool = False) -> DataFrame:
    """For each request (keys, ``pos``, ``level``) the nearest places on both sides whose ``value`` is below the level.

    ``lines``: keys, ``pos``, ``n_lines``, ``value``. Result: keys, pos, ``left``, ``left_top``, ``right``, ``right_top``; the tops are the
    greatest values strictly between (all up to the end of the axis where there is no such place, then ``left`` or ``right`` is null).
    ``inclusive``: places equal to the level count as below. A request looks at its own block and, by the minima of the
    blocks, at one more on each side, so the work does not grow with the distance.
    """
    cut = lines.select(*keys, "pos", F.col(value), F.floor(F.col("pos") / block_size(F.col("n_lines"))).alias("block"), block_size(F.col("n_lines")).alias("size"))
    per = cut.groupBy(*keys, "block", "size").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    per = per.groupBy(*keys, "size").agg(F.array_sort(F.collect_list(F.struct("block", "lo", "hi"))).alias("b"))
    r = requests.select(*keys, "pos", F.col("level").cast("double").alias("level")).join(per, keys).withColumn("own", F.floor(F.col("pos") / F.col("size")))
    below = (lambda b: b["lo"] <= F.col("level")) if inclusive else (lambda b: b["lo"] < F.col("level"))
    r = r.withColumn("lb", F.array_max(F.transform(F.filter("b", lambda b: (b["block"] < F.col("own")) & below(b)), lambda b: b["block"])))
    r = r.withColumn("rb", F.array_min(F.transform(F.filter("b", lambda b: (b["block"] > F.col("own")) & below(b)), lambda b: b["block"])))
    top = lambda inside: F.array_max(F.transform(F.filter("b", inside), lambda b: b["hi"]))
    r = r.withColumn("lmid", top(lambda b: (b["block"] < F.col("own")) & (b["block"] > F.coalesce("lb", F.lit(-1)))))
    r = r.withColumn("rmid", top(lambda b: (b["block"] > F.col("own")) & (F.col("rb").isNull() | (b["block"] < F.col("rb")))))
    none = F.lit(None).cast("double")
    one = lambda side, block, mid, hit: F.struct(F.lit(side).alias("side"), block.alias("block"), mid.alias("mid"), hit.alias("hit"))
    sides = F.array(one(0, F.col("own"), none, F.lit(True)), one(-1, F.coalesce("lb", "own"), F.col("lmid"), F.col("lb").isNotNull()), one(1, F.coalesce("rb", "own"), F.col("rmid"), F.col("rb").isNotNull()))
    asked = r.select(*keys, "pos", "level", F.explode(sides).alias("s")).select(
        *[F.col(k).alias(k) for k in keys], F.col("s.block").alias("block"), F.col("pos").cast("bigint").alias("pos"), "level", "s.side", "s.mid", "s.hit")
    schema = T.StructType([*[requests.schema[k] for k in keys], T.StructField("pos", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("left", T.LongType()), T.StructField("left_top", T.DoubleType()),
                           T.StructField("right", T.LongType()), T.StructField("right_top", T.DoubleType())])
    got = cut.select(*keys, "block", "pos", value).groupBy(*keys, "block").cogroup(asked.groupBy(*keys, "block")).applyInArrow(_answers(inclusive, keys, value), schema)
    of = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))
    both = got.groupBy(*keys, "pos").agg(of(0, "left").alias("ol"), of(0, "left_top").alias("olt"), of(-1, "left").alias("fl"), of(-1, "left_top").alias("flt"),
                                         of(0, "right").alias("or"), of(0, "right_top").alias("ort"), of(1, "right").alias("fr"), of(1, "right_top").alias("frt"))
    # Where the own block has a place below the level, what lies beyond it does not count.
    beyond = lambda o, ot, ft: F.when(F.col(o).isNotNull(), F.col(ot)).otherwise(F.greatest(ot, ft))
    return both.select(*keys, "pos", F.coalesce("ol", "fl").alias("left"), beyond("ol", "olt", "flt").alias("left_top"), F.coalesce("or", "fr").alias("right"), beyond("or", "ort", "frt").alias("right_top"))
