"""k-nearest-neighbour imputation over a set of related columns (IM7).

Semantics (scikit-learn ``KNNImputer``, uniform weights, ``nan_euclidean``): for a row missing column c, the donors are
the rows that have c; the distance uses the coordinates both rows have, ``sqrt(m / n_common * sum(d^2))`` (m = number of
columns); donors with no common coordinate are ignored; the fill is the mean of c over the k nearest donors (ties by
smaller donor key); without any donor, the column mean.

Plan - exact, for any number of columns, and no receiver is compared with all donors:

* **Partition.**  A k-d tree cuts the space into cells: a node splits by the presence of a coordinate where rows differ in it, else at
  the median of its most spread-out coordinate.  It is built from a bounded sample of the rows; every row descends it in one
  Arrow pass.  Of donors with identical coordinates only the k smallest keys can ever be chosen, the others are left out first
  (``row_number() <= k``, planned as a partial per-task limit), so a hot vector fills no cell.
* **Bounds.**  Each cell's box - smallest and largest value and number of values per coordinate - is aggregated over all its donors.
  The boxes (at most ``BOX_BYTES``) are broadcast and bound the distance of a receiver to any donor of a cell from below: coordinates that
  all donors of the cell have count with their mean squared gap, others with the smallest.
* **Groups.**  Cells are numbered in the tree's order; a receiver is held against the boxes of runs of neighbouring cells, and against the cells of a run
  only if that is near enough.
* **Two steps.**  A receiver meets the nearest cell that holds k donors of its column; the k-th distance there is its radius.  Then
  it meets every other cell whose bound is within the radius, and no other.  Receivers and donors are grouped by cell,
  and a cell that more than ``GROUP_ROWS`` receivers meet is dealt over several groups.

Cells are as small as ``CELL_ROWS`` donors; beyond ``BOX_BYTES`` of boxes or ``SAMPLE_BYTES`` of sample (some 100,000 cells of five columns)
they grow with the table.  ``key`` must be unique.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.functions.numeric import nan_to_null
from wideprep.operators._util import chunks, col
from wideprep.session import checkpoint_dir, shuffle_partitions

CELL_ROWS = 256                  # donors of a cell, about
SAMPLE_PER_CELL = 16             # sample rows that a leaf of the tree stands on
SAMPLE_BYTES = 64 << 20          # of the sample the tree is built from
BOX_BYTES = 64 << 20             # of the boxes
MIXED = (0.05, 0.95)             # a node whose share of rows with a coordinate lies between splits by its presence
STEP_CELLS = 1 << 20             # receivers x cells, or receivers x donors, held at a time
GROUP_ROWS = 20_000              # receivers of a cell that one task compares
TASK_ROWS = 50_000               # rows of a task that sorts donors or looks for cells
MEET_ROWS = 200_000              # meetings of a task that compares


class Tree:
    """Binary tree over rows with missing values: at a node a row goes right if its coordinate exceeds the threshold
    (of a presence split: minus infinity); a missing coordinate goes left."""

    def __init__(self, sample: np.ndarray, leaf_rows: int):
        self.dim, self.cut, self.child, self.cell = [], [], [], []
        self.n_cells = 0
        todo = [(np.arange(len(sample)), self._node())]
        while todo:
            rows, node = todo.pop()
            split = self._split(sample[rows]) if len(rows) > leaf_rows else None
            if split is None:
                self.cell[node], self.n_cells = self.n_cells, self.n_cells + 1
                continue
            self.dim[node], self.cut[node] = split
            right = sample[rows, split[0]] > split[1]
            self.child[node] = (self._node(), self._node())
            todo += [(rows[~right], self.child[node][0]), (rows[right], self.child[node][1])]
        self.dim, self.cut, self.cell = np.array(self.dim), np.array(self.cut), np.array(self.cell)
        self.child = np.array(self.child).reshape(-1, 2)

    def _node(self) -> int:
        self.dim.append(0)
        self.cut.append(0.0)
        self.child.append((-1, -1))
        self.cell.append(-1)
        return len(self.dim) - 1

    @staticmethod
    def _split(x: np.ndarray):
        there = ~np.isnan(x)
        share = there.mean(axis=0)
        mixed = np.flatnonzero((share > MIXED[0]) & (share < MIXED[1]))
        if len(mixed):
            return int(mixed[np.argmin(np.abs(share[mixed] - 0.5))]), -math.inf
        n = np.maximum(there.sum(axis=0), 1)
        mean = np.where(there, x, 0).sum(axis=0) / n
        spread = (np.where(there, x - mean, 0) ** 2).sum(axis=0) / n
        d = int(np.argmax(spread))
        values = np.sort(x[there[:, d], d])
        if not len(values) or values[0] == values[-1]:
            return None
        cut = values[(len(values) - 1) // 2]
        return d, float(cut if cut < values[-1] else values[values < cut][-1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.cell[at] < 0)
            if not len(inner):
                return self.cell[at]
            node = at[inner]
            with np.errstate(invalid="ignore"):
                at[inner] = self.child[node, (x[inner, self.dim[node]] > self.cut[node]).astype(int)]


class Boxes:
    """Smallest and largest value per cell and coordinate, and the donors that have it."""

    def __init__(self, cell, low, high, count, total):
        self.cell, self.low, self.high, self.count = cell, low, high, count
        self.total = total
        self.every = count == total[:, None]
        self.size = max(1, math.isqrt(len(cell)))

    @cached_property
    def groups(self) -> Boxes:
        """The boxes of runs of ``size`` cells, which are neighbours in the tree."""
        at = np.arange(0, len(self.cell), self.size)
        # a cell without the coordinate does not widen the box
        low, high = np.where(self.count > 0, self.low, np.inf), np.where(self.count > 0, self.high, -np.inf)
        low, high = (f.reduceat(v, at, axis=0) if len(at) else v for f, v in ((np.minimum, low), (np.maximum, high)))
        count, total = (np.add.reduceat(v, at, axis=0) if len(at) else v for v in (self.count, self.total))
        return Boxes(at // self.size, np.where(count > 0, low, 0.0), np.where(count > 0, high, 0.0), count, total)

    def part(self, group: int) -> Boxes:
        """The cells of a group."""
        at = slice(group * self.size, (group + 1) * self.size)
        return Boxes(self.cell[at], self.low[at], self.high[at], self.count[at], self.total[at])

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Squared lower bounds (receivers x cells); infinite where no coordinate can be common."""
        m = x.shape[1]
        sums, n, least = np.zeros((len(x), len(self.cell))), np.zeros((len(x), len(self.cell))), np.full((len(x), len(self.cell)), np.inf)
        for i in range(m):
            own = ~np.isnan(x[:, i])
            v = np.where(own, x[:, i], 0.0)[:, None]
            gap = np.maximum(np.maximum(self.low[:, i] - v, v - self.high[:, i]), 0) ** 2
            always = own[:, None] & self.every[:, i]
            sums, n = sums + np.where(always, gap, 0), n + always
            some = own[:, None] & ~self.every[:, i] & (self.count[:, i] > 0)
            least = np.where(some, np.minimum(least, gap), least)
        mean = np.where(n > 0, sums / np.maximum(n, 1), np.inf)
        return m * np.minimum(mean, least)


def _matrix(column, m: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, m)


def _tasks(spark, rows: int, each: int) -> int:
    return max(shuffle_partitions(spark), -(-rows // each))


def _assign(rows: DataFrame, tree: Tree, m: int) -> DataFrame:
    """``rows`` (``_did, _d``) with their ``_cell``."""
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.cells(_matrix(b.column("_d"), m)), pa.int64())], names=[*b.schema.names, "_cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_cell", T.LongType())]))


def _around(b: Boxes, x: np.ndarray, c: np.ndarray, reach):
    """``(rows, cells, bounds)`` by group of cells, for the receivers ``x`` with missing columns ``c``: those cells with donors of the column in groups
    whose bound is at most ``reach`` (one number a receiver, squared; read anew for each group)."""
    group = np.where(b.groups.count[:, c].T > 0, b.groups.bounds(x), np.inf)
    for g in np.argsort(np.where(np.isfinite(group), group, np.inf).min(axis=0), kind="stable"):
        rows = np.flatnonzero((group[:, g] <= reach()) & np.isfinite(group[:, g]))
        if len(rows):
            cells = b.part(g)
            yield rows, cells, np.where(cells.count[:, c[rows]].T > 0, cells.bounds(x[rows]), np.inf)


def _nearest(b: Boxes, x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The nearest cell that holds k donors of its column, for each receiver; -1 without one."""
    least, cell = np.full(len(x), np.inf), np.full(len(x), -1, np.int64)
    # a group as far as the nearest cell so far has nothing nearer
    for rows, cells, bound in _around(b, x, c, lambda: np.where(cell < 0, np.inf, np.nextafter(least, -np.inf))):
        full = np.where(cells.count[:, c[rows]].T >= k, bound, np.inf)
        at = full.argmin(axis=1)
        near = full[np.arange(len(rows)), at]
        better = near < least[rows]
        least[rows[better]], cell[rows[better]] = near[better], cells.cell[at[better]]
    return cell


def _meet(recv: DataFrame, boxes: Boxes, m: int, k: int, first: bool) -> DataFrame:
    """Each receiver (all its columns) with its ``_cell``: the nearest that holds k donors of its column (``first``), or all others
    within its ``_radius``."""
    held = recv.sparkSession.sparkContext.broadcast(boxes)
    names = recv.columns

    def run(batches):
        import pyarrow as pa
        b = held.value
        step = max(1, STEP_CELLS // max(1, len(b.groups.cell), len(b.part(0).cell) if len(b.cell) else 1))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                c, x = batch.column("_c").to_numpy(), _matrix(batch.column("_r"), m)
                nearest = _nearest(b, x, c, k)
                if first:
                    found = [(np.flatnonzero(nearest >= 0), nearest[nearest >= 0])]
                else:
                    reach = batch.column("_radius").to_numpy() ** 2 * (1 + 1e-9)
                    found = []
                    for rows, cells, bound in _around(b, x, c, lambda: reach):
                        row, at = np.nonzero((bound <= reach[rows][:, None]) & np.isfinite(bound) & (cells.cell != nearest[rows][:, None]))
                        found.append((rows[row], cells.cell[at]))
                for row, cell in found:
                    if len(row):
                        yield pa.RecordBatch.from_arrays([*[batch.column(n).take(pa.array(row)) for n in names], pa.array(cell, pa.int64())], names=[*names, "_cell"])

    return recv.mapInArrow(run, T.StructType([*recv.schema.fields, T.StructField("_cell", T.LongType())]))


def _compare(m: int, k: int):
    """The k nearest donors, among those of one cell, of each receiver that meets it."""

    def run(left, right):
        import pyarrow as pa
        donors = right.sort_by("_did")          # equal distances: the stable sort below leaves the smaller key first
        d, r = _matrix(donors.column("_d").combine_chunks(), m), _matrix(left.column("_r").combine_chunks(), m)
        c = left.column("_c").to_numpy()
        radius = after = None
        if "_radius" in left.column_names:
            radius = left.column("_radius").to_numpy()
            kth = left.column("_kth").combine_chunks()
            there = np.flatnonzero(kth.is_valid().to_numpy(zero_copy_only=False))
            after = np.full(len(radius), len(d))
            after[there] = np.searchsorted(donors.column("_did").to_numpy(), kth.take(pa.array(there)).to_numpy(zero_copy_only=False))
        rows, picks, dists = [], [], []
        step = max(1, STEP_CELLS // max(1, len(d)))
        for lo in range(0, len(r) if len(d) else 0, step):
            x, own = r[lo:lo + step], c[lo:lo + step]
            sums, n = np.zeros((len(x), len(d))), np.zeros((len(x), len(d)))
            for i in range(m):
                gap = x[:, i][:, None] - d[:, i]
                both = ~np.isnan(gap)
                sums, n = sums + np.where(both, gap * gap, 0), n + both
            has = (n > 0) & ~np.isnan(d[:, own].T)
            far = np.where(has, np.sqrt(m / np.maximum(n, 1) * sums), np.inf)
            if radius is not None:              # what is no nearer than the k-th so far, or as near with a larger key, is not among the k
                end = radius[lo:lo + step][:, None]
                far = np.where((far > end) | (far == end) & (np.arange(len(d)) >= after[lo:lo + step][:, None]), np.inf, far)
            pick = np.argsort(far, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(far, pick, 1)
            row, nth = np.nonzero(np.isfinite(dist))
            rows.append(row + lo)
            picks.append(pick[row, nth])
            dists.append(dist[row, nth])
        row, pick = np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(picks or [np.zeros(0, int)])
        at = pa.array(row, pa.int64())
        return pa.table({"_rid": left.column("_rid").take(at), "_c": left.column("_c").take(at), "_did": donors.column("_did").take(pa.array(pick, pa.int64())),
                         "_dist": pa.array(np.concatenate(dists or [np.zeros(0)])), "_y": pa.array(d[pick, c[row]])})

    return run


def impute_knn(df: DataFrame, key: str, columns, k: int = 3, cell_rows: int = CELL_ROWS, report: dict | None = None) -> DataFrame:
    """Fill missing values of ``columns`` from the k nearest rows; returns the input columns with those columns filled.
    ``report`` (a dict) receives the number of cells, of receivers, and of receiver-cell meetings in both steps."""
    cols, spark = list(columns), df.sparkSession
    m = len(cols)
    if not m:
        raise ValueError("kNN imputation takes at least one related column")
    checkpoint_dir(spark)
    values = [nan_to_null(col(c).cast("double")) for c in cols]
    base = df.select(col(key).alias("_id"), F.array(*values).alias("_x")).where(F.exists("_x", lambda v: v.isNotNull()))
    sums = [list(df.agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(part)]).first()) for part in chunks(values)]
    means = [v for part in sums for v in part[1:]]
    # rows are dealt over tasks by their number, however few files hold them
    base = base.repartition(_tasks(spark, sums[0][0], TASK_ROWS), "_id")
    same = Window.partitionBy("_d").orderBy("_did")
    donors = base.select(F.col("_id").alias("_did"), F.col("_x").alias("_d")).withColumn("_nth", F.row_number().over(same)) \
        .where(F.col("_nth") <= k).drop("_nth").checkpoint()
    n = donors.count()
    most = max(1, min(SAMPLE_BYTES // (8 * m) // SAMPLE_PER_CELL, BOX_BYTES // (24 * m)))
    cells = max(1, min(-(-n // cell_rows), most))
    share = min(1.0, SAMPLE_PER_CELL * cells * 1.1 / max(n, 1))
    sample = (donors if share == 1.0 else donors.sample(share, seed=7)).select("_d").limit(most * SAMPLE_PER_CELL)
    held = np.array([r["_d"] for r in sample.collect()], float).reshape(-1, m)
    placed = _assign(donors, Tree(held, max(1, len(held) // cells)), m).checkpoint()
    each = lambda f: F.array(*[f(F.get("_d", F.lit(i))) for i in range(m)])
    found = placed.groupBy("_cell").agg(each(F.min).alias("low"), each(F.max).alias("high"), each(F.count).alias("count"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: r["_cell"])            # neighbours in the tree are numbered in turn
    table = lambda name: np.array([[0.0 if v is None else v for v in r[name]] for r in found], float).reshape(-1, m)
    boxes = Boxes(np.array([r["_cell"] for r in found], np.int64), table("low"), table("high"), table("count"), np.array([r["n"] for r in found], float))

    recv = base.select(F.col("_id").alias("_rid"), F.col("_x").alias("_r"), F.posexplode("_x").alias("_c", "_v")).where("_v IS NULL").drop("_v").checkpoint()
    by = Window.partitionBy("_rid", "_c").orderBy("_dist", "_did")

    schema = T.StructType([recv.schema["_rid"], recv.schema["_c"], placed.schema["_did"], T.StructField("_dist", T.DoubleType()), T.StructField("_y", T.DoubleType())])

    def nearest(meetings: DataFrame, n: int, more: DataFrame | None = None) -> DataFrame:
        # a cell that very many receivers meet is dealt over several groups, each with all its donors
        salts = meetings.groupBy("_cell").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_salts"))
        asked = meetings.join(F.broadcast(salts), "_cell").withColumn("_salt", F.pmod(F.xxhash64("_rid", "_c"), "_salts").cast("int")).drop("_salts")
        there = placed.join(F.broadcast(salts), "_cell").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
        parts = _tasks(spark, n, MEET_ROWS)
        asked, there = (side.repartition(parts, "_cell", "_salt") for side in (asked, there))
        hits = asked.groupBy("_cell", "_salt").cogroup(there.groupBy("_cell", "_salt")).applyInArrow(_compare(m, k), schema)
        hits = hits if more is None else hits.unionByName(more)
        return hits.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= k).drop("_rank")

    one = _meet(recv, boxes, m, k, True).checkpoint()
    best = nearest(one, one.count()).checkpoint()
    last = F.max(F.struct("_dist", "_did"))
    radius = best.groupBy("_rid", "_c").agg(F.when(F.count("*") == k, last).alias("_last"))
    wider = recv.join(radius, ["_rid", "_c"], "left") \
        .select("_rid", "_c", "_r", F.coalesce("_last._dist", F.lit(math.inf)).alias("_radius"), F.col("_last._did").alias("_kth")) \
        .repartition(_tasks(spark, recv.count(), TASK_ROWS), "_rid")
    two = _meet(wider, boxes, m, k, False).checkpoint()
    met = two.count()
    if report is not None:
        report.update(cells=len(found), receivers=recv.count(), first=one.count(), second=met)
    fills = nearest(two, met, best).groupBy("_rid", "_c").agg(F.avg("_y").alias("_fill"))
    wide = fills.groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_fill"))).alias("_fills"))
    out = df.join(wide, df[key] == wide["_rid"], "left")
    place = {c: j for j, c in enumerate(cols)}
    filled = [F.coalesce(v, F.element_at("_fills", F.lit(j)), F.lit(means[j]).cast("double")).alias(cols[j]) for j, v in enumerate(values)]
    return out.select(*[filled[place[c]] if c in place else col(c) for c in df.columns])
