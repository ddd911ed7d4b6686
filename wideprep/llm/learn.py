"""What the trained operators share: bounded samples of labelled rows, Adam, calibration.

Training data are a documented, bounded sample that one Spark job gathers to the driver or to one task, where numpy trains a
model of fixed size; scoring runs over all rows in Spark tasks with the model broadcast.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text a training sample may hold, with ``ROW_BYTES`` for each row; ``draw`` leaves out the longest texts beyond it.
SAMPLE_BYTES = 48 << 20
ROW_BYTES = 16


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def sample(rows: DataFrame, doc_id: str, n: int, seed: int = 1) -> DataFrame:
    """About ``n`` of the rows, chosen by a hash of the id (all rows if there are no more than ``n``)."""
    total = rows.count()
    if total <= n:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string")), F.lit(1 << 30)) < int(n / total * (1 << 30)))


def draw(docs: DataFrame, rows: DataFrame, group: str, quota, doc_id: str = "doc_id", text: str = "text",
         max_bytes: int = SAMPLE_BYTES, seed: int = 1) -> DataFrame:
    """Ids and groups of a sample of ``rows`` (one row per id): ``quota`` maps each group's number of ids to the number wanted.
    Ids are taken in hash order.  The texts of the sample, all rows of an id counted, hold at most ``max_bytes``.  Groups have
    equal shares, with what others do not need; a group that needs more leaves out its longest ids, as far as that gives it more ids in all.

    One job counts ids by group and bit length of their bytes; another brings the candidates' ids to the driver."""
    spark = rows.sparkSession
    sizes = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).alias("__size"))
    sized = rows.select(doc_id, group).join(sizes, doc_id).withColumn("__bits", F.length(F.bin("__size")))
    held: dict = {}
    for g, bits, n, size in sorted(tuple(r) for r in sized.groupBy(group, "__bits").agg(F.count("*"), F.sum("__size")).collect()):
        steps = held.setdefault(g, [])
        last = steps[-1] if steps else (0, 0, 0)
        steps.append((bits, last[1] + n, last[2] + size))
    wanted = {g: min(int(n), held[g][-1][1]) for g, n in quota({g: x[-1][1] for g, x in held.items()}).items()}
    order = sorted((g for g in held if wanted[g] > 0), key=lambda g: wanted[g] * held[g][-1][2] / held[g][-1][1])      # least need first
    left, share, limits = max_bytes, {}, []
    for k, g in enumerate(order):
        room = left / (len(order) - k)
        found, bits, n = max((min(wanted[g], n, room * n / size), bits, n) for bits, n, size in held[g])
        mean = next(size / n for b, n, size in held[g] if b == bits)
        share[g], left = max(1, int(found)), left - min(room, found * mean)
        rate = (share[g] + 4 * share[g] ** 0.5 + 10) / n
        limits.append((g, bits, int(min(1.0, rate) * (1 << 30))))
    schema = f"`{group}` {rows.schema[group].dataType.simpleString()}, __most int, __limit long"
    hash_ = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string")), F.lit(1 << 30))
    near = sized.withColumn("__hash", hash_).join(F.broadcast(spark.createDataFrame(limits, schema)), group) \
        .where((F.col("__bits") <= F.col("__most")) & (F.col("__hash") < F.col("__limit"))).select(doc_id, group, "__size", "__hash").collect()
    by: dict = {g: [] for g in order}
    for r in sorted(near, key=lambda r: (r["__hash"], str(r[doc_id]))):
        by[r[group]].append(r)
    chosen, left = [], max_bytes
    for k, g in enumerate(order):
        room, n = left / (len(order) - k), 0
        for r in by[g]:
            if n < share[g] and r["__size"] <= (room if n else left):
                chosen.append((r[doc_id], g))
                n, room, left = n + 1, room - r["__size"], left - r["__size"]
    return spark.createDataFrame(chosen, sized.select(doc_id, group).schema)


def gather(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> pa.Table:
    """The texts of the ``wanted`` ids (a sample bounded by ``draw``) with the other columns of ``wanted``."""
    return texts_of(docs, wanted, doc_id, text).toArrow().sort_by(doc_id)


def texts_of(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``gather``, where they lie."""
    return docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(wanted), doc_id)


def fit_in_task(sample: DataFrame, fit, order: str = "doc_id"):
    """The model that ``fit`` makes of a bounded sample (an Arrow table, sorted by ``order``).  One task trains it, which
    Spark repeats elsewhere if it is lost; the driver only receives the model."""

    def run(batches):
        held = list(batches)
        table = pa.Table.from_batches(held, held[0].schema if held else empty)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], names=["model"])

    empty = to_arrow_schema(sample.schema)
    found = sample.repartition(1).sortWithinPartitions(order).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(empty.empty_table())


class Adam:
    """Adam for a dict of arrays; rows of a table can be updated sparsely."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray] | None = None) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            at = (rows or {}).get(k, slice(None))
            p = self.params[k]
            if self.decay:
                g = g + self.decay * p[at]
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            p[at] -= (self.rate * fix) * m / (np.sqrt(v) + 1e-8)


def sum_rows(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their value rows."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return ids[first], (np.add.reduceat(values, first, axis=0) if len(ids) else values)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that gives the smallest log loss on held-back rows (1 without rows of both labels)."""
    if len(np.unique(labels)) < 2:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(8), 61))
    y = labels.astype(float)
    loss = [float(np.mean(np.logaddexp(0, logits / t) - y * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit halfway between two neighbours that gives the best F1 of label 1."""
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], labels[order].astype(float)
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1          # equal logits are cut together
    best = int(np.argmax(f1))
    return float((z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 1)
