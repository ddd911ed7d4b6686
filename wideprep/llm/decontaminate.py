"""Benchmark decontamination: find benchmark word windows in documents, drop documents or cut spans.

Texts are lower-cased (A-Z only) and cut into words of letters, digits and non-ASCII characters.
A window is ``size`` consecutive words of a benchmark item; an item of fewer words, but not none,
is one window.  ``scan`` hashes all document windows with numpy on the Arrow buffers, looks them up in a
broadcast hash set of the benchmark's windows and verifies each hit word for word.
The set is broadcast while the benchmark's texts hold at most ``MAX_SET_BYTES``; a larger benchmark
goes through ``scan_by_join``, which shuffles window hashes instead and gives the same rows.

Null or empty texts have no words and no hits.  A null benchmark text adds no window, a null
``item_id`` counts as the item ``null``; repeated item ids count once.  Repeated documents are judged alike.
Extra columns pass through; a column named like the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideprep.llm.arrow_text import LOWER, WORD_BYTES, hash_words, runs, slices, string_buffers, window_hashes

WINDOW = 13
#: Bytes of benchmark text up to which its windows are broadcast: about 1.4 million windows, 30 MB.
MAX_SET_BYTES = 8 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
#: Where windows were hit in a text: first word and number of words.
PLACES = "array<struct<at:int,size:int>>"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, words before each row, row offsets."""
    raw, offsets = string_buffers(column)
    data = LOWER[raw]
    starts, ends, before = runs(WORD_BYTES[raw], offsets)
    return data, starts, ends, before, offsets


def _hit_words(edge: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list]:
    """For each row: number of hit words and their spans in bytes.  ``edge`` counts the windows that begin less those that end at each word."""
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    begin, stop, owner = runs(hit, before)
    spans = [[{"start": int(starts[b] - offsets[r]), "end": int(ends[e - 1] - offsets[r])} for b, e in zip(begin[owner[r]:owner[r + 1]], stop[owner[r]:owner[r + 1]])]
             if owner[r + 1] > owner[r] else [] for r in range(len(before) - 1)]
    return total[before[1:]] - total[before[:-1]], spans


def _result(n_words: np.ndarray, n_hit: np.ndarray, items: list, spans: list) -> pa.StructArray:
    parts = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, KIND[2].type), pa.array(spans, KIND[3].type)]
    return pa.StructArray.from_arrays(parts, fields=list(KIND))


class WindowSet:
    """The benchmark's windows: sorted hashes, and the item and place each comes from."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        data, starts, ends, before, _ = _words(pa.array([t for _, t in items], pa.string()))
        self.names = [i for i, _ in items]
        self.words = [data[s:e].tobytes() for s, e in zip(starts, ends)]
        hashes, _ = hash_words(data, starts, ends)
        counts = np.diff(before)
        at, length, item = [], [], []
        for k, n in enumerate(counts.tolist()):
            if n:
                size_k = min(n, size)
                at.append(np.arange(before[k], before[k] + n - size_k + 1))
                length.append(np.full(len(at[-1]), size_k))
                item.append(np.full(len(at[-1]), k))
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        length = np.concatenate(length) if length else np.zeros(0, np.int64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        self.tables = {}
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            h = window_hashes(hashes, n)[self.at[own]]
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[(h >> np.uint64(48)).astype(np.int64)] = True
            self.tables[n] = (h[order], own[order], seen)

    def find(self, hashes: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each window length: its places in the documents whose hash is known, and the range of entries."""
        row = None
        for n, (known, own, seen) in self.tables.items():
            h = window_hashes(hashes, n)
            at = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
            lo = np.searchsorted(known, h[at])
            same = lo < len(known)
            same[same] = known[lo[same]] == h[at[same]]
            at, lo = at[same], lo[same]
            if not len(at):
                continue
            hi = np.searchsorted(known, h[at], side="right")
            row = np.searchsorted(before, at, side="right") - 1
            fits = at + n <= before[row + 1]
            yield n, at[fits], row[fits], lo[fits], hi[fits]


def _hits(found: WindowSet, column: pa.Array) -> tuple[np.ndarray, list, list, list]:
    """For each row: number of words, of hit words, its items, and its hit spans in bytes."""
    data, starts, ends, before, offsets = _words(column)
    hashes, _ = hash_words(data, starts, ends)
    n_rows = len(before) - 1
    edge = np.zeros(len(starts) + 1, np.int64)
    items: list[set] = [set() for _ in range(n_rows)]
    for n, at, row, lo, hi in found.find(hashes, before):
        own = found.tables[n][1]
        for a, r, i, j in zip(at.tolist(), row.tolist(), lo.tolist(), hi.tolist()):
            text = [data[s:e].tobytes() for s, e in zip(starts[a:a + n], ends[a:a + n])]
            for entry in own[i:j].tolist():
                b = int(found.at[entry])
                if found.words[b:b + n] == text:
                    items[r].add(found.names[found.item[entry]])
                    edge[a] += 1
                    edge[a + n] -= 1
    n_hit, spans = _hit_words(edge, starts, ends, before, offsets)
    return np.diff(before), n_hit, [sorted(x) for x in items], spans


def _scan(docs: DataFrame, found: WindowSet, text: str, into: str, keep: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(found)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(into, FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            result = _result(*_hits(held.value, batch.column(text)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], result], names=[*keep, into])

    return docs.mapInArrow(run, schema)


def _split(text) -> F.Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER_AZ, LOWER_AZ), SEPARATORS), "")


def _window_rows(rows: DataFrame, length) -> DataFrame:
    """One row per window of ``length`` words of the column ``words``: its place and its words joined."""
    places = F.when(F.size("words") >= length, F.sequence(F.lit(0), F.size("words") - length)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("at", F.explode(places)).withColumn("size", F.lit(length) if isinstance(length, int) else length) \
        .withColumn("window", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " "))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and result of rows of key, text, hit places and items."""
    for batch in slices(batches, "t"):
        _, starts, ends, before, offsets = _words(batch.column("t"))
        edge = np.zeros(len(starts) + 1, np.int64)
        for r, places in enumerate(batch.column("places").to_pylist()):
            for p in places or ():
                edge[before[r] + p["at"]] += 1
                edge[before[r] + p["at"] + p["size"]] -= 1
        n_hit, spans = _hit_words(edge, starts, ends, before, offsets)
        result = _result(np.diff(before), n_hit, [x or [] for x in batch.column("items").to_pylist()], spans)
        yield pa.RecordBatch.from_arrays([batch.column("key"), result], names=["__key", "__result"])


def scan_by_join(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "hits",
                 keep: list[str] | None = None, size: int = WINDOW) -> DataFrame:
    """``scan`` for a benchmark of any size: window hashes are shuffled, hits verified on the window's words.  The hit places
    of each text (at most its windows) meet the text again, where they become spans."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    key = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    texts = docs.select(key.alias("key"), F.col(f"`{text}`").alias("t")).groupBy("key").agg(F.first("t").alias("t")) \
        .select("key", "t", _split(F.col("t")).alias("words"))
    wanted = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), _split(F.col("text")).alias("words")) \
        .where(F.size("words") > 0)
    wanted = _window_rows(wanted, F.least(F.size("words"), F.lit(size))).select("item", "size", "window", F.xxhash64("window").alias("h")).distinct()
    lengths = [r[0] for r in wanted.select("size").distinct().collect()]     # at most ``size`` values
    hits = None
    for n in lengths:
        part = _window_rows(texts, n).select("key", "at", "size", F.xxhash64("window").alias("h"))
        hits = part if hits is None else hits.union(part)
    if hits is None:
        found = texts.select("key", "t", F.lit(None).cast(PLACES).alias("places"), F.lit(None).cast("array<string>").alias("items"))
    else:
        hits = hits.join(wanted, ["h", "size"]).join(texts.select("key", "words"), "key") \
            .where(F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ") == F.col("window"))
        hits = hits.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"), F.collect_set(F.struct("at", "size")).alias("places"))
        found = texts.select("key", "t").join(hits, "key", "left").select("key", "t", "places", "items")
    judged = found.mapInArrow(_judge, T.StructType([T.StructField("__key", T.StringType()), T.StructField("__result", FIELDS)])) \
        .withColumnRenamed("__result", into)
    return docs.select(*[F.col(f"`{c}`") for c in keep], key.alias("__key")).join(judged, "__key").select(*[F.col(f"`{c}`") for c in keep], into)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "hits", keep: list[str] | None = None,
         size: int = WINDOW, max_set_bytes: int = MAX_SET_BYTES) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and a struct ``into``: n_words, n_hit, items (sorted
    ids of the items with a window in the text) and spans (byte ranges of the hit words)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    n_bytes = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if n_bytes > max_set_bytes:
        return scan_by_join(docs, benchmark, text, into, keep, size)
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").collect()
    return _scan(docs, WindowSet([tuple(r) for r in rows], size), text, into, keep)


def is_contaminated(into: str = "hits") -> F.Column:
    """True where at least one word in twenty is hit."""
    n_hit, n_words = F.col(f"{into}.n_hit"), F.col(f"{into}.n_words")
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kwargs) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = scan(docs, benchmark, text, "__hits", **kwargs)
    return found.where(~is_contaminated("__hits")).drop("__hits")


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kwargs) -> DataFrame:
    """All documents, with the hit spans cut out of their texts (a null text stays null)."""
    found = scan(docs, benchmark, text, "__hits", **kwargs)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for t, h in zip(batch.column(text).to_pylist(), batch.column("__hits").to_pylist()):
                if t is not None and h["spans"]:
                    raw, at, parts = t.encode(), 0, []
                    for s in h["spans"]:
                        parts.append(raw[at:s["start"]])
                        at = s["end"]
                    t = b"".join([*parts, raw[at:]]).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()) if c == text else batch.column(c) for c in schema.names], names=schema.names)

    return found.mapInArrow(run, schema)
