"""Approximate nearest neighbours by largest inner product: an inverted file with product-quantised residuals.

Fit: k-means on a sample of SAMPLE_ROWS vectors (those of the smallest id hashes), or eight a list, at most 8 x MAX_LISTS, gives coarse centroids; k-means on the residuals' slices gives the
codebooks. Index: every row belongs to the list of its nearest centroid and has a code of one byte a slice. Search: a query visits the lists of the centroids
with the largest inner products; in each, a table of inner products with the codebooks (asymmetric distances) ranks the rows, and the first
RERANK x k are ranked again by the exact inner product in double precision on the original vectors.

The number of lists to visit is measured: queries from the sample are searched in it by brute force, and as many lists are visited as hold the share
TARGET of the true neighbours. Clustered vectors need few lists; vectors without any structure need about half of them, at any number of lists.
An eighth of the rows, at most the sample, are anchors: a query's k best among them are candidates too, and their worst score bounds its k-th best score from below,
so rows under it are neither reranked nor returned. Before the exact products are added up in their fixed order, one matrix product a list, with a bound of its rounding error,
leaves out the pairs that can't reach that score; it loses none that can.

Work: lists are packed into groups of about ROW_CHUNK rows; a query is sent once to each group that it visits, with the lists that it visits there, and not once a list. Queries are cut into
chunks of about QUERY_CHUNK; a task holds one group and one chunk. Vectors without structure make every query visit most groups, so that the work grows with queries times rows;
clustered ones don't.

Skew: a list of more than ROW_CHUNK rows is cut into parts by a hash of the ids, each a group of its own, so neither a hot list nor a popular one is gathered. Equal vectors have equal
codes; at equal scores smaller ids come first at each step, so ties are exact.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id, nor vectors of another length than the most
frequent one (the longest of those); rows that share an id with the query are not its candidates; rows of
equal ids and equal scores for a query are one candidate; fewer than k candidates give fewer rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch

SAMPLE_ROWS = 16_000
MAX_LISTS = 4096
#: Share of the true neighbours in the visited lists, as measured in the sample.
TARGET = 0.97
RERANK = 10
SLICES = 8
CODES = 256
#: Rows and queries that a task holds at once, at most.
ROW_CHUNK, QUERY_CHUNK = 16_384, 16_384
_BLOCK = 64


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most k centroids of the rows of x, by Lloyd's steps."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        size = np.bincount(of, minlength=k)
        order = np.argsort(of, kind="stable")
        full = np.flatnonzero(size)
        centres[full] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size[full])[:-1]])) / size[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Centroids and codebooks."""

    def __init__(self, sample: np.ndarray, lists: int):
        sample = np.unique(sample, axis=0).astype(np.float32)
        self.centres = kmeans(sample, lists)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(SLICES, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), CODES) for a, b in zip(self.cuts, self.cuts[1:])]

    def tune(self, ids: np.ndarray, sample: np.ndarray, k: int, anchors: int) -> None:
        """Keep the first rows of the sample as anchors; measure how many lists to visit, and the error of approximate scores."""
        order = np.argsort(ids[:anchors], kind="stable")
        self.ids, self.anchors = ids[:anchors][order], sample[:anchors][order]
        x = sample.astype(np.float32)
        q = np.unique(x, axis=0)
        q = q[:: max(1, len(q) // 512)]
        of, codes = self.place(x)
        scores = q @ x.T
        best = np.argsort(-scores, axis=1)[:, : k + 1]  # a query is its own first
        seen = np.argsort(np.argsort(-(q @ self.centres.T), axis=1, kind="stable"), axis=1)
        found = np.sort(np.take_along_axis(seen, of[best[:, 1:]], axis=1).ravel())
        self.probe = int(found[min(len(found) - 1, int(TARGET * len(found)))]) + 1 if len(found) else len(self.centres)
        error = [np.abs(self.approximate(q[i : i + 1], of[j], codes[j : j + 1])[0, 0] - scores[i, j]) for i in range(0, len(q), 8) for j in best[i, 1:]]
        self.slack = 1.5 * float(np.quantile(error, 0.999)) if error else 0.0

    def anchored(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of each query's k best anchors of other ids, best first; -inf where there are fewer."""
        ids, scores = [np.zeros((0, k), np.int64)], [np.zeros((0, k))]
        for at in range(0, len(q), 256):
            near = q[at : at + 256].astype(np.float32) @ self.anchors.astype(np.float32).T
            a, b = (np.searchsorted(self.ids, q_ids[at : at + 256], side=x) for x in ("left", "right"))
            for i in np.flatnonzero(b > a):
                near[i, a[i] : b[i]] = -np.inf
            first = np.argsort(-near, axis=1, kind="stable")[:, : k + 8]
            score = np.where(np.isfinite(np.take_along_axis(near, first, axis=1)), exact(q[at : at + 256][:, None, :], self.anchors[first]), -np.inf)
            order = np.lexsort((np.broadcast_to(first, score.shape), -score))[:, :k]
            score, first = np.take_along_axis(score, order, axis=1), np.take_along_axis(first, order, axis=1)
            short = ((0, 0), (0, k - first.shape[1]))
            ids.append(np.pad(self.ids[first], short))
            scores.append(np.pad(score, short, constant_values=-np.inf))
        return np.concatenate(ids), np.concatenate(scores)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each row."""
        x = x.astype(np.float32)
        of = nearest(x, self.centres)
        rest = x - self.centres[of]
        codes = [nearest(np.ascontiguousarray(rest[:, a:b]), book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        return of, np.stack(codes, axis=1).astype(np.uint8)

    def probes(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q.astype(np.float32) @ self.centres.T), axis=1, kind="stable")[:, : self.probe]

    def approximate(self, q: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of the rows of a list (down) with queries (across), by tables: one of each slice, with a line for each code, whose lines are added up."""
        q = q.astype(np.float32)
        out = np.repeat((q @ self.centres[of])[None, :], len(codes), axis=0)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            out += np.take(self.books[m] @ q[:, a:b].T, codes[:, m], axis=0)
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up from the first component to the last."""
    return np.cumsum(q.astype(np.float64) * rows.astype(np.float64), axis=-1)[..., -1]


def _first(q: np.ndarray, r: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (q, r), for each q the `most` with the largest scores; smaller r first at equal scores."""
    order = np.lexsort((r, -score, q))
    q, r = q[order], r[order]
    inside = np.arange(len(q)) - np.searchsorted(q, q, side="left") < most
    return q[inside], r[inside]


def may_reach(q: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each row (down) and query (across), False only if exact() is surely less than the query's bound."""
    with np.errstate(over="ignore", invalid="ignore"):  # what is not a number isn't left out
        error = 4 * q.shape[1] * (2.0**-52 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1).max(initial=0)) + 2.0**-1000)
        return ~(rows @ q.T < bound - error)


def search_list(index: Index, i: int, q: np.ndarray, bound: np.ndarray, rows: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and exact score of the pairs in list i that reach the query's bound, of the first RERANK x k by approximate score."""
    near, wide = index.approximate(q, i, codes), rows.astype(np.float64)
    r, of = np.nonzero((near >= (bound - index.slack)[None, :].astype(np.float32)) & may_reach(q.astype(np.float64), wide, bound))
    of, r = _first(of, r, near[r, of], RERANK * k + 1)
    s = np.concatenate([exact(q[of[x : x + 4096]], rows[r[x : x + 4096]]) for x in range(0, len(of), 4096)] or [np.zeros(0)])
    fit = s >= bound[of]
    return of[fit], r[fit], s[fit]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int, int]:
    """(id, v) of the rows that take part, their number, and their vectors' length."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    rows = rows.where(finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return rows, 0, 0
    return rows.where(F.size("v") == sizes.dim), sizes.n, sizes.dim


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; is_query is a condition on the column `id`."""
    spark = vectors.sparkSession
    rows, count, dim = usable(vectors, vec_id, vector)
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = rows.schema["v"].dataType.simpleString()
    lists = int(max(1, min(MAX_LISTS, round(count**0.5))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE_ROWS, 8 * lists)).toArrow()
    ids, sample = sample["id"].to_numpy(), _matrix(sample["v"], dim)
    index = Index(sample, max(1, min(lists, len(sample) // 8)))
    index.tune(ids, sample, k, max(k + 1, min(len(sample), count // 8)))
    n_lists = len(index.centres)
    shared = spark.sparkContext.broadcast(index)  # MAX_LISTS + CODES + SAMPLE_ROWS vectors, at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, codes = shared.value.place(_matrix(batch.column("v"), dim))
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), batch.column("id"), batch.column("v"), flat], ["list", "id", "v", "codes"])

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q_ids = batch.column("id").to_numpy()
            if len(q_ids):
                ids, score = shared.value.anchored(q_ids, _matrix(batch.column("v"), dim), k)
                there = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(q_ids, there.sum(axis=1)), ids[there], score[there])], ["query_id", "vec_id", "score"])

    scratch = Scratch(spark, "ann")
    placed = scratch.write(rows.mapInArrow(place, f"list int, id long, v {kind}, codes binary"), "index")
    sizes = dict(map(tuple, placed.groupBy("list").count().collect()))  # at most MAX_LISTS rows
    first, parts, at, held = np.zeros(n_lists, np.int32), np.ones(n_lists, np.int32), 0, 0  # a list's first group, and its groups
    for i in range(n_lists):
        n = sizes.get(i, 0)
        if held and held + n > ROW_CHUNK:
            at, held = at + 1, 0
        first[i], held = at, held + n
        if n > ROW_CHUNK:
            parts[i] = -(-n // ROW_CHUNK)
            at, held = at + int(parts[i]), 0
    queries = rows.where(is_query)
    chunks = -(-queries.count() // QUERY_CHUNK)
    groups = spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(n_lists)], "list int, first int, parts int")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed = placed.join(F.broadcast(groups), "list").withColumn("group", F.col("first") + part).drop("first", "parts")
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else placed.withColumn("chunk", F.lit(0))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and group that it visits, with its lists there."""
        for batch in batches:
            if batch.num_rows:
                v, ids = _matrix(batch.column("v"), dim), batch.column("id")
                bound = pa.array(shared.value.anchored(ids.to_numpy(), v, k)[1][:, -1])
                to: dict[tuple[int, int], list[int]] = {}
                for q, lists in enumerate(shared.value.probes(v).tolist()):
                    for i in lists:
                        for g in range(first[i], first[i] + parts[i]):
                            to.setdefault((q, g), []).append(i)
                again = pa.array([q for q, _ in to], pa.int64())
                columns = [pa.array([g for _, g in to], pa.int32()), ids.take(again), batch.column("v").take(again), bound.take(again), pa.array(list(to.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["group", "id", "v", "bound", "lists"])

    visits = queries.mapInArrow(visit, f"group int, id long, v {kind}, bound double, lists array<int>").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))

    def meet(key: tuple, queries: pa.Table, part: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and part.num_rows:
            part = part.sort_by([("list", "ascending"), ("id", "ascending")])
            ids, v, of = part["id"].to_numpy(), _matrix(part["v"], dim), part["list"].to_numpy()
            codes = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            q_ids, q_v, bound = queries["id"].to_numpy(), _matrix(queries["v"], dim), queries["bound"].to_numpy()
            asked = queries["lists"].combine_chunks()
            whose = np.repeat(np.arange(len(q_ids)), np.diff(asked.offsets.to_numpy()))
            asked = asked.flatten().to_numpy()
            for i in np.unique(of).tolist():
                low, high = np.searchsorted(of, [i, i + 1])
                every = whose[asked == i]
                for at in range(0, len(every), _BLOCK):
                    some = every[at : at + _BLOCK]
                    q, r, s = search_list(shared.value, i, q_v[some], bound[some], v[low:high], codes[low:high], k)
                    other = ids[low + r] != q_ids[some[q]]
                    out.append((some[q[other]], low + r[other], s[other]))
        q, r, s = (np.concatenate(x) for x in zip(*out))
        if len(q):  # the best of the group
            order = np.lexsort((ids[r], -s, q))
            q, r, s = q[order], r[order], s[order]
            inside = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
            q, r, s = q_ids[q[inside]], ids[r[inside]], s[inside]
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(r, pa.int64()), "score": pa.array(s, pa.float64())})

    cell = ("group", "chunk")
    found = visits.groupBy(*cell).cogroup(placed.groupBy(*cell)).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.unionByName(queries.mapInArrow(anchor, "query_id long, vec_id long, score double")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
