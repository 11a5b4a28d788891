"""Operator 3: approximate nearest neighbours by an inverted file of product-quantised residuals.

Coarse centroids (k-means, inner product search on a bounded sample of SAMPLE vectors
picked by hash) split the table into lists. A vector's residual to its centroid is
product-quantised: PARTS sub-vectors, each one of CODES codewords. A query probes the
lists of its best centroids; each list's vectors are scored by table look-ups (asymmetric
distance: query part x codeword, plus query x centroid), and the best are
reranked exactly, in double precision, on the original vectors.

Every vector is indexed. Small lists that follow each other share a block, so that a query
is copied once for all of them; a large list is cut into blocks by hash, and the queries that
probe a block into blocks too, so neither a large list nor one that very many queries want is one
task's. Each pair of blocks answers with its exactly scored best; a query's final best
come from those few rows. Vectors travel in the type they are given in, once for every BLOCK_QUERIES
queries that want their block; both that and the scoring grow with queries times vectors
while PROBED is a share of the lists.

If a query's probed lists hold fewer than `top` vectors although the table has more, all
lists are probed for it.

Defined cases: vectors that are null, zero, of another than the commonest length, or that
hold null or non-finite components take no part, nor do rows without vec_id; rows that
repeat a vec_id are one vector (the greatest); equal scores go by vec_id, also between
candidates of equal codes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import FloatType

from . import common

TOP = 20
QUERY_EVERY = 20
#: Bound of the training sample, in vectors.
SAMPLE = 20_000
PARTS, CODES = 16, 256
MAX_LISTS = 4096
#: Share of the lists that a query probes.
PROBED = 0.65
LEAST_PROBED = 32
#: Distinct codes first reranked exactly per pair of blocks (with all whose estimate equals the last one's), and how far the second look goes.
RERANK, SLACK = 96, 2.5
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048
#: Rows reranked, and queries expanded into their groups, at a time.
RERANK_ROWS, ASKED = 8_192, 64


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from distinct starting rows; a centroid left without rows stays where it is."""
    start = np.unique(x, axis=0)
    k = min(k, len(start))
    c = start[rng.choice(len(start), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1) - 2 * x[a : a + 4096] @ c.T).argmin(1) for a in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(near, weights=x[:, d], minlength=k)
            c[:, d] = np.where(n > 0, total / np.maximum(n, 1), c[:, d])
    return c


class Index:
    """Centroids and codebooks; all that grows with the data stays in tables."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float32)
        dims = sample.shape[1]
        self.centroids = kmeans(sample, lists, rng)
        residual = sample - self.centroids[self.nearest(sample)]
        self.cuts = np.array_split(np.arange(dims), min(PARTS, dims))
        self.books = [kmeans(residual[:, c], CODES, rng, 8) for c in self.cuts]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and the lengths of what the codes leave out."""
        x = x.astype(np.float32)
        lists = self.nearest(x)
        residual = x - self.centroids[lists]
        codes = np.stack([((b * b).sum(1) - 2 * residual[:, c] @ b.T).argmin(1) for c, b in zip(self.cuts, self.books)], 1)
        left = sum(((residual[:, c] - b[codes[:, i]]) ** 2).sum(1) for i, (c, b) in enumerate(zip(self.cuts, self.books)))
        return lists, codes.astype(np.uint8), np.sqrt(left)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(q.astype(np.float32) @ self.centroids.T), 1, kind="stable")[:, :n]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(parts, codes) of query part x codeword."""
        out = np.zeros((len(self.cuts), CODES), np.float32)
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            out[i, : len(b)] = b @ q[c].astype(np.float32)
        return out


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<float> where the input's is, else array<double>) of the vectors that take part."""
    kind = "float" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "double"
    v = F.transform(F.col("embedding"), lambda x: x.cast(kind))
    rows = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False))).groupBy("vec_id").agg(F.max("v").alias("v"))
    rows = common.materialise(rows, "vectors")
    common_size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common_size[0] if common_size else -1))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE) -> Index:
    share = min(1.0, sample / n)
    picked = vectors.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 40)) <= int(share * (1 << 40))).limit(2 * sample).select("v").toArrow().column(0).combine_chunks()
    dims = len(picked[0]) if len(picked) else 1
    x = _matrix(picked, dims) if len(picked) else np.zeros((1, dims))
    return Index(x, min(MAX_LISTS, max(1, round(math.sqrt(n) / 2))))


def grouped(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each list's group, and each group's number of parts: small neighbours share a group of one part, a large list is cut."""
    group, parts, filled = np.zeros(len(sizes), np.int64), [], BLOCK_ROWS + 1
    for k, n in enumerate(sizes.tolist()):
        if filled + n > BLOCK_ROWS:
            parts.append(max(1, math.ceil(n / BLOCK_ROWS)))
            filled = 0
        filled += n
        group[k] = len(parts) - 1
    return group, np.array(parts, np.int64)


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct one, and each row's class."""
    x = np.ascontiguousarray(x)
    _, first, own = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, own


def best_of(index: Index, have: tuple, want: Iterable[tuple], top: int, rerank: int) -> list[tuple[np.ndarray, ...]]:
    """(query ids, vector ids, scores) of each query's exactly scored best of a block's rows, nearest first.

    Estimates are made and counted by distinct code, so copies don't take the reranked places from
    others; of equal vectors only the top + 1 smallest ids can be among any query's best.
    The best `rerank` codes set a bar, the exact score of the top-th of them. Every code whose estimate
    comes within SLACK standard errors of it is then reranked too, however many there are. An estimate's error is
    the query times what the code leaves out: over all directions its deviation is |q| |left out| / sqrt(dimensions).
    """
    ids, x, codes, own, left = have
    _, same = _classes(x)
    order = np.lexsort((ids, same))
    same = same[order]
    order = order[np.arange(len(order)) - np.searchsorted(same, same) <= top]
    ids, x, codes, own, left = ids[order], x[order], codes[order], own[order], left[order]
    first, code = _classes(np.concatenate([own.astype("<i4").view(np.uint8).reshape(-1, 4), codes], 1))
    own, most = own[first], np.zeros(len(first))
    np.maximum.at(most, code, left)
    most *= SLACK / math.sqrt(x.shape[1])
    flat = np.ascontiguousarray((codes[first].astype(np.intp) + CODES * np.arange(codes.shape[1])).T)

    def scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[part].astype(np.float64) * q).sum(1) for part in np.array_split(rows, len(rows) // RERANK_ROWS + 1)])

    found = []
    for query, q, asked in want:
        in_asked = np.zeros(len(index.centroids), bool)
        in_asked[asked] = True
        at = np.flatnonzero(in_asked[own])
        if not len(at):
            continue
        estimate = index.tables(q).ravel().take(flat[:, at]).sum(0) + (index.centroids @ q.astype(np.float32))[own[at]]
        chosen = np.zeros(len(own), bool)
        # all whose estimate equals the last one's are reranked with it
        chosen[at[estimate >= np.partition(estimate, len(at) - rerank)[len(at) - rerank]] if len(at) > rerank else at] = True
        rows = np.flatnonzero(chosen[code] & (ids != query))
        exact = scores(rows, q)
        if len(at) > rerank and len(rows) >= top:
            bar = np.partition(exact, len(exact) - top)[len(exact) - top]
            near = np.zeros(len(own), bool)
            near[at[estimate + np.linalg.norm(q) * most[at] >= bar]] = True
            more = np.flatnonzero((near & ~chosen)[code] & (ids != query))
            rows, exact = np.concatenate([rows, more]), np.concatenate([exact, scores(more, q)])
        best = np.lexsort((ids[rows], -exact))[:top]
        best = best[np.isfinite(exact[best])]
        found.append((np.full(len(best), query), ids[rows[best]], exact[best]))
    return found


def search(rows: DataFrame, is_query, top: int = TOP, probed: float = PROBED, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's nearest other rows by inner product."""
    vectors = valid_vectors(rows)
    n = vectors.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n < 2:
        return rows.sparkSession.createDataFrame([], schema)
    index = fit(vectors, n)
    lists = len(index.centroids)
    probes = min(lists, max(LEAST_PROBED, math.ceil(lists * probed)))
    kind = vectors.schema["v"].dataType.simpleString()
    arrow_kind = pa.list_(pa.float32() if "float" in kind else pa.float64())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, codes, error = index.encode(_matrix(batch.column(1), len(batch.column(1)[0])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float32())], ["vec_id", "v", "list", "codes", "error"])

    indexed = common.materialise(vectors.mapInArrow(place, f"vec_id long, v {kind}, list int, codes binary, error float"), "indexed")
    # what is collected, here and below, has a row per list or group: MAX_LISTS at most
    sizes = np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").count().collect():
        sizes[r[0]] = r[1]
    group, parts = grouped(sizes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and group that holds lists which it probes."""
        for whole in batches:
            for a in range(0, whole.num_rows, ASKED):
                batch = whole.slice(a, ASKED)
                x = _matrix(batch.column(1), len(batch.column(1)[0]))
                found = ([], [], [], [])
                for query, vector, order in zip(batch.column(0).to_pylist(), x, index.probes(x, lists)):
                    chosen = order if sizes[order[:probes]].sum() <= top else order[:probes]
                    chosen = np.sort(chosen[sizes[chosen] > 0])
                    for g in np.unique(group[chosen]).tolist():
                        for column, value in zip(found, (query, vector, g, chosen[group[chosen] == g].astype("<i4").tobytes())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), arrow_kind, pa.int32(), pa.binary()))], ["query_id", "q", "group", "lists"])

    queries = vectors.where(is_query(F.col("vec_id"))).mapInArrow(ask, f"query_id long, q {kind}, group int, lists binary")
    asked = common.materialise(queries, "queries")
    wanted = np.zeros(len(parts), np.int64)
    for r in asked.groupBy("group").count().collect():
        wanted[r[0]] = r[1]
    at = lambda values, place: F.get(F.expr(f"array({','.join(map(str, values.tolist()))})"), F.col(place))
    vector_blocks, query_blocks = at(parts, "group"), at(-(-wanted // BLOCK_QUERIES), "group")
    own = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = indexed.select("*", at(group, "list").alias("group")).where(query_blocks > 0)
    left = left.select("group", own("vec_id", vector_blocks).alias("i"), every(query_blocks).alias("j"), "vec_id", "v", "list", "codes", "error")
    right = asked.select("group", own("query_id", query_blocks).alias("j"), every(vector_blocks).alias("i"), "query_id", "q", "lists")

    def score(key: tuple, have: pa.Table, want: pa.Table) -> pa.Table:
        found = []
        if have.num_rows and want.num_rows:
            dims = len(have.column("v")[0])
            column = lambda t, c: t.column(c).combine_chunks()
            codes = np.frombuffer(b"".join(have.column("codes").to_pylist()), np.uint8).reshape(have.num_rows, -1)
            block = (have.column("vec_id").to_numpy(), _matrix(column(have, "v"), dims), codes, have.column("list").to_numpy(), have.column("error").to_numpy())
            asking = zip(want.column("query_id").to_pylist(), _matrix(column(want, "q"), dims).astype(np.float64), (np.frombuffer(b, "<i4") for b in want.column("lists").to_pylist()))
            found = best_of(index, block, asking, top, rerank)
        types = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate([np.empty(0, t), *(f[k] for f in found)]).astype(t)) for k, t in enumerate(types)], ["query_id", "vec_id", "score"])

    scored = left.groupBy("group", "i", "j").cogroup(right.groupBy("group", "i", "j")).applyInArrow(score, "query_id long, vec_id long, score double")
    # a query has at most top rows from each pair of blocks it is in
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda c: c % QUERY_EVERY == 0)
