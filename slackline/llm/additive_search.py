"""Approximate nearest neighbours by additive quantisation (operator 4).

A vector's direction is written as the sum of one code word from each of several
full-dimensional codebooks, trained on the residuals of those before; its norm is
stored beside the codes. Encoding keeps a beam of the best partial sums. A search adds up
a query's look-up table at the codes, times the norm, keeps the best of each block of
the index, and ranks these anew by the exact inner product in double precision.

Cost: codebooks are fitted on a bounded sample (SAMPLE vectors, first by hash); every
vector is indexed. The index is dealt into blocks of BLOCK vectors and the queries into
blocks of QUERIES; each pair of blocks is one row of an equi-join on the index block, and
of each only the nearest few of a query leave it. No block grows with the data.

Defined results: vectors that are null, zero, or hold a null or a number that isn't finite
take no part, nor do those whose length isn't the table's most common one or whose id is
null; rows that repeat an id count once, with the smallest vector; equal scores go to
the smaller id; fewer candidates than asked for give fewer rows; an empty table none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.llm import storage

SAMPLE = 16_384
BLOCK, QUERIES = 8192, 512


@dataclass(frozen=True)
class AdditiveIndex:
    """books: (books, words, dimension)."""

    books: np.ndarray
    beam: int = 4

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) and norms of the vectors, by beam search."""
        norms = np.sqrt((x * x).sum(1))
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for at in range(0, len(x), 1024):
            codes[at : at + 1024] = self._beam(x[at : at + 1024] / norms[at : at + 1024, None])
        return codes, norms

    def _beam(self, x: np.ndarray) -> np.ndarray:
        n, d = x.shape
        rest = x[:, None, :]  # what each partial sum leaves
        path = np.empty((n, 1, 0), np.uint8)
        for book in self.books:
            width, words = rest.shape[1], len(book)
            left = (rest * rest).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, width, words) + (book * book).sum(1)
            keep = min(self.beam, width * words)
            best = np.argpartition(left.reshape(n, -1), keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(left.reshape(n, -1), best, 1), axis=1, kind="stable"), 1)
            source, word = best // words, best % words
            rest = np.take_along_axis(rest, source[:, :, None], 1) - book[word]
            path = np.concatenate([np.take_along_axis(path, source[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        return path[:, 0]

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Estimated inner products (queries, vectors) from look-up tables."""
        total = np.zeros((len(queries), len(codes)), np.float32)
        for book, code in zip(self.books, codes.T, strict=True):
            total += (queries @ book.T).astype(np.float32)[:, code]
        return total * norms.astype(np.float32)


def fit_index(x: np.ndarray, books: int = 12, words: int = 256, rounds: int = 6, seed: int = 3) -> AdditiveIndex:
    """Codebooks by k-means on directions and then on what each book leaves of them."""
    rng = np.random.default_rng(seed)
    rest = x / np.sqrt((x * x).sum(1))[:, None]
    words = min(words, len(rest))
    found = []
    for _ in range(books):
        book = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            nearest = ((book * book).sum(1) - 2 * rest @ book.T).argmin(1)
            number = np.bincount(nearest, minlength=words)
            sums = np.zeros_like(book)
            np.add.at(sums, nearest, rest)
            book[number > 0] = sums[number > 0] / number[number > 0, None]
        nearest = ((book * book).sum(1) - 2 * rest @ book.T).argmin(1)
        rest = rest - book[nearest]
        found.append(book)
    return AdditiveIndex(np.stack(found))


def first_best(score: np.ndarray, number: int) -> np.ndarray:
    """Places of the largest scores; of equal ones at the edge those that come first."""
    if len(score) <= number:
        return np.arange(len(score))
    edge = np.partition(score, len(score) - number)[len(score) - number]
    above, level = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
    return np.concatenate([above, level[: number - len(above)]])


def copies_before(x: np.ndarray) -> np.ndarray:
    """For each row, the number of equal rows above it."""
    _, group = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0], return_inverse=True)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    before = np.empty(len(x), np.int64)
    before[order] = np.arange(len(x)) - np.repeat(starts, np.diff(starts, append=len(x)))
    return before


_BLOCK = "block int, ids binary, codes binary, norms binary, vectors binary"
_QUERIES = "part int, query_ids binary, query_vectors binary"
_FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int = 512) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by ``every``."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = given.filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    common = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = common[0]["d"] if common else 1
    rows = storage.written(sound.filter(F.size("v") == dimension).groupBy("vec_id").agg(F.min("v").alias("v")), "search-rows")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect() if total else []
    spark = vectors.sparkSession
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit_index(np.array([r["v"] for r in sample], np.float64))
    blocks = -(-total // BLOCK)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x = _matrix(table.column("v"), dimension)
        useful = copies_before(x) <= k  # of equal vectors only the k smallest ids, and one for a query's own, can be among the nearest
        table, x = table.filter(pa.array(useful)), x[useful]
        codes, norms = index.encode(x)
        ids = table.column("vec_id").to_numpy()
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "codes": [codes.tobytes()], "norms": [norms.astype("<f8").tobytes()], "vectors": [x.astype("<f8").tobytes()]})

    def pack_queries(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "query_ids": [table.column("vec_id").to_numpy().astype("<i8").tobytes()], "query_vectors": [_matrix(table.column("v"), dimension).astype("<f8").tobytes()]})

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, queries = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["query_ids"], "<i8")
                norms, x = np.frombuffer(row["norms"], "<f8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, dimension)
                codes, q = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["query_vectors"], "<f8").reshape(-1, dimension)
                found = []
                for at in range(0, len(q), 64):
                    for estimate, own, vector in zip(index.scores(q[at : at + 64], codes, norms), queries[at : at + 64], q[at : at + 64], strict=True):
                        places = first_best(np.where(ids == own, -np.inf, estimate), rerank)
                        places = places[ids[places] != own]
                        exact = (x[places] * vector).sum(1)
                        order = np.lexsort((ids[places], -exact))[:k]
                        found.append((np.full(len(order), own), ids[places][order], exact[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    deal = lambda c, n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(c)
    asked = rows.filter(F.col("vec_id") % every == 0)
    parts = -(-asked.count() // QUERIES) or 1
    packed = storage.written(rows.select(deal("block", blocks), "vec_id", "v").groupBy("block").applyInArrow(pack, _BLOCK), "search-blocks")
    asked = asked.select(deal("part", parts), "vec_id", "v").groupBy("part").applyInArrow(pack_queries, _QUERIES)
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")
    found = pairs.mapInArrow(search, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
