"""Exact top-k inner products of integer vectors by norm-bucketed retrieval.

Vectors are dealt by hash to shards; a shard sorts its vectors by length and cuts them
into buckets of similar length.  A query goes through a shard's buckets from long to
short.  With t, its k-th best product so far, a bucket whose longest vector is l needs a
cosine of at least t / (|q| l), the local threshold:

* over 1, neither this bucket nor a shorter one holds a better vector: the shard is done;
* at least HIGH, coordinates prune: on the query's FOCUS largest coordinates, a vector's
  part of the product, and Cauchy and Schwarz for the rest, must reach t;
* below, length prunes: vectors shorter than t / |q| are left out.

What is left is verified: whole products, for all queries of a block together.  Bounds
are loosened by a margin for rounding, products are exact integers, and ties go to the
smaller id, so the result is that of brute force.  Shards' best are merged by rank.

Queries are dealt into blocks as well: a task has one shard and one block of queries.

Defined results: vectors that are null, or hold a null, NaN or an infinity, take no part;
rows with the same vec_id are rows of their own, each a candidate of the others; a
shorter vector counts as filled up with zeros; an empty vector has the product 0 with
all; null vec_ids take no part; a query with less than k others gets all; products beyond
a long are held at its ends before they are ranked; columns besides id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

K, SCALE, QUERY_STEP = 20, 64, 20
#: Vectors of a length bucket; queries worked on together; least vectors and most shards; local cosine from which coordinates prune, and on how many.
BUCKET, QUERY_BLOCK, LEAST_SHARD, MOST_SHARD = 512, 256, 8_192, 262_144
#: Queries of a task.
TASK_QUERIES = 65_536
HIGH, FOCUS = 0.7, 8
_EXACT = 2.0**53


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id and v, floor(scale * x) of every component, of the vectors that take part; written, so that the numbers stay."""
    x = F.col("embedding")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double"))
    return written(vectors.where(F.col("vec_id").isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), v.alias("v")), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows filled up with zeros to the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pa.compute.list_value_length(column))
    out = np.zeros((len(column), max(1, int(size.max(initial=0)))))
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Shard:
    """Vectors by decreasing length, in buckets."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        norm = np.sqrt(np.square(vectors).sum(1))
        order = np.lexsort((ids, -norm))
        self.rows, self.ids, self.v, self.norm = rows[order], ids[order], vectors[order], norm[order]
        self.most = float(self.norm.max(initial=0))

    def best(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of query, vec_id, product) of each query's k best here, its own row apart."""
        width = max(self.v.shape[1], queries.shape[1])
        v = np.pad(self.v, ((0, 0), (0, width - self.v.shape[1])))
        q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        length = np.sqrt(np.square(q).sum(1))
        plain = length * self.most < _EXACT
        if plain.all():
            return self._plain(query_rows, q, length, v, k)
        found = [[np.zeros(0, np.int64)] * 3]
        if plain.any():
            i, *rest = self._plain(query_rows[plain], q[plain], length[plain], v, k)
            found.append([np.flatnonzero(plain)[i], *rest])
        found += [self._big(i, query_rows[i], q[i], length[i], v, k) for i in np.flatnonzero(~plain)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _plain(self, query_rows, q, length, v, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(q)
        top = np.full((n, k), -np.inf)
        who = np.full((n, k), np.iinfo(np.int64).max)
        live = np.arange(n)
        focus = np.argsort(-np.abs(q), axis=1)[:, :FOCUS]
        for lo in range(0, len(v), BUCKET):
            hi = min(lo + BUCKET, len(v))
            t = top[live, -1]
            reach = length[live] * self.norm[lo] * (1 + 1e-9) + 1e-6
            live = live[~(t > reach)]  # equal products may still win by their id
            if not len(live):
                break
            t = top[live, -1]
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(np.isfinite(t), t / (length[live] * self.norm[lo]), -1.0)
            sharp = live[local >= HIGH]
            for i in sharp:  # coordinates
                c = focus[i]
                part = v[lo:hi][:, c] @ q[i, c]
                rest = np.sqrt(np.maximum(0, length[i] ** 2 - np.square(q[i, c]).sum())) * np.sqrt(np.maximum(0, np.square(self.norm[lo:hi]) - np.square(v[lo:hi][:, c]).sum(1)))
                keep = np.flatnonzero(part + rest * (1 + 1e-9) + 1e-6 >= top[i, -1])
                if len(keep):
                    self._merge(top, who, np.array([i]), (v[lo:hi][keep] @ q[i])[None, :], self.ids[lo:hi][keep], self.rows[lo:hi][keep], query_rows)
            dull = live[~(local >= HIGH)]
            if len(dull):  # lengths: the block's least demanding query decides
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(length[dull] > 0, top[dull, -1] / length[dull], -np.inf).min() * (1 - 1e-9) - 1e-6
                end = lo + int(np.searchsorted(-self.norm[lo:hi], -need, side="right")) if need > 0 else hi
                if end > lo:
                    self._merge(top, who, dull, q[dull] @ v[lo:end].T, self.ids[lo:end], self.rows[lo:end], query_rows)
        row, col = np.nonzero(np.isfinite(top))
        return row, who[row, col], top[row, col].astype(np.int64)

    @staticmethod
    def _merge(top, who, rows, products, ids, their_rows, query_rows) -> None:
        products = np.where(their_rows[None, :] == query_rows[rows][:, None], -np.inf, products)
        k = top.shape[1]
        # Only products that reach the k-th best can enter.
        some = (products >= top[rows, -1][:, None]).any(1)
        rows, products = rows[some], products[some]
        if not len(rows):
            return
        p = np.concatenate([top[rows], products], 1)
        w = np.concatenate([who[rows], np.broadcast_to(ids, products.shape)], 1)
        w = np.where(np.isneginf(p), np.iinfo(np.int64).max, w)
        order = np.lexsort((w, -p), axis=1)[:, :k]
        top[rows], who[rows] = np.take_along_axis(p, order, 1), np.take_along_axis(w, order, 1)

    def _big(self, place: int, query_row, q, length, v, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A query with products that a double can't hold: those by Python's integers, the others as ever."""
        product = np.zeros(len(v), np.int64)
        fine = length * self.norm < _EXACT
        product[fine] = (v[fine] @ q).astype(np.int64)
        mine = [int(x) for x in q]
        for i in np.flatnonzero(~fine):
            product[i] = max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(mine, v[i]))))
        order = np.lexsort((self.ids, ~product))  # ~x falls as x rises, at the ends of a long too
        order = order[self.rows[order] != query_row][:k]
        return np.full(len(order), place), self.ids[order], product[order]


def top_products(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best among the other rows of vectors (row, vec_id, v, as of whole())."""
    n, asking = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    size = min(MOST_SHARD, max(LEAST_SHARD, -(-n // 64)))
    shards, parts = max(1, -(-n // size)), max(1, -(-asking // TASK_QUERIES))
    dealt = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Every query meets every shard: a stated set of queries against all rows, in blocks.
    stored = vectors.withColumn("shard", dealt(shards)).withColumn("part", each(parts))
    asked = vectors.where(is_query).withColumn("part", dealt(parts)).withColumn("shard", each(shards))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _result([], [], [], [])
        shard = Shard(left["row"].to_numpy(), left["vec_id"].to_numpy(), _matrix(left["v"]))
        rows, ids, queries = right["row"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["v"])
        out = []
        for i in range(0, len(ids), QUERY_BLOCK):
            place, who, product = shard.best(rows[i : i + QUERY_BLOCK], queries[i : i + QUERY_BLOCK], k)
            out.append(_result(rows[i + place], ids[i + place], who, product))
        return pa.concat_tables(out)

    schema = "query_row long, query_id long, vec_id long, score long"
    found = stored.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(lambda a, b: search(a, b), schema)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _result(*columns) -> pa.Table:
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_row", "query_id", "vec_id", "score"), columns)})


def op3_norm_buckets(spark, sf_dir: str) -> DataFrame:
    """The 20 best of every embedding whose vec_id is divisible by 20, against all rows."""
    return top_products(whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), F.col("vec_id") % QUERY_STEP == 0)


OP3_SQL = """
WITH w AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM w q, w c WHERE q.vec_id % 20 = 0 AND c.r <> q.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20
"""
