"""Hard negatives by a two-dimensional block matrix multiply.

Scores are the matrix of anchors times rows.  Rows are sorted by label and cut into blocks,
anchors are dealt into blocks, components into chunks; a task has one anchor block, one row
block and one chunk and gives a tile of partial int64 scores.  Tiles of one pair of blocks
are added up after a shuffle, and what they say is reduced at once: tiles never stand.

First each tile of equal labels gives an anchor's best rows, merged to its positives.  Then
each tile of different labels gives the best rows within the window of every anchor and
positive.  As blocks hold runs of the order by label, nearly every pair of rows is
multiplied in one of the two steps only.

Defined results: rows with a null id, label or vector, or with a null, NaN or infinite
component, take no part; rows with the same id are rows of their own, each the other's
candidate; a shorter vector counts as filled up with zeros; components are held within
2**24 on either side after scaling, so that sums of up to 32,768 of them fit a long; an
anchor without another row of its label, or a positive score below 0, gives no row; equal
scores stand in the order of ids; columns besides id, label and vector are not read; an
empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import finished, table, written

SCALE, ANCHOR_STEP, RELABEL_STEP, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LEAST_SHARE = 5, 5, 80
#: Anchors and rows of a tile; least width of a chunk of components and most chunks; a scaled component's bound.
TILE_ANCHORS, TILE_ROWS, LEAST_CHUNK, MOST_CHUNKS, BOUND = 512, 2_048, 32, 8, 2**24
#: Rows of a range of labels, which is one task when rows are put in order.
RANGE_ROWS = 131_072
_EXACT = 2**53


def in_order(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label and v, floor(scale * x) of every component, of the rows that take part; sorted by label and written."""
    x = F.col("embedding")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.least(F.floor(F.lit(scale) * c.cast("double")), F.lit(BOUND)), F.lit(-BOUND)).cast("int")
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(x, held).alias("v"))
    n = good.count()
    order = F.col("label"), F.xxhash64("vec_id")
    ranged = good.repartitionByRange(-(-max(1, n) // RANGE_ROWS), *order).sortWithinPartitions(*order)
    return written(ranged.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), "ordered")


def _blocks(ordered: DataFrame) -> tuple[Column, int]:
    """A row's block, runs of TILE_ROWS rows of a range, and the number of blocks; what is collected is a number for each range."""
    task, place = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in ordered.groupBy(task.alias("task")).count().collect()}
    first, total = [], 0
    for t in range(max(sizes, default=0) + 1):
        first.append(total)
        total += -(-sizes.get(t, 0) // TILE_ROWS)
    return (F.element_at(F.array(*map(F.lit, first)), task.cast("int") + 1) + F.floor(place / TILE_ROWS)).cast("int"), total


def _matrix(column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """Rows in the order given, filled up with zeros to the longest."""
    column = column.combine_chunks()
    size = np.asarray(pa.compute.list_value_length(column))
    out = np.zeros((len(column), max(1, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy()
    return out[order]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in int64: by doubles where those hold every sum."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


_PARTIAL = "i int, j int, tile binary, anchors binary, rows binary"
_CELL = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("tile", pa.binary()), ("anchors", pa.binary()), ("rows", pa.binary())])
_WHO = ["row", "vec_id", "label"]


def _partial(wanted):
    """A cell's partial tile: the anchors that wanted(their labels, the block's labels) keeps, against all rows of the block."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, chunk = (k.as_py() for k in key)
        keep = np.flatnonzero(wanted(right["label"].to_numpy(), np.unique(left["label"].to_numpy()))) if left.num_rows and right.num_rows else []
        if not len(keep):
            return _CELL.empty_table()
        order = np.lexsort((left["row"].to_numpy(), left["vec_id"].to_numpy()))
        keep = keep[np.argsort(right["row"].to_numpy()[keep])]
        tile = _product(_matrix(right["v"], keep), _matrix(left["v"], order))
        # Who stands in the tile's rows and columns goes along once, with the first chunk.
        who = [np.stack([t[c].to_numpy()[o] for c in _WHO]).astype(np.int64).tobytes() if chunk == 0 else None for t, o in ((right, keep), (left, order))]
        return pa.table([[i], [j], [tile.tobytes()], who[:1], who[1:]], schema=_CELL)

    return run


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of a pair of blocks' tiles; row, vec_id and label of its anchors and of its rows."""
    who = [np.frombuffer(next(x for x in table[c].to_pylist() if x is not None), np.int64).reshape(3, -1) for c in ("anchors", "rows")]
    total = np.zeros((who[0].shape[1], who[1].shape[1]), np.int64)
    for tile in table["tile"]:
        total += np.frombuffer(tile.as_buffer(), np.int64).reshape(total.shape)
    return total, *who


def _table(schema: str, **columns) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.table({n: pa.array(columns.get(n, []), pa.int64()) for n in names})


_POSITIVE = "anchor long, anchor_id long, label long, positive long, positive_id long, positive_score long"
_NEGATIVE = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, negative_id long, negative_score long"


def _positives(table: pa.Table, k: int) -> pa.Table:
    score, anchors, rows = _added(table)
    out: list[np.ndarray] = []
    for a in range(len(score)):
        fits = np.flatnonzero((rows[2] == anchors[2, a]) & (rows[0] != anchors[0, a]))
        best = fits[np.argsort(-score[a, fits], kind="stable")[:k]]  # rows stand in the order of ids
        out.append(np.stack([np.full(len(best), anchors[c, a]) for c in range(3)] + [rows[0, best], rows[1, best], score[a, best]]))
    return _table(_POSITIVE, **dict(zip((c.split()[0] for c in _POSITIVE.split(", ")), np.concatenate(out, 1))))


def least_score(positive: np.ndarray, share: int = LEAST_SHARE) -> np.ndarray:
    """The least score s with share * positive <= 100 * s, in steps that can't overflow."""
    return positive // 100 * share - (-(positive % 100) * share) // 100


def _negatives(table: pa.Table, asked: pa.Table, k: int, share: int) -> pa.Table:
    """Each positive's best rows of other labels within its window; asked: the block's anchors and positives."""
    score, anchors, rows = _added(table)
    at = {int(r): i for i, r in enumerate(anchors[0])}
    order, out = {}, []
    who, positive, positive_id, top = (asked[c].to_numpy() for c in ("anchor", "positive", "positive_id", "positive_score"))
    low = least_score(top, share)
    for p in range(len(who)):
        a = at.get(int(who[p]))
        if a is None:
            continue
        if a not in order:
            other = np.flatnonzero(rows[2] != anchors[2, a])
            other = other[np.argsort(-score[a, other], kind="stable")]
            order[a] = other, -score[a, other]
        other, falling = order[a]
        first = int(np.searchsorted(falling, -top[p]))
        best = other[first : min(first + k, int(np.searchsorted(falling, -low[p], side="right")))]
        if len(best):
            n = len(best)
            out.append(np.stack([np.full(n, x) for x in (anchors[0, a], anchors[1, a], positive[p], positive_id[p], top[p])] + [rows[1, best], score[a, best]]))
    columns = np.concatenate(out, 1) if out else np.zeros((7, 0), np.int64)
    return _table(_NEGATIVE, **dict(zip((c.split()[0] for c in _NEGATIVE.split(", ")), columns)))


def _top(df: DataFrame, keys: list[str], score: str, ident: list[str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ident))).where(F.col("rank") <= k)


def mined(ordered: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = LEAST_SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, from rows as of in_order()."""
    # Columns of their own: both sides of a cogroup that are one table's columns lose some on the way.
    anchors = ordered.where(is_anchor).select(*(F.col(c).alias(c) for c in ordered.columns))
    asking, width = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = max(1, -(-asking // TILE_ANCHORS))
    chunks = min(MOST_CHUNKS, max(2, -(-(width or 1) // LEAST_CHUNK)))
    size = -(-(width or 1) // chunks)
    block, blocks = _blocks(ordered)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    part = lambda of: F.pmod(F.xxhash64(of), F.lit(parts)).cast("int")
    cut = lambda df: df.withColumn("chunk", each(chunks)).withColumn("v", F.slice("v", F.col("chunk") * size + 1, F.lit(size)))
    left = cut(ordered.withColumn("j", block)).withColumn("i", each(parts))
    right = cut(anchors.withColumn("i", part("row"))).withColumn("j", each(blocks))
    cell = "i", "j", "chunk"

    def tiles(who: DataFrame, wanted) -> DataFrame:
        return left.groupBy(*cell).cogroup(who.groupBy(*cell)).applyInArrow(_partial(wanted), _PARTIAL)

    near = tiles(right, lambda mine, theirs: np.isin(mine, theirs)).groupBy("i", "j").applyInArrow(lambda t: _positives(t, positives), _POSITIVE)
    chosen = written(_top(near, ["anchor"], "positive_score", ["positive_id", "positive"], positives).drop("rank").where("positive_score >= 0"), "positives")
    # Positives of a block of anchors go to every block of rows, as the anchors do.
    asked = chosen.withColumn("i", part(F.col("anchor"))).withColumn("j", each(blocks))
    others = right.join(chosen.select(F.col("anchor").alias("row")).distinct(), "row", "left_semi")
    far = tiles(others, lambda mine, theirs: (len(theirs) > 1) | (mine != theirs[0]))
    found = far.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInArrow(lambda t, p: _negatives(t, p, negatives, share) if t.num_rows and p.num_rows else _table(_NEGATIVE), _NEGATIVE)
    return _top(found, ["anchor", "positive"], "negative_score", ["negative_id"], negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_summa_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose vec_id is divisible by 100, among all rows."""
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % RELABEL_STEP == 0, (label + 1) % LABELS).otherwise(label).alias("label"), "embedding")
    return finished(spark, lambda: mined(in_order(rows), F.col("vec_id") % ANCHOR_STEP == 0), "op11")


OP11_SQL = """
WITH w AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM w a, w b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
     p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.vec_id) <= 5
"""
