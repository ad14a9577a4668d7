"""SimHash near-duplicates at a similarity: anchors give candidates, shingle sets decide.

``simhash`` links fingerprints within two bits.  A Jaccard similarity of 0.8 moves some 38
of 253 bits, so here a fingerprint has BLOCKS blocks of 23 bits, each with the anchors of
the binary Golay code.  A text's home in a block is the anchor within the covering radius;
copies go to every anchor within radius plus EXCESS, in every block, and meet the homes
there.  Met pairs within MOST_BITS bits, of sizes that allow a similarity of LEAST, are
candidates; a candidate is a link only if the sets of shingles have that similarity.

Two texts meet surely if they differ in at most BLOCKS * (EXCESS + 1) - 1 = 21 bits, and
beyond that nearly always, as one near block of eleven is enough: of pairs at 38 bits 0.13 %
never meet, at 51 bits 3 %, of all pairs with a similarity of exactly 0.8 some 0.4 %; and
0.1 % of these are further apart than MOST_BITS.

Large groups cost links in proportion to their texts.  Both texts of a met pair see each
other, and each tries some of those that it sees, the nearest and some by hash.  A text is full
if it left any untried: a pair that nobody tried has two full texts.  Pairs that were tried,
links or not, make clusters.  A second covering, of all full texts, gives the met pairs between
clusters; within a cluster that isn't one component yet, texts and their sets are dealt into a
grid of tasks, which compare all of them and give only the links that join components.  So
PARTNERS decides what is tried first, not which links are found.  Anchors and clusters that
hold many texts are split, by counts of all anchors (45,056, whatever the corpus) and clusters.

Texts are known by 64-bit hashes of their keys: of n texts two collide with a chance of
n * n / 2**65.

Defined results: texts are the same if all shingles are, in any order; texts without a word
are equal; null and empty texts likewise; a null doc_id never names a component; repeated
rows, equal in doc_id (null included) and text, leave one row; an empty table gives no rows; columns of
any names pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.buffers import blocks, mixed, ragged, text_buffer
from tidemark.llm.shared import apart, map_arrow, with_columns_from_text, written
from tidemark.llm.simhash import BLOCK, SEED, components, cosets, majorities, shingle_hashes, syndromes

WORDS, WORDS_OF_64, BLOCKS, EXCESS, LEAST = 5, 4, 11, 1, 0.8
#: 38 bits are expected at a similarity of 0.8, with a deviation of 5.7.
MOST_BITS = 56
#: Rows of a task, about; rows of one anchor beyond which it is split; texts dealt out at once.
TASK_ROWS, PART_ROWS, DEAL = 120_000, 30_000, 4_000
#: Texts of a cluster that are compared with as many others in one task.
CLUSTER_ROWS = 2_000
#: Of each kind, nearest and by hash, the partners that a text tries first; choices held in a task before they are merged.
PARTNERS, HELD = 2, 300_000
#: Homes of one component at an anchor from which texts of that component skip them.
MANY = 64
#: Ids that are broadcast at most, some 40 bytes each; more are joined by a shuffle.
MOST_IDS = 500_000
#: Fixed value: anchors of a block, the words of the Golay code; a word's upper 12 bits number it.
ANCHORS = 4_096
_BITS = BLOCK * BLOCKS
#: A text at an anchor.
_AT = np.dtype([("f", "<u8", WORDS_OF_64), ("id", "<i8"), ("size", "<u4"), ("slot", "<u2")])
#: Numbers of 64 bits of a text's key: the fingerprint, two sums over the set, its size.
_KEY = WORDS_OF_64 + 3


def shingle_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, and n + 1 offsets."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    return h[new], np.searchsorted(row[new], np.arange(len(at)))


def wide_fingerprints(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> dict[str, object]:
    """A key of 56 bytes for each text: 32 of the fingerprint, two sums over the set of shingles and its size.  The first 32 bytes, of which three bits are zero, are the fingerprint: majorities over the shingles' hashes, scrambled for each 64 bits."""
    h, at = shingle_hashes(raw, offsets, words, SEED)
    lanes = [majorities(mixed(h + np.uint64(k)), at) for k in range(WORDS_OF_64)]
    lanes[-1] &= np.uint64((1 << (_BITS - 64 * (WORDS_OF_64 - 1))) - 1)
    values, by_text = shingle_sets(h, at)
    for k in (101, 102):
        total = np.append(np.uint64(0), np.cumsum(mixed(values + np.uint64(k)), dtype=np.uint64))
        lanes.append(total[by_text[1:]] - total[by_text[:-1]])
    data = np.stack([*lanes, np.diff(by_text).astype(np.uint64)], 1).astype("<u8").tobytes()
    return {"fp": [data[i : i + 8 * _KEY] for i in range(0, len(data), 8 * _KEY)]}


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, _KEY)


def fingerprint_blocks(keys: np.ndarray) -> np.ndarray:
    """The BLOCKS blocks of each fingerprint."""
    out = np.empty((len(keys), BLOCKS), np.int64)
    for k in range(BLOCKS):
        word, bit = divmod(BLOCK * k, 64)
        x = keys[:, word] >> np.uint64(bit)
        if bit + BLOCK > 64:
            x = x | keys[:, word + 1] << np.uint64(64 - bit)
        out[:, k] = (x & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
    return out


def slots(keys: np.ndarray, excess: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot): each text's home in every block; with an excess, all anchors within the covering radius plus it.  A slot is a block and an anchor."""
    blocks_ = fingerprint_blocks(keys)
    flat, no = blocks_.ravel(), np.tile(np.arange(BLOCKS) * ANCHORS, len(keys))
    row, syndrome = np.repeat(np.arange(len(keys)), BLOCKS), syndromes(blocks_.ravel()).astype(np.int64)
    patterns, starts = cosets(excess or 0)
    rows, found = [], []
    for p, s in zip(patterns, starts):
        near, at = ragged(p, s[syndrome], s[syndrome + 1] - s[syndrome])
        n = np.diff(at)
        rows.append(np.repeat(row, n))
        found.append(np.repeat(no, n) + ((np.repeat(flat, n) ^ near) >> (BLOCK - 12)))
    return np.concatenate(rows), np.concatenate(found)


def _grid(prints: DataFrame, excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each slot its first task, and into how many parts its copies and its homes are split."""

    def count(batch):
        keys = _keys(batch.column(0))
        total = np.zeros((2, BLOCKS * ANCHORS), np.int64)
        for i in range(0, len(keys), DEAL):
            for side in (0, 1):
                total[side] += np.bincount(slots(keys[i : i + DEAL], excess if side else None)[1], minlength=total.shape[1])
        on = np.flatnonzero(total.any(0))
        yield {"slot": on, "homes": total[0, on], "copies": total[1, on]}

    counts = map_arrow(prints.select("fp"), count, "slot long, homes long, copies long").groupBy("slot").agg(F.sum("homes"), F.sum("copies"))
    homes, copies = np.zeros((2, BLOCKS * ANCHORS), np.int64)
    for slot, n, m in counts.collect():  # at most BLOCKS * ANCHORS rows
        homes[slot], copies[slot] = n, m
    for_copies, for_homes = np.maximum(1, -(-copies // PART_ROWS)), np.maximum(1, -(-homes // PART_ROWS))
    load, tasks = np.where((for_copies > 1) | (for_homes > 1), TASK_ROWS, homes + copies), for_copies * for_homes
    first, task, held = np.zeros(BLOCKS * ANCHORS, np.int64), 0, 0
    for slot in range(BLOCKS * ANCHORS):
        if held and held + load[slot] > TASK_ROWS:
            task, held = task + 1, 0
        first[slot] = task
        held += int(load[slot])
        task += int(tasks[slot]) - 1
    return first, for_copies, for_homes


def _dealt(grid, excess: int):
    first, for_copies, for_homes = grid

    def run(batch):
        all_keys, all_ids, all_labels = _keys(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for i in range(0, len(all_keys), DEAL):
            keys, ids, labels = (x[i : i + DEAL] for x in (all_keys, all_ids, all_labels))
            chance = mixed(keys[:, WORDS_OF_64] + np.uint64(7))
            for side in (0, 1):
                row, slot = slots(keys, excess if side else None)
                mine, other = (for_copies, for_homes) if side else (for_homes, for_copies)
                part = (chance[row] % mine[slot].astype(np.uint64)).astype(np.int64)
                times = other[slot]
                k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, slot, part = (np.repeat(x, times) for x in (row, slot, part))
                task = first[slot] + (part * for_homes[slot] + k if side else k * for_homes[slot] + part)
                order = np.argsort(task, kind="stable")
                row, task = row[order], task[order]
                at = np.zeros(len(row), _AT)
                at["f"], at["id"], at["size"], at["slot"] = keys[row, :WORDS_OF_64], ids[row], keys[row, -1], slot[order]
                named = labels[row] != ids[row]
                edge = np.flatnonzero(np.append(True, np.diff(task) != 0)).tolist()
                for p, q in zip(edge, [*edge[1:], len(row)]):
                    on = np.flatnonzero(named[p:q])
                    yield {"task": [task[p]], "side": [side], "texts": [at[p:q].tobytes()], "named": [on.astype("<i4").tobytes()], "labels": [labels[row[p:q][on]].tobytes()]}

    return run


def _near(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray):
    """(i, j, bits) of fingerprints, b in order of their sizes, within MOST_BITS whose sizes allow LEAST; of one i, all come together or in later parts."""
    order = np.argsort(a_size, kind="stable")
    for i in range(0, len(a), 256):
        rows = order[i : i + 256]
        part, size = a[rows], a_size[rows].astype(np.int64)
        low = np.searchsorted(b_size, np.ceil(LEAST * float(size[0]) - 1e-9))
        high = np.searchsorted(b_size, np.floor(float(size[-1]) / LEAST + 1e-9), "right")
        for j in range(low, high, 2048):
            other = b[j : min(j + 2048, high)]
            rest = np.bitwise_count(part[:, None, 0] ^ other[None, :, 0])
            rest += np.bitwise_count(part[:, None, 1] ^ other[None, :, 1])
            r, c = np.divmod(np.flatnonzero(rest <= MOST_BITS), len(other))
            bits = np.bitwise_count(part[r] ^ other[c]).sum(1)
            sizes = size[r], b_size[c + j].astype(np.int64)
            on = (bits <= MOST_BITS) & (np.minimum(*sizes) >= LEAST * np.maximum(*sizes) - 1e-9)
            yield rows[r[on]], c[on] + j, bits[on]


def _met(batches):
    """(copies' ids, homes' ids, i, j, bits) of all that meet at an anchor and aren't of one component, part by part."""
    held: dict[int, list] = {0: [], 1: []}
    for batch in batches:
        for side, texts, named, labels in zip(*(batch.column(c).to_pylist() for c in ("side", "texts", "named", "labels"))):
            at = np.frombuffer(texts, _AT)
            label = at["id"].copy()
            label[np.frombuffer(named, "<i4")] = np.frombuffer(labels, "<i8")
            held[side].append((at, label))
    sides = []
    for side in (0, 1):
        at = np.concatenate([np.zeros(0, _AT), *(x for x, _ in held[side])])
        label = np.concatenate([np.zeros(0, np.int64), *(x for _, x in held.pop(side))])
        order = np.lexsort((at["size"], at["slot"]))
        sides.append((at[order], label[order]))
    (homes, home_labels), (copies, copy_labels) = sides
    for slot in np.unique(homes["slot"]):
        (p, q), (r, s) = np.searchsorted(homes["slot"], [slot, slot + 1]), np.searchsorted(copies["slot"], [slot, slot + 1])
        b, lb, a, la = homes[p:q], home_labels[p:q], copies[r:s], copy_labels[r:s]
        names, times = np.unique(lb, return_counts=True)
        large = names[times >= MANY]
        rest = ~np.isin(la, large)
        for mine, other in [(rest, slice(None)), *((la == x, lb != x) for x in large)]:
            x, lx, y, ly = a[mine], la[mine], b[other], lb[other]
            if len(x) and len(y):
                for i, j, bits in _near(np.ascontiguousarray(x["f"]), x["size"], np.ascontiguousarray(y["f"]), y["size"]):
                    on = lx[i] != ly[j]
                    yield slot, x["id"], y["id"], i[on], j[on], bits[on]


def _columns(names: str, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names.split())


def _first(order: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    """Of rows in an order by a, the first n of each a."""
    place = np.arange(len(order))
    begin = np.maximum.accumulate(np.where(np.append(True, a[order][1:] != a[order][:-1])[: len(order)], place, 0))
    return order[place - begin < n]


def _some(key, batches):
    """For each text of pairs that meet some of its partners: at each anchor all, if they are few, else the nearest (kind 0) and the first by a hash (kind 1), marked as more."""
    best, new = {0: [], 1: []}, {0: 0, 1: 0}
    for slot, a, b, i, j, bits in _met(batches):
        if not len(i):
            continue
        back = np.argsort((j - j.min()).astype(np.uint16), kind="stable")  # a part has at most 2,048 of b
        for of, with_, mine, other, near in ((a, b, i, j, bits), (b, a, j[back], i[back], bits[back])):
            edge = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            times = np.diff(np.append(edge, len(mine)))
            many = times > PARTNERS
            few = np.flatnonzero(np.repeat(~many, times))
            code = (mixed(mixed(with_[other].view(np.uint64)) + np.uint64(slot)) >> np.uint64(33)).astype(np.int64)
            for kind, value in ((0, near.astype(np.int64)), (1, code)):
                best[kind].append((of[mine[few]], with_[other[few]], value[few], np.zeros(len(few), bool)))
                if many.any():
                    least = np.minimum.reduceat(value << 32 | other, edge)[many]
                    best[kind].append((of[mine[edge[many]]], with_[least & 0xFFFFFFFF], least >> 32, np.ones(len(least), bool)))
                new[kind] += len(few) + int(many.sum())
                if new[kind] > max(HELD, len(best[kind][0][0])):
                    best[kind], new[kind] = [_least(best[kind])], 0
    for kind, found in best.items():
        if found:
            a, b, value, more = _least(found)
            yield _columns("a b kind value more", a, b, np.full(len(a), kind), value, more.astype(np.int64))


def _least(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of (a, b, value, more) in parts: each pair once and the PARTNERS least of each a, all marked as more if any was or any was left out."""
    a, b, value, more = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((value, b, a))
    order = order[np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))[: len(order)]]
    _, name = np.unique(a, return_inverse=True)
    marked = np.bincount(name, more, minlength=1) > 0
    marked |= np.bincount(name[order], minlength=len(marked)) > PARTNERS
    order = _first(order[np.lexsort((b[order], value[order], a[order]))], a, PARTNERS)
    return a[order], b[order], value[order], marked[name[order]]


def _all(key, batches):
    """All pairs that meet, each once in a task, the smaller id first."""
    held, size = [np.zeros((0, 2), np.int64)], 0
    for _, a, b, i, j, _ in _met(batches):
        pair = np.stack([a[i], b[j]], 1)
        pair.sort(1)
        held.append(pair)
        size += len(pair)
        if size > 2_000_000:
            held = [np.unique(np.concatenate(held), axis=0)]
            size = len(held[0])
            if size > 1_000_000:
                yield _columns("a b", *held[0].T)
                held, size = [held[0][:0]], 0
    yield _columns("a b", *np.unique(np.concatenate(held), axis=0).T)


def _dealt_out(prints: DataFrame):
    """prints (id, fp, label) by task of an anchor's homes and copies."""
    return map_arrow(prints.select("fp", "id", "label"), _dealt(_grid(prints, EXCESS), EXCESS), "task long, side int, texts binary, named binary, labels binary").groupBy("task")


def chosen(prints: DataFrame) -> DataFrame:
    """(a, b, a_full, b_full), a < b: the pairs that texts choose, and which of the two left partners untried."""
    some = _dealt_out(prints.withColumn("label", F.col("id"))).applyInArrow(_iterated(_some), "a long, b long, kind long, value long, more long")
    some = some.groupBy("a", "b", "kind").agg(F.min("value").alias("value"), F.max("more").alias("more"))
    by_text = Window.partitionBy("a", "kind")
    placed = some.withColumn("place", F.row_number().over(by_text.orderBy("value", "b"))).withColumn("full", (F.count("*").over(by_text) > PARTNERS) | (F.max("more").over(by_text) > 0))
    least = F.col("a") < F.col("b")
    full = [F.max(F.when(side, F.col("full")).otherwise(False)).alias(name) for side, name in ((least, "a_full"), (~least, "b_full"))]
    return placed.where(F.col("place") <= PARTNERS).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(*full)


def _full(some: DataFrame) -> DataFrame:
    """id of every text that left partners untried."""
    return some.select(F.explode(F.array(F.when(F.col("a_full"), F.col("a")), F.when(F.col("b_full"), F.col("b")))).alias("id")).where("id IS NOT NULL").distinct()


def _iterated(make):
    from collections.abc import Iterator

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(key, batches)

    # Spark reads what a function takes and gives from its annotations, as types and not as text.
    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _among(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of df that nodes (id) names: they stay where they are if the ids, counted here, are few."""
    return df.join(F.broadcast(nodes) if nodes.count() <= MOST_IDS else nodes, "id", "left_semi")


def _sets(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and its set, sorted hashes, of the texts that nodes (id) names."""

    def make(batch):
        raw, offsets = text_buffer(batch.column(1))
        for a, b, part, at in blocks(raw, offsets):
            values, by_text = shingle_sets(*shingle_hashes(part, at, WORDS, SEED))
            yield {"id": batch.column(0).slice(a, b - a), "set": [values[p:q].astype("<u8").tobytes() for p, q in zip(by_text, by_text[1:])]}

    texts = _among(marked.select("id", "text"), nodes)
    return map_arrow(texts.groupBy("id").agg(F.first("text").alias("text")), make, "id long, set binary")


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as sorted hashes, have a Jaccard similarity of LEAST."""
    both = np.sort(np.concatenate([x, y]))
    n = int((both[1:] == both[:-1]).sum())
    return 5 * n >= 4 * (len(both) - n)  # LEAST, in whole numbers


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of LEAST."""

    def make(batch):
        sets_ = [[np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in (2, 3)]
        on = [_alike(x, y) for x, y in zip(*sets_)]
        keep = pa.array(np.flatnonzero(on))
        yield {c: batch.column(k).take(keep) for k, c in enumerate("ab")}

    one = edges.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return map_arrow(two.select("a", "b", "x", "y"), make, "a long, b long")


def _within(key, batches):
    """Links of a cluster's texts of one or two parts, only such as join components."""
    held = [b for b in batches]
    t = pa.Table.from_batches(held).combine_chunks()
    order = np.argsort(_keys(t["fp"].combine_chunks())[:, -1], kind="stable")
    t = t.take(pa.array(order))
    keys, ids, part = _keys(t["fp"].combine_chunks()), t["id"].to_numpy(), t["part"].to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in t["set"].to_pylist()]
    _, root = np.unique(t["root"].to_numpy(), return_inverse=True)
    above = list(range(int(root.max()) + 1))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    f, size = np.ascontiguousarray(keys[:, :WORDS_OF_64]), keys[:, -1]
    x = np.flatnonzero(part == part.min())
    y = np.flatnonzero(part == part.max())  # the same rows, where the task has one part
    out = []
    for i, j, bits in _near(f[x], size[x], f[y], size[y]):
        for k in np.argsort(bits, kind="stable").tolist():
            a, b = int(x[i[k]]), int(y[j[k]])
            p, q = top(int(root[a])), top(int(root[b]))
            if p != q and _alike(sets[a], sets[b]):
                above[p] = q
                out.append((ids[a], ids[b]) if ids[a] < ids[b] else (ids[b], ids[a]))
    yield _columns("a b", *(np.array([o[k] for o in out], np.int64) for k in (0, 1)))


def _roots_joined(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, top) of the components that edges (a, b) make of components (id, root): a node without a root is its own."""
    ends = edges.select("a", "b")
    for c in "ab":
        ends = ends.join(roots.select(F.col("id").alias(c), F.col("root").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return components(ends.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()).select(F.col("node").alias("root"), F.col("root").alias("top"))


def _rooted(tops: DataFrame, roots: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """id, root and, under a name, the top of every node of nodes (id)."""
    named = nodes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return named.join(tops, "root", "left").select("id", "root", F.coalesce("top", "root").alias(name))


def _clusters(some: DataFrame, roots: DataFrame, prints: DataFrame) -> DataFrame:
    """cluster, id, fp, root, the cluster's size n, whether the text is full, and whether the cluster is open: holds full texts and isn't one component; of clusters that hold full texts."""
    named = _rooted(_roots_joined(some, roots), roots, _ends(some), "cluster").join(_full(some).withColumn("full", F.lit(True)), "id", "left").fillna(False, ["full"])
    some_full = named.groupBy("cluster").agg((F.min("root") < F.max("root")).alias("open"), F.count("*").alias("n"), F.max("full").alias("any")).where("any").drop("any")
    return named.join(some_full, "cluster").where("full or open").join(prints, "id")


def links(prints: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, root) of the components of all links of the distinct texts (id, fp) of marked (id, text)."""
    some = written(chosen(prints), "some")
    # All that is compared below, too, is among the texts of these pairs.
    sets = written(_sets(marked, written(_ends(some), "nodes")), "sets")
    roots = components(verified(some.select("a", "b"), sets)).withColumnRenamed("node", "id")
    if not some.where("a_full or b_full").limit(1).count():
        return roots
    named = written(_clusters(some, roots, prints), "clusters")
    # Between clusters: met pairs of full texts.
    met = written(_dealt_out(named.where("full").select("id", "fp", F.col("cluster").alias("label"))).applyInArrow(_iterated(_all), "a long, b long").distinct(), "met")
    between = written(verified(met, _among(sets, _ends(met))), "links-between")
    open_ = named.where("open")
    # Within clusters: a grid of parts.
    parts = F.ceil(F.col("n") / CLUSTER_ROWS).cast("int")
    cells = open_.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    within = written(cells.join(_among(sets, open_.select("id")), "id").groupBy("cluster", "p", "q").applyInArrow(_iterated(_within), "a long, b long"), "links-within")
    more = between.union(within)
    nodes = roots.select("id").union(more.select(F.explode(F.array("a", "b")))).distinct()
    return _rooted(_roots_joined(more, roots), roots, nodes, "top").select("id", F.col("top").alias("root"))


def deduplicated(df: DataFrame) -> DataFrame:
    """The rows of df with the least doc_id of their component, all columns kept.

    Of rows with that same doc_id and text, or with none and the same text, one stays; rows
    without a doc_id stay only where their component has no other.
    """
    held, back = apart(df)
    marked = with_columns_from_text(df.select(*held, F.col("doc_id").cast("long").alias("doc")), wide_fingerprints, "fp binary")
    marked = written(marked.withColumn("id", F.xxhash64("fp")), "wide")
    prints = written(marked.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc").alias("least"), F.count("*").alias("n")), "prints")
    roots = links(prints.select("id", "fp"), marked)
    named = prints.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = named.groupBy("root").agg(F.min("least").alias("best"))
    # Only texts that stand in several rows, or aren't their component's only one, can go.
    shared = named.join(best, "root").where((F.col("n") > 1) | ~F.col("least").eqNullSafe(F.col("best"))).select("id", "best")
    losing = written(marked.select("doc", "id").join(shared, "id").where(F.col("best").isNotNull() & ~F.col("doc").eqNullSafe(F.col("best"))).select("doc", "id").distinct(), "losing")
    few = losing.count() <= MOST_IDS
    gone = (F.broadcast(losing) if few else losing).select(F.col("doc").alias("gone_doc"), F.col("id").alias("gone_id"))
    kept = marked.join(gone, F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("id") == F.col("gone_id")), "left_anti")
    if marked.groupBy("doc", "id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc", "id"])
    return kept.select(*back)
