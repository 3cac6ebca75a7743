"""Jaccard join of word-shingle sets with a count-vector R-tree.

Tokens (shingle hashes) are hashed into `GROUPS` groups; a document's group counts are a point. Two
sets overlap in no more than the sum of the coordinate minima of their points, and for a box of
points the upper corner takes the point's place, so a tree of boxes finds the points that a set may
be linked to. Large sets have more groups, so that the bound stays sharp; points fold to fewer
groups by adding, as the tree and pairs of unlike sizes need. What survives is verified on the sets
themselves.

At scale the index is dealt out in blocks: two sets that are linked share one of the tokens that
come first in a common order of all tokens (one fifth of a set, rounded up), so each such token is a
block, and every link lies within a block. The order puts tokens of busy buckets of a corpus-wide
count last, which keeps blocks of common passages out. Equal sets are one class before any of this.

Only the components of the link graph are asked for, so pairs are not expanded within groups. First
each member of a block is held against the block's centre, the member that shares the most of its
first tokens with others: copies that differ in places of their own meet in the text they were
made from. What is verified is contracted. Blocks that still hold several components are searched
in rounds: each member names its few nearest members of other components that all bounds leave
open, these are verified, linked components are contracted, refuted pairs are remembered, and the
number a member may name grows from round to round. The rounds end when no member had to leave any out and
nothing is open, so no pair of different components goes unseen and no link between components is
lost. A block's token is the first that a pair shares in one of its blocks, so there the tokens
that come after it bound the overlap as well; of blocks with the same members only the first is searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import byte_chunks, cut, drop, release
from quernel.llm.graph import components

SHINGLE = 5
#: Linked: PERCENT * size of the union is not above 100 * size of the intersection.
PERCENT = 80
GROUPS = 64
MOST_GROUPS = 1 << 20
SKETCH_BITS = 20
_PARTS = 64
#: Tasks' partial counts that one group sums.
_FAN_IN = 64
LEAF = 16
#: Larger blocks are dealt to cells of two such tiles each.
TILE_ROWS = 2000
#: Members of other components that a member names in the first round, and how that grows.
NAMED, GROWTH = 8, 8
_FULL = 15

_MULT, _MULT_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LONG_WORD = 256


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return values, blank


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full((1 << bits) - 1, m, np.uint64))]).astype(np.uint64) for m in (_MULT, _MULT_INV))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of the words of texts that lie end to end; ASCII letters without case."""
    values, blank = _tables()
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    solid = ~blank[data]
    starts_row = np.zeros(n + 1, bool)
    starts_row[at] = True
    begin = solid.copy()
    begin[1:] &= blank[data[:-1]] | starts_row[1:n]
    end = solid.copy()
    end[:-1] &= blank[data[1:]] | starts_row[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _powers(max(20, int(n).bit_length()))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * power[:n], out=sums[1:])
    hashes = _mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
    for k in np.flatnonzero(e - s > _LONG_WORD):
        hashes[k] = xxhash.xxh3_64_intdigest(data[s[k] : e[k]].tobytes().lower(), 1)
    return hashes, np.searchsorted(at, s, "right") - 1


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): row k's set is tokens[bounds[k]:bounds[k + 1]], sorted and distinct.

    A text of fewer words than a shingle has one token for all of them; one without words has none.
    """
    rows = len(at) - 1
    words, of = word_hashes(data, at)
    counts = np.bincount(of, minlength=rows)
    first = np.append(0, np.cumsum(counts))
    grams, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(words) - size + 1
    if m > 0:
        h = words[:m].copy()
        for k in range(1, size):
            h = h * _STEP + words[k : k + m]
        whole = of[:m] == of[size - 1 :]
        grams, owner = _mixed(h[whole]), of[:m][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        lone = [xxhash.xxh3_64_intdigest(words[first[k] : first[k + 1]].tobytes(), int(counts[k])) for k in short]
        grams, owner = np.append(grams, np.array(lone, np.uint64)), np.append(owner, short)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.append(0, np.cumsum(np.bincount(owner, minlength=rows)))


SETS = "doc_id long, n long, s1 long, s2 long, part int, counts binary"


def _sets(docs: DataFrame) -> DataFrame:
    """A row for each document (size and 128-bit name of its set), and rows of a corpus-wide count of token buckets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            names, sizes = [], []
            for _, _, data, at in byte_chunks(batch.column(1)):
                tokens, bounds = shingle_sets(data, at)
                busy += np.bincount((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(busy)).astype(np.uint32)
                sizes.append(np.diff(bounds))
                for a, b in zip(bounds, bounds[1:], strict=False):
                    names.append(xxhash.xxh3_128_digest(tokens[a:b].tobytes()))
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64)), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "n", "s1", "s2", "part", "counts"])
        if busy.any():
            blank = pa.nulls(_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, blank, blank, pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(busy, _PARTS)], pa.binary())], names=["doc_id", "n", "s1", "s2", "part", "counts"])

    return docs.mapInArrow(of, SETS)


def _busy(rows: DataFrame) -> np.ndarray:
    """Bucket counts of all tasks, summed by parts in a tree of `_FAN_IN` branches; 4 MB whatever the corpus."""

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in part["counts"])
        return pd.DataFrame({"part": [key[0]], "task": [key[1]], "counts": [np.minimum(total, (1 << 31) - 1).astype(np.uint32).tobytes()]})

    some = rows.filter(F.col("part").isNotNull()).select("part", F.spark_partition_id().alias("task"), "counts")
    most = some.agg(F.max("task")).first()[0] or 0
    while True:
        some = some.withColumn("task", F.floor(F.col("task") / _FAN_IN).cast("int")).groupBy("part", "task").applyInPandas(add, "part int, task int, counts binary")
        if most < _FAN_IN:
            break
        most //= _FAN_IN
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    step = len(out) // _PARTS
    for row in some.toLocalIterator():
        out[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["counts"], np.uint32)
    return out


def first_tokens(tokens: np.ndarray, bounds: np.ndarray, busy: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds) of the part of each set that a linked set must share a token with."""
    n = np.diff(bounds)
    take = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    key = busy[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | tokens >> np.uint64(32)
    order = np.lexsort((key, owner))  # stable: tokens are sorted, so equal keys keep one order
    rank = np.arange(len(tokens)) - np.repeat(bounds[:-1], n)
    return tokens[order][rank < np.repeat(take, n)], np.append(0, np.cumsum(take))


def groups_of(n: int) -> int:
    """Groups of a set of n: a power of two, no less than n, so that few tokens share a group by chance."""
    return min(max(GROUPS, 1 << max(0, n - 1).bit_length()), MOST_GROUPS)


def point(tokens: np.ndarray) -> np.ndarray:
    """Group counts of a set; a count beyond what half a byte holds stands for any count."""
    g = groups_of(len(tokens))
    return np.minimum(np.bincount((tokens & np.uint64(g - 1)).astype(np.int64), minlength=g), _FULL).astype(np.uint8)


def stored(at: np.ndarray) -> bytes:
    """A point with two counts to a byte."""
    return (at[0::2] | at[1::2] << 4).tobytes()


def loaded(held: np.ndarray) -> np.ndarray:
    """Points (the last axis) of such bytes."""
    return np.stack([held & 15, held >> 4], axis=-1).reshape(*held.shape[:-1], -1)


def folded(at: np.ndarray, groups: int) -> np.ndarray:
    """Points (the last axis) in fewer groups."""
    if at.shape[-1] == groups:
        return at
    return np.minimum(at.reshape(*at.shape[:-1], -1, groups).sum(axis=-2, dtype=np.int64), _FULL).astype(np.uint8)


NODES = "node long, n long, point binary, tokens array<long>"


def _nodes(docs: DataFrame, busy: np.ndarray, percent: int) -> DataFrame:
    """The first document of each set in each task, with its point and first tokens."""
    held = docs.sparkSession.sparkContext.broadcast(busy)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, at in byte_chunks(batch.column(1)):
                tokens, bounds = shingle_sets(data, at)
                names = [xxhash.xxh3_128_digest(tokens[x:y].tobytes()) for x, y in zip(bounds, bounds[1:], strict=False)]
                new = np.zeros(b - a, bool)
                for k, name in enumerate(names):
                    if bounds[k + 1] > bounds[k] and name not in seen:
                        seen.add(name)
                        new[k] = True
                if not new.any():
                    continue
                n = np.diff(bounds)
                tokens, bounds = tokens[np.repeat(new, n)], np.append(0, np.cumsum(n[new]))
                firsts, ends = first_tokens(tokens, bounds, held.value, percent)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(firsts.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][new].astype(np.int64)), pa.array(n[new]), pa.array([stored(point(tokens[x:y])) for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary()), lists], names=["node", "n", "point", "tokens"])

    return docs.mapInArrow(of, NODES)


def needed(n1: Column | int, n2: Column | int, percent: int = PERCENT):
    """The least overlap of linked sets of these sizes: percent / (100 + percent) of their sum, rounded up."""
    return (percent * (n1 + n2) + (99 + percent)) // (100 + percent)


def overlap_bound(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """The summed coordinate minima; groups that are full in both bound nothing."""
    both = np.minimum(p1, p2)
    return both.sum(axis=-1, dtype=np.int64) + ((both == _FULL).sum(axis=-1, dtype=np.int64) << 40)


def may_link(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Row by row: whether the summed coordinate minima reach the overlap needed."""
    return overlap_bound(p1, p2) >= needed(n1, n2, percent)


class Points:
    """Stored points by number, in blocks of equal length; pairs are compared in the fewer of their groups."""

    def __init__(self, stored: list[bytes]):
        self.size = np.array([2 * len(x) for x in stored], np.int64)
        self.place = np.zeros(len(stored), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for g in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == g)
            self.place[at] = np.arange(len(at))
            self.of[g] = loaded(np.frombuffer(b"".join(stored[k] for k in at), np.uint8).reshape(len(at), g // 2))

    def bounds(self, a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
        """The overlap bound of each pair of numbers."""
        out = np.zeros(len(a), np.int64)
        kinds = self.size[a] << 24 | self.size[b]
        for kind in np.unique(kinds).tolist():
            g, h = kind >> 24, kind & ((1 << 24) - 1)
            rows = np.flatnonzero(kinds == kind)
            for k in range(0, len(rows), step):
                at = rows[k : k + step]
                left, right = self.of[g][self.place[a[at]]], self.of[h][self.place[b[at]]]
                out[at] = overlap_bound(folded(left, min(g, h)), folded(right, min(g, h)))
        return out


class CountTree:
    """R-tree for overlap search in a block: boxes keep upper corners, least sizes, the most tokens that follow, and components."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, rest: np.ndarray, component: np.ndarray, leaf: int = LEAF):
        self.order, self.leaf = np.lexsort((sizes, component)), leaf
        level = tuple(x[self.order] for x in (sizes, at, rest, component, component))
        self.levels = [level]
        while len(level[0]) > leaf:
            cuts = np.arange(0, len(level[0]), leaf)
            how = (np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            level = tuple(f.reduceat(x, cuts, axis=0) for f, x in zip(how, level, strict=True))
            self.levels.append(level)

    def search(self, n: int, at: np.ndarray, rest: int, component: int, percent: int = PERCENT) -> np.ndarray:
        """Places (as given at the start) of points of other components that the set may be linked to."""
        here = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            least, tops, follow, low, high = self.levels[level]
            here = here[(low[here] != component) | (high[here] != component)]
            need = needed(n, np.maximum(least[here], -(-n * percent // 100)), percent)
            here = here[(np.minimum(follow[here], rest) + 1 >= need) & (least[here] * percent <= n * 100)]
            here = here[overlap_bound(at, tops[here]) >= needed(n, least[here], percent)]
            if level:
                here = (here[:, None] * self.leaf + np.arange(self.leaf)).ravel()
                here = here[here < len(self.levels[level - 1][0])]
        return self.order[here]


def _token_rows(nodes: DataFrame) -> DataFrame:
    """(token, node, rest): rest is how many tokens of the set come after this one in the common order."""
    return nodes.select("node", "n", F.posexplode("tokens").alias("at", "token")).select("token", "node", (F.col("n") - F.col("at") - 1).cast("int").alias("rest"))


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b), by their whole sets."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in byte_chunks(batch.column(1)):
                tokens, bounds = shingle_sets(data, at)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "tokens"])

    # by a shuffle whatever the number of ids, so that the plan of a small table is that of a large one
    sets = cut(docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(of, "doc_id long, tokens array<long>"))
    release(docs.sparkSession)
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("_a")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    out = cut(both.filter(shared * 100 >= percent * (F.size("_a") + F.size("_b") - shared)).select("a", "b").distinct())
    drop(sets)
    return out


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose points leave a link open."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("point").alias("_pa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("point").alias("_pb"))
    sized = pairs.join(a, "a").join(b, "b").filter(F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            m, n = batch.num_rows, [c[k].to_numpy(zero_copy_only=False) for k in ("_na", "_nb")]
            points = Points(c["_pa"].to_pylist() + c["_pb"].to_pylist())
            keep = pa.array(points.bounds(np.arange(m), np.arange(m) + m) >= needed(*n, percent))
            yield pa.RecordBatch.from_arrays([c["a"].filter(keep), c["b"].filter(keep)], names=["a", "b"])

    return sized.mapInArrow(of, "a long, b long")


_CELL = ("token", "i", "j")
_FOUND = "a long, b long, token long"


def _cell_pairs(cell: pd.DataFrame, named: int, percent: int) -> set[tuple]:
    """(a, b, null) with a < b: each member's `named` nearest of other components; (null, null, token) if one has more."""
    node, n, component, tile, rest = (cell[c].to_numpy() for c in ("node", "n", "component", "tile", "rest"))
    if (component == component[0]).all():
        return set()
    held, tiles = cell["point"].tolist(), cell["i"].iloc[0] != cell["j"].iloc[0]
    at = np.array([folded(loaded(np.frombuffer(x, np.uint8)), GROUPS) for x in held])
    points, tree, found = Points(held), CountTree(n, at, rest, component), set()
    for k in range(len(node)):
        near = tree.search(int(n[k]), at[k], int(rest[k]), component[k], percent)
        if tiles:
            near = near[tile[near] != tile[k]]
        bound = points.bounds(np.full(len(near), k), near)
        may = bound >= needed(int(n[k]), n[near], percent)
        near, bound = near[may], bound[may]
        if len(near) > named:
            found.add((None, None, int(cell["token"].iloc[0])))
            share = np.minimum(bound, np.minimum(n[near], n[k])) / (n[near] + n[k])
            near = near[np.lexsort((node[near], -share))[:named]]
        found.update((int(min(node[k], node[x])), int(max(node[k], node[x])), None) for x in near)
    return found


def _between(rows: DataFrame, named: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components within cells (token, i, j) that all bounds leave open, and tokens whose members had more of them.

    A cell has two tiles at most. Cells follow each other in sorted partitions; one is held at a time.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(pairs: set) -> pa.RecordBatch:
            columns = list(zip(*pairs, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 3, strict=True)], names=["a", "b", "token"])

        left = None
        for batch in batches:
            part = batch.to_pandas()
            if left is not None:
                part = pd.concat([left, part], ignore_index=True)
            if not len(part):
                continue
            keys = part[list(_CELL)].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = [0, *cuts.tolist()]
            pairs: set[tuple] = set()
            for a, b in zip(starts, starts[1:], strict=False):
                pairs |= _cell_pairs(part.iloc[a:b], named, percent)
            left = part.iloc[starts[-1] :]
            yield done(pairs)
        if left is not None and len(left):
            yield done(_cell_pairs(left, named, percent))

    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(of, _FOUND).distinct()


def _cells(shared: DataFrame, linked: DataFrame, at: DataFrame, tile_rows: int) -> DataFrame:
    """Rows of blocks that hold several components, dealt to cells.

    A block's largest component has tiles of its own, and no cell holds two of these: its members
    are held against the others, so a block that is nearly one component costs little more than its rows.
    """
    part = shared.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    part = cut(part.select("token", "node", "rest", "component"))
    # of blocks with the same members, the one whose token comes first has the most rest
    members = F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y"), F.count(F.lit(1)).alias("_m"), F.sum("rest").alias("_rest")
    by = part.groupBy("token", "component").agg(*members)
    sums = F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"), F.sum("_m").alias("_m"), F.sum("_rest").alias("_rest")
    mixed = by.groupBy("token").agg(F.count(F.lit(1)).alias("_k"), F.max(F.struct("_m", "component")).alias("_top"), *sums).filter(F.col("_k") > 1)
    mixed = mixed.groupBy("_x", "_y", "_m").agg(F.max(F.struct("_rest", "token", "_top")).alias("_first"))
    small = F.col("_m") <= tile_rows
    own, rest = F.when(small, 0).otherwise(F.col("_first._top._m")), F.when(small, F.col("_m")).otherwise(F.col("_m") - F.col("_first._top._m"))
    mixed = cut(mixed.select("_first.token", F.col("_first._top.component").alias("_top"), *[F.ceil(x / tile_rows).cast("int").alias(y) for x, y in ((own, "_own"), (rest, "_others"))]))
    # a small block is one cell, as if it had no largest component
    tiled = part.join(mixed, "token").withColumn("_is", (F.col("component") == F.col("_top")) & (F.col("_own") > 0))
    h = F.xxhash64("node")
    tiled = tiled.withColumn("tile", F.when(F.col("_is"), F.pmod(h, F.greatest("_own", F.lit(1)))).otherwise(F.col("_own") + F.pmod(h, F.col("_others"))).cast("int"))
    last = F.col("_own") + F.col("_others") - 1
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.when(F.col("_is"), F.col("_own")).otherwise(F.lit(0)), last)))
    cells = tiled.select("token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "rest", "component")
    return cells.join(at, "node")


def join(docs: DataFrame, percent: int = PERCENT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Null and empty texts, and those of white space, have no shingles and stand alone. Repeated rows
    stay repeated rows of one document. Rows without an id are of no use to a join by id and get
    null for both results. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = every.filter(F.col("doc_id").isNotNull())
    found = cut(_sets(texts))
    sets = found.filter(F.col("part").isNull()).drop("part", "counts")
    busy = _busy(found)
    classes = sets.filter(F.col("n") > 0).groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id"))
    member = cut(sets.filter(F.col("n") > 0).join(classes, ["s1", "s2"]).select("doc_id", "n", "class_id"))

    # a class of equal sets is one node, named by its least document; each task has sent one document of it
    sent = cut(_nodes(texts, busy, percent))
    one = sent.select(F.col("node").alias("doc_id")).join(member.select("doc_id", "class_id").distinct(), "doc_id").groupBy("class_id").agg(F.min("doc_id").alias("node"))
    at = cut(sent.join(one, "node").dropDuplicates(["node"]).withColumn("node", F.col("class_id")).drop("class_id"))
    drop(sent)
    rows = _token_rows(at)
    blocks = cut(rows.groupBy("token").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter(F.col("_a") < F.col("_b")).select("token"))
    shared = cut(rows.join(blocks, "token"))
    drop(blocks)
    release(spark)
    # how many of its first tokens a node shares; the greatest in a block is the block's centre
    degree = shared.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    centres = shared.join(degree, "node").groupBy("token").agg(F.max(F.struct("degree", (-F.col("node")).alias("_node"))).alias("_c"))
    centres = centres.select("token", (-F.col("_c._node")).alias("centre"))
    held = cut(shared.join(centres, "token").filter(F.col("node") != F.col("centre")))
    drop(shared)
    release(spark)
    points = at.select("node", "n", "point")
    near = cut(_bounded(held.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), points, percent))
    links = _verified(near, texts, percent)
    drop(near)
    release(spark)

    # centres are settled, so they are no rows of the blocks that are searched
    rest, refuted, linked, named = held.select("token", "node", "rest"), None, None, NAMED
    while True:
        linked = linked if linked is not None else components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        found_now = cut(_between(_cells(rest, linked, points, tile_rows), named, percent))
        release(spark)
        new = found_now.filter("token is null").select("a", "b")
        new = cut(new if refuted is None else new.join(refuted, ["a", "b"], "left_anti").select("a", "b"))
        if not new.isEmpty():
            good, links_before, refuted_before = _verified(new, texts, percent), links, refuted
            bad = new.join(good, ["a", "b"], "left_anti")
            refuted = cut(bad if refuted is None else refuted.unionByName(bad))
            links = cut(links.unionByName(good))
            if not good.isEmpty():
                linked = None
            drop(new, good, links_before, refuted_before)
            release(spark)
        # a block none of whose members left any out has nothing more to say
        open_ = cut(found_now.filter("token is not null").select("token").distinct())
        drop(found_now)
        if open_.isEmpty():
            break
        before, rest = rest, cut(rest.join(open_, "token", "left_semi"))
        drop(before, open_)
        named *= GROWTH
    drop(held, rest, at, refuted)

    whole = linked if linked is not None else components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    out = member.join(whole, member["class_id"] == whole["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"))
    bare = sets.filter(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    lost = every.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(bare).unionByName(lost)
