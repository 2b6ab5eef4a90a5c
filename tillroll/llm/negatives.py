"""Hard-negative mining with cover trees over norm-augmented candidates.

Scores are inner products of whole-number vectors. Each candidate gets one more
coordinate, sqrt(M^2 - |x|^2) with M the largest length of all, so all have the
length M; an anchor gets a zero there. Then for every point x within distance r
of a tree node's centre c, |q.x - q.c| <= |q| r, whatever x's own length.

Candidates lie in shards of at most about ``SHARD_BYTES``, in the order of their
labels, the rows of a label dealt by hash: a label of a third of all rows fills
many shards, small labels share one. A task builds each shard's cover tree: nets
of falling radius (``BASE`` to the power of the level), each point below the
first centre that covers it, every node with the radius that covers its points.
Where a net would have nearly as many centres as points, the points stay one
leaf, so structureless data are scanned in blocks.

Anchors lie in blocks, and a task searches one block in one shard: best-first
descent by the largest score that a node allows. Nodes that the anchor's windows
don't meet are skipped, and so is what can't reach the anchor's k-th best;
leaves are verified with exact products. First the shards of the anchor's own
label give its positives, then all shards its negatives within the windows; each
shard returns at most k rows for an anchor and positive, ranked by Spark.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import NULL_ID, id_of, named, stored

SCALE = 256
BASE = 1.3  # the ratio of two levels' radii
LEAF = 48  # points that are not divided further
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, OF = 30, 90, 100  # a window: LOW/OF to HIGH/OF of the positive's score


# ---------------------------------------------------------------- cover tree
class CoverTree:
    """Points in the order of the leaves, and nodes: centre (a point), covering
    radius, first and last child (none in a leaf), first and last point, smallest
    and largest label."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, longest: float):
        """points: whole numbers; longest: the square of the largest length."""
        wide = points.astype(float)
        rest = np.sqrt(np.maximum(longest - (wide * wide).sum(1), 0))
        wide = np.column_stack([wide, rest])
        members, centres, radii, first, last, start, end = [np.arange(len(points))], [0], [], [0], [0], [0], [0]
        levels = [self._cover(wide, members[0], 0, radii)]
        order, stack = [], [0]
        while stack:  # depth first, so that a node's points are consecutive
            k = stack.pop()
            start[k] = len(order)
            parts, level = self._split(wide, members[k], centres[k], radii[k], levels[k])
            if parts:
                first[k], last[k] = len(centres), len(centres) + len(parts)
                for c, own in parts:
                    members.append(own)
                    centres.append(c)
                    self._cover(wide, own, c, radii)
                    levels.append(level)
                    for x in (first, last, start, end):
                        x.append(0)
                stack.extend(range(last[k] - 1, first[k] - 1, -1))
            else:
                order.extend(members[k].tolist())
        self.order = np.array(order, dtype=np.int64)
        place = np.empty(len(order), dtype=np.int64)
        place[self.order] = np.arange(len(order))
        sizes = np.array([len(m) for m in members])
        self.centre, self.radius = place[np.array(centres)], np.array(radii)
        self.first, self.last, self.start = np.array(first), np.array(last), np.array(start)
        self.end = self.start + sizes
        self.low = np.array([labels[m].min() for m in members])
        self.high = np.array([labels[m].max() for m in members])

    @staticmethod
    def _away(wide, members, centre):
        off = wide[members] - wide[centre]
        return np.sqrt(np.einsum("ij,ij->i", off, off))

    def _cover(self, wide, members, centre, radii) -> int:
        r = float(self._away(wide, members, centre).max())
        radii.append(r)
        return int(np.ceil(np.log(r) / np.log(BASE))) if r > 0 else 0

    def _split(self, wide, members, centre, radius, level):
        """Children (centre, points) of the first net that divides the points."""
        n = len(members)
        if n <= LEAF or radius == 0:
            return None, level
        most = 16 + n // 128
        while True:
            level -= 1
            r = BASE**level
            if r >= radius:
                continue
            parts, left, c = [], members, centre
            while len(left) and len(parts) <= most:
                near = self._away(wide, left, c) <= r
                near |= left == c
                parts.append((c, left[near]))
                left = left[~near]
                c = left[0] if len(left) else c
            if len(left):
                return None, level
            if len(parts) > 1:
                return parts, level


def _better(found, rows, k):
    """The first k of two sets of (score, id, label, mark) columns."""
    both = [np.concatenate(x) for x in zip(found, rows, strict=True)] if found is not None else rows
    order = np.lexsort((both[3], both[2], both[1], -both[0]))[:k]
    return [x[order] for x in both]


class Shard:
    """A shard's tree with its points, as stored in one row."""

    INTS = ("order_id", "order_label", "order_mark", "centre", "first", "last", "start", "end", "low", "high")
    SCHEMA = "shard long, points binary, radius binary, " + ", ".join(f"{c} binary" for c in INTS)
    ARROW = pa.schema([("shard", pa.int64()), ("points", pa.binary()), ("radius", pa.binary()), *[(c, pa.binary()) for c in INTS]])

    def __init__(self, row: dict, longest: int):
        """Products are taken in doubles where those hold every score exactly."""
        for c in self.INTS:
            setattr(self, c, np.frombuffer(row[c], dtype=np.int64))
        self.radius = np.frombuffer(row["radius"], dtype=float)
        self.exact = float if longest < 2**53 else np.int64
        self.points = np.frombuffer(row["points"], dtype=np.int64).reshape(len(self.order_id), -1).astype(self.exact)

    @classmethod
    def row(cls, shard: int, points, ids, labels, marks, longest: int) -> dict:
        t = CoverTree(points, labels, longest)
        o = t.order
        values = {"order_id": ids[o], "order_label": labels[o], "order_mark": marks[o]} | {c: getattr(t, c) for c in cls.INTS[3:]}
        return {"shard": shard, "points": np.ascontiguousarray(points[o]).tobytes(), "radius": t.radius.tobytes()} | {c: np.ascontiguousarray(v, dtype=np.int64).tobytes() for c, v in values.items()}

    def centre_scores(self, queries: np.ndarray) -> np.ndarray:
        return queries.astype(self.exact) @ self.points[self.centre].T

    def search(self, query, at_centres, windows, k, label, same: bool, itself=None):
        """For each window (low, high, or None) the first k points by score, then id.

        same: points of this label other than ``itself`` (id, mark), else points
        of other labels."""
        slack = np.sqrt(float(query @ query)) * self.radius * (1 + 1e-9) + 1e-6
        most, least = at_centres + slack, at_centres - slack
        if same:
            out = (self.low > label) | (self.high < label)
        else:
            out = (self.low == label) & (self.high == label)
        scanned, q = {}, query.astype(self.exact)
        return [self._descend(w, most, least, out, scanned, q, k, label, same, itself) for w in windows]

    def _descend(self, window, most, least, out, scanned, q, k, label, same, itself):
        low, high = window if window else (-np.inf, np.inf)
        skip = out | (most < low) | (least > high)
        found, heap = None, [] if skip[0] else [(-min(most[0], high), 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            if found is not None and len(found[0]) == k and -reach < found[0][-1]:
                break  # a node that only ties may hold a smaller id
            if self.first[node] < self.last[node]:
                for c in range(self.first[node], self.last[node]):
                    if not skip[c]:
                        heapq.heappush(heap, (-min(most[c], high), c))
                continue
            a, b = self.start[node], self.end[node]
            if node not in scanned:
                scanned[node] = (self.points[a:b] @ q).astype(np.int64)
            s, labels = scanned[node], self.order_label[a:b]
            floor = low if found is None or len(found[0]) < k else max(low, found[0][-1])
            fits = (s >= floor) & (s <= high)
            fits &= labels == label if same else labels != label
            if itself is not None:
                fits &= (self.order_id[a:b] != itself[0]) | (self.order_mark[a:b] != itself[1])
            at = np.flatnonzero(fits)
            if len(at) > 4 * k:  # ties with the k-th best stay
                most_k = np.partition(s[at], len(at) - k)[len(at) - k]
                at = at[s[at] >= most_k]
            if len(at):
                found = _better(found, [s[at], self.order_id[a:b][at], labels[at], self.order_mark[a:b][at]], k)
        return found


# -------------------------------------------------------------- Spark stages
def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; a value beyond a long is an error."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors without null, infinite or undefined entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad


def _placed(rows: DataFrame, sizes: DataFrame, per: int, name: str) -> DataFrame:
    """rows with a place ``name`` that holds about ``per`` of them: by the order of
    the labels, a label's rows by their mark. sizes: (label, rows, before)."""
    share = F.pmod(F.col("mark"), F.lit(2**30)).cast("double") / 2**30
    return rows.join(sizes, "label").withColumn(name, F.floor((F.col("before") + F.floor(share * F.col("rows"))) / per).cast("long")).drop("rows", "before")


def _sizes(rows: DataFrame, name: str) -> DataFrame:
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(counts.select("label", "rows", before.alias("before")), name)


def _rows_of(table: pa.Table):
    vectors = table["x"].combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return (flat.reshape(table.num_rows, -1), *[table[c].to_numpy().astype(np.int64) for c in ("id", "label", "mark")])


def _build(longest: int):
    def run(key, table):
        return pa.Table.from_pylist([Shard.row(key[0].as_py(), *_rows_of(table), longest)], schema=Shard.ARROW)
    return run


FOUND = "id long, label long, mark long, positive_id long, positive_score long, positive_mark long, other_id long, other_label long, other_mark long, score long"
_FOUND_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])


def _search(longest: int, k: int, window: tuple[int, int, int] | None):
    """A function of (anchors, shard): positives where no window is given, else
    negatives for each of the anchor's positives."""
    def run(_key, anchors, shards):
        rows = []
        for row in shards.to_pylist() if anchors.num_rows else []:
            shard = Shard(row, longest)
            x, ids, labels, marks = _rows_of(anchors)
            centres = shard.centre_scores(x)
            given = anchors["positives"].to_pylist() if window else [[{"id": 0, "score": 0, "mark": 0}]] * len(ids)
            for i, positives in enumerate(given):
                # whole-number ends of LOW * p <= OF * s <= HIGH * p
                spans = [(-(-window[0] * p["score"] // window[2]), window[1] * p["score"] // window[2]) for p in positives] if window else [None]
                itself = None if window else (ids[i], marks[i])
                got = shard.search(x[i], centres[i], spans, k, labels[i], window is None, itself)
                for p, best in zip(positives, got, strict=True):
                    if best is not None:
                        n = len(best[0])
                        head = [np.full(n, v) for v in (ids[i], labels[i], marks[i], p["id"], p["score"], p["mark"])]
                        rows.append([*head, best[1], best[2], best[3], best[0]])
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * len(_FOUND_ARROW)
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], schema=_FOUND_ARROW)
    return run


def _searched(anchors: DataFrame, trees: DataFrame, longest: int, k: int, window, by: list[str]) -> DataFrame:
    """anchors: rows (block, shard, ...) for every shard to search. Returns the
    first k of each group ``by``."""
    pairs = stored(anchors.select("block", "shard").distinct(), "negatives-pairs")
    there = trees.join(pairs, "shard")
    found = anchors.groupBy("block", "shard").cogroup(there.groupBy("block", "shard")).applyInArrow(_search(longest, k, window), FOUND)
    order = [F.desc("score"), "other_id", "other_label", "other_mark"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def mine_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int, int] = (LOW, HIGH, OF)) -> DataFrame:
    """Negatives for the anchors among ``rows``: (anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score).

    vector_col holds whole numbers (``whole_numbers``), label_col whole numbers.
    An anchor's positives are its first ``positives`` other rows of the same
    label; a positive's negatives are the first ``negatives`` rows of another
    label with window[0] * p <= window[2] * score <= window[1] * p for its score
    p. Higher scores come first, then smaller ids; rows of one id by label, then
    by a hash of label and vector.

    Rows with a null label or vector, or a null entry, take no part. Equal rows
    count once; rows that share an id but differ are rows of their own. A row
    without an id is a candidate like others (the smallest id), never an anchor.
    The dimension is the commonest length (of several the largest); other rows
    take no part, and neither do empty vectors. An anchor without positives, or
    without rows in any window, has no result; an empty table gives none. Scores
    must fit a long. Other columns of ``rows`` are not read, so their names don't
    matter. Every shard is searched for every anchor.
    """
    spark = rows.sparkSession
    v = named(vector_col)
    table = rows.select(id_of(id_col).alias("id"), named(label_col).cast("long").alias("label"), v.cast("array<bigint>").alias("x"),
                        (is_anchor & named(id_col).isNotNull()).alias("anchor"))
    table = table.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull()))
    table = table.groupBy("id", "label", "x").agg(F.max(F.coalesce("anchor", F.lit(False))).alias("anchor"))
    table = stored(table.withColumn("mark", F.xxhash64("id", "label", "x")), "negatives-rows")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    squares = F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c * c)
    widths = table.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max(squares).alias("longest"))
    widths = widths.orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widths or not widths[0]["anchors"]:
        return spark.createDataFrame([], schema)
    width, longest = widths[0]["width"], widths[0]["longest"]
    per, per_block = max(1, SHARD_BYTES // (8 * width)), max(1, BLOCK_BYTES // (8 * width))
    table = table.filter(F.size("x") == width)

    sizes = _sizes(table, "negatives-labels")
    n_shards = -(-widths[0]["n"] // per)
    placed = _placed(table.drop("anchor"), sizes, per, "shard")
    trees = stored(placed.groupBy("shard").applyInArrow(_build(longest), Shard.SCHEMA), "negatives-trees")
    anchors = table.filter("anchor").drop("anchor")
    anchors = stored(_placed(anchors, _sizes(anchors, "negatives-labels"), per_block, "block"), "negatives-anchors")

    # the shards of an anchor's own label
    own = sizes.select("label", F.floor(F.col("before") / per).alias("low"), F.floor((F.col("before") + F.col("rows") - 1) / per).alias("high"))
    near = anchors.join(own, "label").withColumn("shard", F.explode(F.sequence("low", "high"))).drop("low", "high")
    found = _searched(near, trees, longest, positives, None, ["id", "label", "mark"])
    chosen = found.groupBy("id", "label", "mark").agg(F.collect_list(F.struct(
        F.col("other_id").alias("id"), "score", F.col("other_mark").alias("mark"))).alias("positives"))
    chosen = stored(chosen, "negatives-positives")

    every = anchors.join(chosen, ["id", "label", "mark"]).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    found = _searched(every, trees, longest, negatives, window, ["id", "label", "mark", "positive_id", "positive_mark"])
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return found.select(F.col("id").alias("anchor_id"), real("positive_id").alias("positive_id"), "rank", real("other_id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score"))
