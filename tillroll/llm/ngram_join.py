"""N-gram Jaccard self-join with a MinHash LSH forest.

A text's word 5-grams give ``TREES`` signatures of ``DEPTH`` min-hashes; each is
the path of the text in a prefix trie. Paths are matched level by level, from
their full depth on: texts that share a prefix of the level's length in some tree
meet there and are verified on their full shingle sets. After each level a text's
recall is estimated from the links it has: a link of similarity s is found with
probability 1 - (1 - s**length)**TREES, so it stands for one over that many. Only
texts short of the target, those without any link among them, have their prefixes
shortened by one more value; a pair is verified where one of its texts is still
open. The last level's length finds a pair exactly at the threshold with the
target probability. So a group of near copies, whose links are sure to be found
at full depth, is not gathered again in the larger buckets of shorter prefixes.

Copies (equal word sequences) are one node. Candidate groups are linked by
stars, never by all their pairs. A small group is verified in one task; a large
one tree by tree in blocks of bounded size, each pair of blocks a task of its own
and each pair of texts counted in the first tree where it meets. Tasks return
counts of links and a spanning forest, not the pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected
from .shared import NULL_ID, id_of, named, private, small_batches, stored
from .words import groups_of, mix, span_hashes, text_column, words_of

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 22, 6
RECALL = 0.999
BLOCK_TEXTS, BLOCK_WORDS = 512, 400_000
COLUMNS = ["class_id", "n_links", "n_text_links"]


def recall(length: int, similarity: float = THRESHOLD, trees: int = TREES) -> float:
    """Probability that a pair shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def prefix_length(target: float = RECALL, similarity: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that finds a pair of this similarity with the target probability."""
    for length in range(depth, 0, -1):
        if recall(length, similarity, trees) >= target:
            return length
    raise ValueError(f"{trees} trees find a similarity of {similarity} with a probability of {recall(1, similarity, trees):.4f}, below the target {target}")


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE):
    """Hashes of the word k-grams of consecutive texts and the first one of each
    text; a text of fewer words, but not none, is one shingle."""
    n = len(first) - 1
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(n), count)
    start = first[row] + np.arange(len(row)) - begin[row]
    return span_hashes(hashes, start, np.minimum(start + k, first[row + 1])), begin


def signatures(hashes: np.ndarray, begin: np.ndarray, values: int) -> np.ndarray:
    """Min-hashes of the texts that have shingles, (texts, values)."""
    rng = np.random.default_rng(11)
    salts = rng.integers(0, 2**63, (2, values), dtype=np.uint64)
    some = begin[:-1][np.diff(begin) > 0]
    out = np.empty((len(some), values), np.uint64)
    for k in range(values):
        out[:, k] = np.minimum.reduceat((hashes ^ salts[0, k]) * (salts[1, k] | np.uint64(1)), some)
    return out


def sketch(texts: DataFrame, levels: list[int]) -> DataFrame:
    """texts: (id, digest, text). Returns (id, digest, node binary, n_words,
    labels): node is a 128-bit hash of the word sequence, labels holds a hash of
    each tree's prefix, TREES for each length in levels."""

    def read(batches):
        for batch in batches:
            ids, digests = batch.column(0), batch.column(1)
            values, starts, ends = text_column(batch.column(2))
            nodes, counts, labels, sizes = [], [], [], []
            for i, j in groups_of(starts, ends):
                _, _, (h, g), first = words_of(values, starts[i:j], ends[i:j], seeds=(1, 2))
                pair = np.stack([span_hashes(h, first[:-1], first[1:]), span_hashes(g, first[:-1], first[1:])], axis=1)
                nodes += [x.tobytes() for x in pair.astype(">u8")]
                counts.append(np.diff(first))
                s, begin = shingles(h, first)
                some = np.diff(begin) > 0
                sizes.append(np.where(some, TREES * len(levels), 0))
                if some.any():
                    sig = signatures(s, begin, TREES * DEPTH).reshape(-1)
                    at = np.arange(0, len(sig), DEPTH)
                    paths = [span_hashes(sig, at, at + length).reshape(-1, TREES) for length in levels]
                    labels.append(np.concatenate(paths, axis=1).reshape(-1).view(np.int64))
            if not nodes:
                continue
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            flat = np.concatenate(labels) if labels else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, digests, pa.array(nodes, pa.binary()), pa.array(np.concatenate(counts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["id", "digest", "node", "n_words", "labels"])

    return texts.mapInArrow(read, "id long, digest binary, node binary, n_words long, labels array<long>")


def overlaps(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the pairwise intersections of n sets given as (row, hash)."""
    order = np.argsort(hashes, kind="stable")
    r, h = rows[order], hashes[order]
    new = np.append(True, h[1:] != h[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    renumbered = np.cumsum(shared) - 1
    r, column = r[shared[column]], renumbered[column[shared[column]]]
    out, width = np.zeros((n, n), np.float32), 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[r[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _verify(batch: pa.Table, threshold: float, levels: list[int]):
    """One group: (node, links, copies linked, head of the local component,
    missed: for each level the links expected besides those found)."""
    batch = batch.combine_chunks()
    nodes = batch.column("node").to_pylist()
    values, starts, ends = text_column(batch.column("text"))
    _, _, (h, g), first = words_of(values, starts, ends, seeds=(1, 2))
    pair = np.stack([span_hashes(h, first[:-1], first[1:]), span_hashes(g, first[:-1], first[1:])], axis=1).astype(">u8")
    rows = [k for k, node in enumerate(nodes) if pair[k].tobytes() == node]
    n = len(rows)
    s, begin = shingles(h, first)
    sets = [np.unique(s[begin[k] : begin[k + 1]]) for k in rows]
    sizes = np.array([len(x) for x in sets])
    both = overlaps(np.repeat(np.arange(n), sizes), np.concatenate(sets) if sets else np.zeros(0, np.uint64), n)
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    block, one, two, tree, open_ = (batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("block", "one", "two", "tree", "open"))
    if n and one[0] != two[0]:
        linked &= block[:, None] != block[None, :]
    linked &= open_[:, None] | open_[None, :]
    here, longer = (np.array([batch.column(c)[k].as_py() for k in rows], np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64) for c in ("here", "longer"))
    again = np.zeros((n, n), bool)  # links counted in an earlier tree
    x, y = np.nonzero(linked)
    for at in range(0, len(x), 1 << 16):
        i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        same = here[i] == here[j]
        # pairs of this level: they meet here, and did not at a longer prefix
        new = same.any(axis=1) & ~(longer[i] == longer[j]).any(axis=1)
        linked[i[~new], j[~new]] = False
        early = same[:, : max(tree[0], 0)].any(axis=1)
        again[i[early], j[early]] = True
    head = np.arange(n)
    while True:  # the smallest row number spreads along the links
        low = np.minimum(head, np.where(linked, head[None, :], n).min(axis=1, initial=n))
        if (low == head).all():
            break
        head = low
    linked &= ~again
    x, y = np.nonzero(linked)
    similarity = both[x, y] / (sizes[x] + sizes[y] - both[x, y])
    missed = np.stack([np.bincount(x, 1 / recall(length, similarity) - 1, n) for length in levels], axis=1) if n else np.zeros((0, len(levels)))
    copies = batch.column("copies").to_numpy()[rows]
    kept = [nodes[k] for k in rows]
    return pa.table({
        "node": pa.array(kept, pa.binary()), "links": pa.array(linked.sum(axis=1), pa.int64()),
        "copies": pa.array(linked.astype(np.int64) @ copies if n else np.zeros(0, np.int64), pa.int64()),
        "head": pa.array([kept[k] for k in head], pa.binary()), "missed": pa.array(list(missed), pa.list_(pa.float64()))})


def candidates(nodes: DataFrame, first: bool) -> DataFrame:
    """nodes: (node, n_words, open, here, longer): the labels of this level and of
    the one before. Returns (node, grp binary, tree, one, two, block): the
    groups and blocks in which a node is verified."""
    measures = [F.count("*").alias("size"), F.sum("n_words").alias("words"), F.min("node").alias("low")]
    if first:
        placed = nodes.select("node", "n_words", F.posexplode("here").alias("tree", "label"))
        buckets = placed.groupBy("tree", "label").agg(*measures).filter("size > 1")
    else:  # a bucket that is not larger than at the longer prefix, or whose texts are all done, has no new pair
        placed = nodes.select("node", "n_words", "open", F.posexplode(F.arrays_zip("here", "longer")).alias("tree", "of"))
        placed = placed.select("node", "n_words", "open", "tree", F.col("of.here").alias("label"), F.col("of.longer").alias("longer"))
        grown = placed.groupBy("tree", "label").agg(*measures, F.max("open").alias("any"), (F.min("longer") < F.max("longer")).alias("grew"))
        buckets = grown.filter("size > 1 AND any AND grew").drop("any", "grew")
    members = stored(placed.join(buckets, ["tree", "label"]).select("node", "tree", "label", "size", "words", "low"), "join-members")
    groups = connected(members.select(F.col("node").alias("u"), F.col("low").alias("v")).distinct(), "join-candidates")
    groups = groups.join(nodes.select("node", "n_words"), "node")
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    small = F.expr(f"n <= {BLOCK_TEXTS} AND w <= {BLOCK_WORDS}")
    groups = stored(groups.join(sizes, "root").select("node", "root", small.alias("small")), "join-groups")
    whole = groups.filter("small").select("node", F.col("root").alias("grp"), F.lit(-1).alias("tree"), F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("block"))
    # A large group is verified bucket by bucket, a large bucket block by block.
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_TEXTS), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    own = F.pmod(F.xxhash64("node", "tree"), F.col("blocks")).cast("int")
    spread = (
        members.join(groups.filter("NOT small").select("node"), "node")
        .withColumn("blocks", blocks).withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", F.unhex(F.lpad(F.hex("label"), 16, "0")).alias("grp"), "tree", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block")
    )
    return whole.unionByName(spread)


def links(nodes: DataFrame, texts: DataFrame, threshold: float, target: float, levels: list[int]) -> DataFrame:
    """Rows of ``_verify`` of all levels."""

    def verify(table: pa.Table) -> pa.Table:
        return _verify(table, threshold, levels)

    found = None
    for number in range(len(levels)):
        here = F.slice("labels", number * TREES + 1, TREES).alias("here")
        longer = F.slice("labels", (number - 1) * TREES + 1, TREES).alias("longer") if number else F.array_repeat(F.lit(None).cast("long"), 0).alias("longer")
        at = nodes.withColumn("open", F.lit(True))
        if number:  # done: the links expected besides those found are within the target
            seen = found.groupBy("node").agg(F.sum("links").alias("links"), F.round(F.sum(F.col("missed")[number - 1]), 9).alias("missed"))
            done = stored(seen.filter((F.col("links") > 0) & (F.col("missed") <= (1 - target) * (F.col("links") + F.col("missed")))).select("node", F.lit(True).alias("done")), "join-done")
            at = nodes.join(done, "node", "left").withColumn("open", F.col("done").isNull())
        at = at.select("node", "id", "digest", "copies", "n_words", "open", here, longer)
        places = candidates(at, number == 0).join(at.drop("n_words"), "node")
        # a node meets its own text only, once, however often the row is repeated
        rows = places.join(texts, ["id", "digest"]).select("grp", "tree", "one", "two", "block", "node", "copies", "open", "here", "longer", "text")
        more = stored(rows.groupBy("grp", "tree", "one", "two").applyInArrow(verify, "node binary, links long, copies long, head binary, missed array<double>"), "join-verified")
        found = more if found is None else found.unionByName(more)
    return found


def digest_of(text_col: str) -> Column:
    """What tells rows of one id apart: a 128-bit hash of the text."""
    return F.unhex(F.md5(F.coalesce(named(text_col), F.lit(""))))


def text_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """One row per distinct (id, text): (id, digest, node, n_words, low, n_links,
    n_text_links). low is the struct (id, node) that comes first in the class; a
    text without words is a class of its own."""
    small_batches(docs.sparkSession)
    levels = list(range(DEPTH, prefix_length(target, threshold) - 1, -1))
    texts = docs.select(id_of(id_col).alias("id"), digest_of(text_col).alias("digest"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    marks = stored(sketch(texts, levels), "join-sketch")
    nodes = stored(
        marks.filter("n_words > 0").groupBy("node")
        .agg(F.min(F.struct("id", "digest")).alias("at"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("labels").alias("labels"))
        .select("node", "at.id", "at.digest", "copies", "n_words", "labels"), "join-nodes")
    verified = links(nodes, texts.dropDuplicates(["id", "digest"]), threshold, target, levels)
    classes = connected(verified.select(F.col("node").alias("u"), F.col("head").alias("v")), "join-classes")
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    rooted = nodes.select("node", "id", "copies").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min(F.struct("id", "node")).alias("low"))
    result = stored(rooted.join(lowest, "root").join(counts, "node", "left").select(
        F.col("node"), "low", F.coalesce("links", F.lit(0)).alias("n_text_links"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "join-result")
    own = F.struct("id", "node")
    return marks.select("id", "digest", "node", "n_words").distinct().join(result, "node", "left").select(
        "id", "digest", "node", "n_words", F.coalesce("low", own).alias("low"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"))


def ngram_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, threshold: float = THRESHOLD, target: float = RECALL,
               columns: list[str] | None = None) -> DataFrame:
    """docs (columns ``columns``, default the id) with class_id, n_links and
    n_text_links: one row per input row.

    Two rows are linked if the Jaccard similarity of their sets of word 5-grams
    is at least threshold. n_links counts the other linked rows, copies with the
    same words included; n_text_links counts linked word sequences other than
    the row's own. class_id is the smallest id of all rows that links connect.

    Words are runs without ASCII whitespace; a text of 1 to 4 words is one
    shingle. Null texts and texts without words have no links and are classes of
    their own (class_id = id). A null id sorts before all others; its class_id
    is null where it is the smallest. Repeated rows are copies of each other; rows
    of one id (or of none) with different texts each have their own text's class.
    An empty table gives no rows. Input columns called like a result column
    are replaced.
    """
    columns = [c for c in (columns or [id_col]) if c.lower() not in COLUMNS]
    own = private(columns)
    found = text_classes(docs, text_col, id_col, threshold, target).select("id", "digest", "low.id", "n_links", "n_text_links").toDF(
        own + "id", own + "of", own + "low", own + "links", own + "text_links")
    base = docs.select(*map(named, columns), id_of(id_col).alias(own + "doc"), digest_of(text_col).alias(own + "digest"))
    low = F.col(own + "low")
    return base.join(found, (F.col(own + "doc") == F.col(own + "id")) & (F.col(own + "digest") == F.col(own + "of"))).select(
        *map(named, columns), F.when(low != F.lit(NULL_ID), low).alias("class_id"), F.col(own + "links").alias("n_links"), F.col(own + "text_links").alias("n_text_links"))
