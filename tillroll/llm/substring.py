"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``window`` consecutive words the smallest
hash among its word ``GRAM``-grams, so equal windows pick equal anchors. The
windows that one anchor stands for overlap; together they extend the seed both
ways to a span of up to 2 * window - GRAM words. Documents meet on the anchor:

* spans that agree whole are repeats of the first of them, all windows at once;
* where one anchor has several spans, some windows may still agree. Only the
  first occurrence of each such span is taken apart into its windows, and these
  meet on the hash of the whole window.

Overlapping repeated windows are joined to maximal repeats. A text is shuffled
twice, anchors once; equal spans are combined within each batch before they
travel, so a passage that most documents share is sent once per batch, and the
groups are read as sorted streams, never held in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import id_of, in_arrow, named, private, small_batches, stored
from .words import groups_of, mix, span_hashes, text_column, words_of

WINDOW = 20
GRAM = 8
COLUMNS = ["n_words", "n_removed", "repeats", "kept_text"]

_SCHEMA = "a long, s long, id long, place long"


def packing(window: int, gram: int) -> int:
    """A place is start * packing + number of windows - 1; a span holds at most
    window - gram + 1 windows."""
    if not 1 <= gram <= window:
        raise ValueError(f"gram must be from 1 to window ({window}): {gram}")
    return window - gram + 2


def anchor_spans(hashes: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Runs of windows with the same anchor in consecutive texts: (row, start
    within the text, number of windows, anchor hash, span hash)."""
    n = len(hashes)
    m = n - window + 1
    if m < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n - gram + 1)
    grams = span_hashes(hashes, at, at + gram)
    best, place = grams[:m].copy(), np.arange(m)
    for d in range(1, window - gram + 1):
        other = grams[d : d + m]
        better = other <= best
        np.copyto(best, other, where=better)
        place[better] = np.flatnonzero(better) + d
    valid = row[:m] == row[window - 1 :]
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(new)
    count = np.add.reduceat(valid & np.ones(m, bool), begin).astype(np.int64) if len(begin) else begin
    spans = span_hashes(mix(hashes + np.uint64(0x5851F42D4C957F2D)), begin, begin + count + window - 1)
    return row[begin], begin - first[row[begin]], count, best[begin], spans


def _combined(a, s, ids, place, pack):
    """Rows in order; of equal (a, s) only the first stays as it is. A later one
    is a repeat for certain: it gets a key of its own and a negative place."""
    order = np.lexsort((place, ids, s, a))
    a, s, ids, place = a[order], s[order], ids[order], place[order]
    if len(a):
        later, _ = _later(a, s, ids, place, None, pack)
        a, s, place = a.copy(), s.copy(), place.copy()
        a[later] = mix((ids[later] * 7919 + place[later]).view(np.uint64)).view(np.int64)
        s[later] = 0
        place[later] = -1 - place[later]
    return [pa.array(x) for x in (a, s, ids, place)]


def _later(a, s, ids, place, before, pack):
    """Which rows (sorted) come after the first of their (a, s), by id and start;
    before: that first row of the group which the rows may go on with."""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    if before is not None and before[0] == a[0] and before[1] == s[0]:
        new[0] = False
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    id0, start0 = ids[begin], place[begin] // pack
    if not new[0]:
        id0, start0, group = np.append(before[2], id0), np.append(before[3], start0), group + 1
    id0, start0 = id0[group], start0[group]
    return (ids > id0) | ((ids == id0) & (place // pack > start0)), new


def _flags(batches, edges: bool, pack: int):
    """Streams rows in order of (a, s, id, place). Yields (id, place, edge):
    repeated spans, and with ``edges`` the first row of each span whose anchor
    has several."""
    before, held, several = None, None, False
    for batch in batches:
        a, s, ids, place = (batch.column(k).to_numpy() for k in range(4))
        sure = place < 0
        out = [(ids[sure], -1 - place[sure], np.zeros(int(sure.sum()), bool))]
        a, s, ids, place = a[~sure], s[~sure], ids[~sure], place[~sure]
        if len(a):
            later, new = _later(a, s, ids, place, before, pack)
            out.append((ids[later], place[later], np.zeros(int(later.sum()), bool)))
            if edges:
                at = np.flatnonzero(new)  # first rows of spans
                fa = a[at]
                if before is not None and len(at) and fa[0] == before[0] and held is not None:
                    out.append((held[0], held[1], np.ones(1, bool)))
                if len(at):
                    known = before is not None and fa[0] == before[0]
                    head = np.append(not known, fa[1:] != fa[:-1])
                    group = np.cumsum(head) - 1 + known
                    size = np.bincount(group)
                    if known:
                        size[0] += 1
                    many = size[group] > 1
                    last = group == group[-1]
                    out.append((ids[at][many], place[at][many], np.ones(int(many.sum()), bool)))
                    held = None if size[-1] > 1 else (ids[at][last], place[at][last])
                # no first row here: the group of the batch before goes on unchanged
            begin = np.flatnonzero(new)
            if len(begin):
                k = begin[-1]
                before = (a[k], s[k], ids[k], place[k] // pack)
        ids, place, edge = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place), pa.array(edge)], ["id", "place", "edge"])


def _repeats(rows: DataFrame, edges: bool, pack: int) -> DataFrame:
    dealt = rows.repartition("a").sortWithinPartitions("a", "s", "id", "place")
    return dealt.mapInArrow(lambda batches: _flags(batches, edges, pack), "id long, place long, edge boolean")


def repeated_windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """texts: (id, text). Returns (id, places array<long>): packed runs of
    windows of the text that also start earlier."""
    pack = packing(window, gram)

    def seeds(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values, starts, ends = text_column(batch.column(1))
            parts = []
            for i, j in groups_of(starts, ends):
                _, _, (h,), first = words_of(values, starts[i:j], ends[i:j])
                row, start, count, a, s = anchor_spans(h, first, window, gram)
                parts.append((a.view(np.int64), s.view(np.int64), ids[i:j][row], start * pack + count - 1))
            if parts:
                yield pa.RecordBatch.from_arrays(_combined(*(np.concatenate(x) for x in zip(*parts)), pack), ["a", "s", "id", "place"])

    found = stored(_repeats(texts.mapInArrow(seeds, _SCHEMA), True, pack), "substring-spans")
    edges = found.filter("edge").groupBy("id").agg(F.collect_set("place").alias("places"))

    def windows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values, starts, ends = text_column(batch.column(1))
            places = batch.column(2)
            parts = []
            for i, j in groups_of(starts, ends):
                _, _, (h, g), first = words_of(values, starts[i:j], ends[i:j], seeds=(1, 2))
                here = places.slice(i, j - i)
                flat = here.flatten().to_numpy()
                row = np.repeat(np.arange(j - i), np.diff(np.asarray(here.offsets)))
                start, count = flat // pack, flat % pack + 1
                each = np.repeat(np.arange(len(flat)), count)
                start = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                at = start + first[row[each]]
                fits = at + window <= first[row[each] + 1]
                row, start, at = row[each][fits], start[fits], at[fits]
                parts.append((span_hashes(h, at, at + window).view(np.int64), span_hashes(g, at, at + window).view(np.int64), ids[i:j][row], start * pack))
            if parts:
                yield pa.RecordBatch.from_arrays(_combined(*(np.concatenate(x) for x in zip(*parts)), pack), ["a", "s", "id", "place"])

    taken = texts.join(edges, "id").select("id", "text", "places").mapInArrow(windows, _SCHEMA)
    every = found.filter("NOT edge").select("id", "place").unionByName(_repeats(taken, False, pack).select("id", "place"))
    return every.groupBy("id").agg(F.collect_set("place").alias("places"))


def dedup_substrings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, window: int = WINDOW, gram: int = GRAM,
                     columns: list[str] | None = None) -> DataFrame:
    """docs (columns ``columns``, default all) with n_words, n_removed, repeats
    (array<struct<start, end>>: maximal word ranges made of repeated windows)
    and kept_text (the other words, joined by one space).

    A window is ``window`` consecutive words (runs without ASCII whitespace) of
    one document; it is repeated if the same words also start earlier: in a
    document of smaller id, or earlier in its own. All windows are judged on the
    input. Word sequences are compared by 128 bits of their hashes.

    Nulls: a null text has no words, a null id sorts before all others. Rows
    with the same id count as the same document: the same place in them is not
    an earlier one, and what is found in one is removed from all. An empty table
    gives no rows. Input columns called like a result column are replaced.
    """
    pack = packing(window, gram)
    small_batches(docs.sparkSession)
    columns = [c for c in (columns or docs.columns) if c.lower() not in COLUMNS]
    texts = docs.select(id_of(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    own = private(columns)
    found = repeated_windows(texts, window, gram).toDF(own + "id", own + "places")
    text = text_col if text_col in columns else own + "text"
    base = docs.select(*map(named, columns), *([] if text in columns else [named(text_col).alias(text)]), id_of(id_col).alias(own + "doc"))
    rows = base.join(found, F.col(own + "doc") == F.col(own + "id"), "left").select(*map(named, columns), named(text).alias(own + "whole"), own + "places")
    n = len(columns)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for batch in batches:
            values, starts, ends = text_column(batch.column(n))
            data = values.tobytes()
            places = batch.column(n + 1)
            n_words, n_removed, repeats, kept = [], [], [], []
            for i, (x, y) in enumerate(zip(starts.tolist(), ends.tolist())):
                words = data[x:y].split()
                total, ranges = len(words), []
                if places[i].is_valid:
                    flat = places[i].values.to_numpy()
                    edge = np.zeros(total + 1, np.int64)
                    begin = np.minimum(flat // pack, total)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, np.minimum(begin + flat % pack + window, total), -1)
                    covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                    turns = np.flatnonzero(covered[1:] != covered[:-1]).tolist()
                    ranges = list(zip(turns[::2], turns[1::2]))
                    for s, e in reversed(ranges):
                        del words[s:e]
                n_words.append(total)
                n_removed.append(total - len(words))
                repeats.append([{"start": s, "end": e} for s, e in ranges])
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(n)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(repeats, span), pa.array(kept, pa.binary()).cast(pa.string())],
                [*columns, *COLUMNS])

    schema = rows.select(*map(named, columns), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                         F.array().cast("array<struct<start:int,end:int>>").alias("repeats"), F.lit("").alias("kept_text")).schema
    return in_arrow(rows, cut, schema)
