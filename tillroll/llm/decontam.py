"""Benchmark decontamination with a generalised suffix automaton.

All test items go into one automaton over word ids. Training words stream
through it and at each word the automaton's state gives the longest match that
ends there; a match of at least ``window`` words (or a whole shorter item) is a
hit. Words are first hashed for a whole batch, and only runs whose neighbouring
word pairs all occur in the test items enter the automaton: other words cannot
lie in a match of that length. Runs are looked up by their bytes, so hash
collisions change nothing.

Items are taken in shards of at most ``shard_words`` words; each shard's
automaton is a broadcast of bounded size and all its work is a narrow map.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import in_arrow, named, small_batches, stored
from .words import ALNUM, LOWER, groups_of, mix, span_hashes, text_column, words_of

WINDOW = 10
SHARD_WORDS = 1_000_000
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COLUMNS = ["n_words", "hit_spans", "items"]

_LOWER_BYTES = bytes(LOWER)


def item_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(_LOWER_BYTES))


class Automaton:
    """Generalised suffix automaton over word ids, with the items' windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[tuple[int, ...], list[str]] = {}
        pairs: set[tuple[int, int]] = set()
        for item, words in items:
            code = [self.ids.setdefault(w, len(self.ids)) for w in words]
            last = 0
            for c in code:
                last = self._extend(last, c)
            pairs.update(zip(code, code[1:]))
            size = min(window, len(code))
            for k in range(len(code) - size + 1):
                owners = self.windows.setdefault(tuple(code[k : k + size]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.sizes = sorted({len(w) for w in self.windows})
        blob = np.frombuffer(b" ".join(self.ids) + b" ", np.uint8)
        ends = np.flatnonzero(blob == 32)
        hashes = span_hashes(blob, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64), ends) if self.ids else np.zeros(0, np.uint64)
        self.word_hashes = np.unique(hashes)
        left, right = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.pair_hashes = np.unique(_pair(hashes[left], hashes[right])) if pairs else np.zeros(0, np.uint64)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def longest(self, codes: list[int]) -> list[int]:
        """For each word the length of the longest match that ends there."""
        out, state, size = [], 0, 0
        edges, link, length = self.next, self.link, self.length
        for c in codes:
            while state and c not in edges[state]:
                state = link[state]
                size = length[state]
            to = edges[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) of occurring windows in a run of words, and their items."""
        codes = [self.ids.get(w, -1) for w in words]
        spans, items = [], set()
        for end, size in enumerate(self.longest(codes), 1):
            for n in self.sizes:
                if n > size:
                    break
                owners = self.windows.get(tuple(codes[end - n : end]))
                if owners:
                    spans.append((end - n, end))
                    items.update(owners)
        return spans, items

    def runs(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(start, end) word ranges, within one text each, that may hold a window."""
        n, least = len(hashes), self.sizes[0]
        if n < least:
            return np.zeros((0, 2), np.int64)
        if least == 1:
            good = _among(hashes, self.word_hashes)
            joined = good[:-1] & good[1:]
        else:
            joined = _among(_pair(hashes[:-1], hashes[1:]), self.pair_hashes)
            good = None
        cuts = first[(first > 0) & (first < n)]
        joined[cuts - 1] = False
        edge = np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        long = end - start >= least
        out = np.stack([start[long], end[long]], axis=1)
        if good is not None:  # single words that no pair joins
            inside = np.zeros(n, bool)
            inside[:-1] |= joined
            inside[1:] |= joined
            alone = np.flatnonzero(good & ~inside)
            out = np.concatenate([out, np.stack([alone, alone + 1], axis=1)])
            out = out[np.argsort(out[:, 0])]
        return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """x in known (sorted); a table of the low bits turns most away first."""
    low = np.zeros(1 << 16, bool)
    low[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = low[(x & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(known):
        found = np.searchsorted(known, x[at])
        out[at] = known[np.minimum(found, len(known) - 1)] == x[at]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shards(items: DataFrame, item_col: str, text_col: str, shard_words: int):
    """Lists of (item id, words), of at most shard_words words each (one item at least)."""
    sized = items.select(named(item_col).cast("string").alias("item"), named(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    words, shard = 0, []
    for row in sized.orderBy("item", "text").toLocalIterator():  # one input partition at a time
        found = item_words(row["text"])
        if not found:
            continue
        if shard and words + len(found) > shard_words:
            yield shard
            words, shard = 0, []
        shard.append((row["item"] if row["item"] is not None else "", found))
        words += len(found)
    if shard:
        yield shard


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text",
              window: int = WINDOW, shard_words: int = SHARD_WORDS, columns: list[str] | None = None) -> DataFrame:
    """docs (columns ``columns``, default all) with n_words, hit_spans
    (array<struct<start, end>>, merged word ranges inside occurring windows)
    and items (sorted ids of the items with occurring windows).

    A window is ``window`` consecutive words of an item; an item of fewer, but
    not none, is one window. Words are lower-cased runs of 0-9, A-Z and every
    character beyond ASCII.

    Nulls: a null text has no words, an item with a null text no windows.
    Repeated rows are treated alike; repeated items count once. An empty items
    table leaves every document without hits. Input columns called like a
    result column are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in (columns or docs.columns) if c.lower() not in COLUMNS]
    needed = [*columns, *([] if text_col in columns else [text_col])]
    span = "array<struct<start:int,end:int>>"
    out = docs.select(*map(named, needed)).withColumns({"n_words": F.lit(None).cast("long"), "hit_spans": F.lit(None).cast(span), "items": F.lit(None).cast("array<string>")})
    schema = out.schema
    n, at = len(needed), needed.index(text_col)
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for number, shard in enumerate(shards(items, item_col, item_text_col, shard_words)):
        if number:  # the last shard's automaton need not stay in memory
            out = stored(out, "decontam-shard")
        automaton = Automaton(shard, window)  # travels with the function, which Spark broadcasts

        def scan(batches, found=automaton):
            for batch in batches:
                values, starts, ends = text_column(batch.column(at))
                old_spans, old_items = batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()
                counts = np.zeros(len(starts), np.int64)
                spans: list = [[(s["start"], s["end"]) for s in x or ()] for x in old_spans]
                hit_items: list = [set(x or ()) for x in old_items]
                for i, j in groups_of(starts, ends):
                    s, e, (h,), first = words_of(values, starts[i:j], ends[i:j], ALNUM, lower=True)
                    counts[i:j] = np.diff(first)
                    offsets = first.tolist()
                    for a, b in found.runs(h, first).tolist():
                        row = bisect_left(offsets, a + 1) - 1
                        words = [values[x:y].tobytes().translate(_LOWER_BYTES) for x, y in zip(s[a:b].tolist(), e[a:b].tolist())]
                        more, names = found.hits(words)
                        spans[i + row] += [(x + a - offsets[row], y + a - offsets[row]) for x, y in more]
                        hit_items[i + row] |= names
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k) for k in range(n)], pa.array(counts),
                     pa.array([[{"start": a, "end": b} for a, b in merged(x)] for x in spans], arrow_span),
                     pa.array([sorted(x) for x in hit_items], pa.list_(pa.string()))],
                    [*needed, *COLUMNS])

        out = in_arrow(out, scan, schema)
    empty = F.array().cast(span)
    words = F.coalesce("n_words", F.coalesce(F.regexp_count(F.lower(named(text_col)), F.lit(ITEM_WORD)), F.lit(0)).cast("long"))
    return out.select(*map(named, columns), words.alias("n_words"), F.coalesce("hit_spans", empty).alias("hit_spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", *, max_coverage: float = 0.5, **options) -> DataFrame:
    """docs without the hit words: each hit span goes, from its first word to
    its last; a document of whose words more than max_coverage are hit goes
    whole. Documents without hits stay as they are."""
    columns = [f"c{k}" for k in range(len(docs.columns))]  # the input keeps its columns, whatever their name
    at = docs.columns.index(text_col)
    found = find_hits(docs.toDF(*columns), items, columns[at], **options)
    docs_names, schema = docs.columns, docs.schema
    found = found.filter((F.col("n_words") == 0) | (hit_words() <= max_coverage * F.col("n_words")))

    def cut(batches):
        for batch in batches:
            values, starts, ends = text_column(batch.column(at))
            spans, texts = batch.column(len(columns)), []
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                hit = spans[i].as_py()
                if not hit:
                    texts.append(values[a:b].tobytes() if batch.column(at)[i].is_valid else None)
                    continue
                s, e, _, _ = words_of(values, starts[i : i + 1], ends[i : i + 1], ALNUM, lower=True)
                parts, x = [], a
                for span in hit:
                    parts.append(values[x : s[span["start"]]].tobytes())
                    x = int(e[span["end"] - 1])
                parts.append(values[x:b].tobytes())
                texts.append(b"".join(parts))
            arrays = [batch.column(k) for k in range(len(columns))]
            arrays[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, docs_names)

    return in_arrow(found.select(*map(named, columns), "hit_spans"), cut, schema)
