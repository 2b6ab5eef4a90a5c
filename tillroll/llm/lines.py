"""Line dedup with two Bloom filters.

The 128-bit hashes of all long line keys, each once per row, are written as a
table; texts are cut into lines for it and for the result only. Pass 1 enters
every hash into a filter of hashes seen once and, when all its bits are set
there already, into a filter of hashes seen twice. Tasks work on their own
filters, which are merged in segments; the merged twice-filter is broadcast.
Pass 2 shuffles only hashes that the twice-filter holds (every repeated line,
and some single ones by chance), counts their documents exactly and picks the
document that keeps the line.

Filters take KEY_BITS bits for every hash of the table, between ``filter_bits``
and ``most_bits``. Where that is not enough, the hashes are split into slices,
each with its own passes, one after the other. A filter that fills up, beyond
MOST_SLICES slices, lets more lines through: the result never depends on sizes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.session import scratch_path

from .shared import id_of, in_arrow, named, private, small_batches, stored
from .words import LOWER, NOT_SPACE, groups_of, mix, span_hashes, text_column

MIN_CHARS = 40
MIN_DOCS = 5
FILTER_BITS = 1 << 26  # the least size of a filter, 8 MB
MOST_BITS = 1 << 29  # the largest, 64 MB, for 67 million hashes
KEY_BITS = 8  # bits for every hash: with two probes 5 % of single lines pass when all are in
MOST_SLICES = 64
PROBES = 2
SEGMENTS = 64

COLUMNS = ["n_lines", "n_dropped", "kept_text"]


def line_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Lines of consecutive texts: (line start, line end without \\n, row of the line)."""
    lo, hi = int(starts[0]), int(ends[-1])
    breaks = np.flatnonzero(values[lo:hi] == 10) + lo
    line_starts = np.sort(np.concatenate([starts, breaks + 1]))
    # a text's first line begins with it, also where the text before ended in \n or is empty
    rows = np.repeat(np.arange(len(starts)), 1 + np.searchsorted(breaks, ends) - np.searchsorted(breaks, starts))
    line_ends = np.sort(np.concatenate([ends, breaks]))
    return line_starts, line_ends, rows


def long_keys(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int = MIN_CHARS):
    """Keys of at least min_chars code points among the lines of consecutive
    texts: (line start, line end, row, first hash, second hash)."""
    s, e, rows = line_spans(values, starts, ends)
    long = e - s >= min_chars
    s, e, rows = s[long], e[long], rows[long]
    if not len(s):
        none = np.zeros(0, np.uint64)
        return s, e, rows, none, none
    lo, hi = int(s[0]), int(e[-1])
    v = LOWER[values[lo:hi]]
    solid = np.flatnonzero(NOT_SPACE[v])
    points = np.zeros(len(v) + 1, np.int32)
    np.cumsum((v & 0xC0) != 0x80, out=points[1:])
    first, last = np.searchsorted(solid, s - lo), np.searchsorted(solid, e - lo) - 1
    some = last >= first
    s, e, rows = s[some], e[some], rows[some]
    a, b = solid[first[some]], solid[last[some]] + 1
    long = points[b] - points[a] >= min_chars
    s, e, rows, a, b = s[long], e[long], rows[long], a[long], b[long]
    return s, e, rows, span_hashes(v, a, b, 1), span_hashes(v, a, b, 2)


def _distinct(rows, h1, h2):
    """Each (row, key) once."""
    order = np.lexsort((h2, h1, rows))
    r, x, y = rows[order], h1[order], h2[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return r[new], x[new], y[new]


def _slots(h1: np.ndarray, h2: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(h1 + np.uint64(i) * h2) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def _test(filter_: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(slots[0]), bool)
    for x in slots:
        out &= (filter_[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
    return out


def _enter(filter_: np.ndarray, slots: list[np.ndarray]) -> None:
    for x in slots:
        np.bitwise_or.at(filter_, x >> 3, np.left_shift(np.uint8(1), (x & 7).astype(np.uint8)))


def filter_sizes(keys: int, least: int, most: int) -> tuple[int, int]:
    """(bits of a filter, slices) for so many hashes."""
    bits = least
    while bits < min(KEY_BITS * keys, most):
        bits *= 2
    return bits, min(MOST_SLICES, max(1, -(-KEY_BITS * keys // bits)))


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(batch.column(c)).view(np.uint64) for c in ("h1", "h2"))


def twice_filter(keys: DataFrame, bits: int) -> bytes:
    """The merged filter of hashes (h1, h2) that are in two rows at least (bits / 8 bytes)."""
    size = bits // 8 // SEGMENTS
    tasks = 2 * keys.sparkSession.sparkContext.defaultParallelism  # each over many input splits, as each makes filters of full size

    def build(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h1, h2 = _pairs(batch)
            order = np.lexsort((h2, h1))
            h1, h2 = h1[order], h2[order]
            again = np.zeros(len(h1), bool)
            again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            slots = _slots(h1, h2, bits)
            again |= _test(once, slots)
            _enter(twice, [x[again] for x in slots])
            _enter(once, slots)
        for k in range(SEGMENTS):
            part = slice(k * size, (k + 1) * size)
            if once[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once[part].tobytes()], pa.binary()), pa.array([twice[part].tobytes()], pa.binary())], ["segment", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            for o, t in zip(batch.column("once"), batch.column("twice")):
                o = np.frombuffer(o.as_buffer(), np.uint8)
                twice |= np.frombuffer(t.as_buffer(), np.uint8) | (once & o)
                once |= o
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])

    built = keys.select("h1", "h2").coalesce(tasks).mapInArrow(build, "segment int, once binary, twice binary")
    merged = built.groupBy("segment").applyInArrow(merge, "segment int, twice binary")
    found = {r["segment"]: bytes(r["twice"]) for r in merged.collect()}  # SEGMENTS rows, bits / 8 bytes
    return b"".join(found.get(k, bytes(size)) for k in range(SEGMENTS))


def document_key(text_col: str, id_col: str, by_text: bool) -> list[Column]:
    """(id, part): rows of an id are one document, or one per text if by_text;
    rows without an id are one document per text in any case."""
    digest = F.unhex(F.md5(F.coalesce(named(text_col), F.lit(""))))
    part = digest if by_text else F.when(named(id_col).isNull(), digest).otherwise(F.unhex(F.lit("")))
    return [id_of(id_col).alias("id"), part.alias("part")]


KEYS = "id long, part binary, h1 long, h2 long"


def line_keys(docs: DataFrame, text_col: str, id_col: str, min_chars: int, by_text: bool) -> DataFrame:
    """(id, part, h1, h2), stored: the keys of each row's long lines, each once a row."""

    def keys(batches):
        for batch in batches:
            ids, parts = np.asarray(batch.column(0)), batch.column(1)
            values, starts, ends = text_column(batch.column(2))
            for i, j in groups_of(starts, ends):
                _, _, rows, h1, h2 = long_keys(values, starts[i:j], ends[i:j], min_chars)
                rows, h1, h2 = _distinct(rows, h1, h2)
                at = i + rows
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), parts.take(pa.array(at)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "part", "h1", "h2"])

    return stored(docs.select(*document_key(text_col, id_col, by_text), named(text_col).alias("text")).mapInArrow(keys, KEYS), "lines-keys")


def suspects(keys: DataFrame, least: int, most: int) -> DataFrame:
    """The rows of keys whose hash the twice-filter holds, stored slice by slice."""
    spark = keys.sparkSession
    bits, slices = filter_sizes(keys.count(), least, most)  # counted in the files' footers
    if slices > 1:
        path = scratch_path(spark, "lines-slices")
        keys.withColumn("slice", F.pmod("h2", F.lit(slices)).cast("int")).write.partitionBy("slice").parquet(path)
        keys = spark.read.schema(f"{KEYS}, slice int").parquet(path)
    root = scratch_path(spark, "lines-suspects")
    for k in range(slices):
        part = keys.filter(F.col("slice") == k) if slices > 1 else keys
        twice = spark.sparkContext.broadcast(twice_filter(part, bits))

        def seen_twice(batches, twice=twice):
            held = np.frombuffer(twice.value, np.uint8)
            for batch in batches:
                yield batch.filter(pa.array(_test(held, _slots(*_pairs(batch), bits))))

        part.select("id", "part", "h1", "h2").mapInArrow(seen_twice, KEYS).write.parquet(f"{root}/slice={k}")
    return spark.read.schema(f"{KEYS}, slice int").parquet(root).drop("slice")


def repeated_lines(docs: DataFrame, text_col: str, id_col: str, min_chars: int, min_docs: int, least: int, most: int, by_text: bool = False) -> DataFrame:
    """(id, part, drop binary): for each document the 16-byte keys of its lines that go."""
    found = suspects(line_keys(docs, text_col, id_col, min_chars, by_text), least, most)
    per_doc = found.groupBy("h1", "h2", "id", "part").agg(F.lit(1).alias("one"))  # repeated rows of a document count once
    heavy = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(F.struct("id", "part")).alias("stays")).filter(F.col("n") >= min_docs)
    # read from a table, so that its size is known: joined as a broadcast below the
    # session's limit, and else by shuffles of which a hot key's can be split
    heavy = stored(heavy.select("h1", "h2", "stays"), "lines-heavy")
    go = found.join(heavy, ["h1", "h2"]).filter(F.struct("id", "part") != F.col("stays"))
    both = F.concat(F.unhex(F.lpad(F.hex("h1"), 16, "0")), F.unhex(F.lpad(F.hex("h2"), 16, "0")))
    return go.groupBy("id", "part").agg(F.array_join(F.sort_array(F.collect_set(F.hex(both))), "").alias("drop"))


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               filter_bits: int = FILTER_BITS, most_bits: int = MOST_BITS, columns: list[str] | None = None, by_text: bool = False) -> DataFrame:
    """docs (columns ``columns``, default all) with n_lines, n_dropped, kept_text.

    A line's key is the line without ASCII whitespace at its ends, A-Z lower
    case. Lines whose key has at least min_chars code points and is found in at
    least min_docs documents go, but for all of them in the document with the
    largest id that holds the key.

    Nulls: a null text is one empty line, a null id sorts before all others; rows
    without an id are documents by their texts. Repeated rows count as one
    document and are treated alike; rows of one id with different texts are one
    document too, but for by_text, where each text is its own. An empty table
    gives no rows. Input columns called like a result column are replaced.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in (columns or docs.columns) if c.lower() not in COLUMNS]
    own = private(columns)
    drops = repeated_lines(docs, text_col, id_col, min_chars, min_docs, filter_bits, max(filter_bits, most_bits), by_text).toDF(own + "id", own + "of", own + "drop")
    doc, part = document_key(text_col, id_col, by_text)
    text = text_col if text_col in columns else own + "text"
    base = docs.select(*[named(c) for c in columns], *([] if text in columns else [named(text_col).alias(text)]), doc.alias(own + "doc"), part.alias(own + "part"))
    same = (F.col(own + "doc") == F.col(own + "id")) & (F.col(own + "part") == F.col(own + "of"))
    rows = base.join(drops, same, "left").select(*[named(c) for c in columns], named(text).alias(own + "whole"), F.unhex(own + "drop").alias(own + "keys"))
    n = len(columns)

    def cut(batches):
        for batch in batches:
            values, starts, ends = text_column(batch.column(n))
            data = values.tobytes() if len(values) else b""
            drop = batch.column(n + 1)
            n_lines, n_dropped, kept = [], [], []
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                text = data[a:b]
                count, gone = text.count(b"\n") + 1, 0
                if drop[i].is_valid:
                    keys = np.frombuffer(drop[i].as_py(), dtype=">u8").astype(np.uint64).reshape(-1, 2)
                    s, e, _, h1, h2 = long_keys(values, starts[i : i + 1], ends[i : i + 1], min_chars)
                    pairs = set(map(tuple, keys.tolist()))
                    out = {x for x, *key in zip(s.tolist(), h1.tolist(), h2.tolist()) if tuple(key) in pairs}
                    if out:
                        parts, at = [], a
                        for line in text.split(b"\n"):
                            if at not in out:
                                parts.append(line)
                            at += len(line) + 1
                        gone = count - len(parts)
                        text = b"\n".join(parts)
                n_lines.append(count)
                n_dropped.append(gone)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(n)], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [*columns, *COLUMNS])

    schema = docs.select(*[named(c) for c in columns]).schema.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    return in_arrow(rows, cut, schema)

