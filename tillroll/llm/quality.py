"""Quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics of a
whole text. Ridge scores come from normal equations: every task sums the outer
products of its labelled rows, Spark adds the sums, and the driver solves one
small system whose size depends on the number of features only. Sums are kept
by fold, so scores of held-out folds cost one more solution, and isotonic
regression calibrates on these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import id_of, in_arrow, named, private, small_batches, stored
from .words import SPACE, byte_class, groups_of, mix, span_hashes, text_column, words_of

FEATURES = 256
BANDWIDTH = 4.0
RIDGE = 1e-5  # of the number of labelled rows
FOLDS = 2
BINS = 4096  # of ridge scores, for the calibration
CUT = 0.3
COLUMNS = ["score"]

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "a an and are as at be by for from he her his in is it not of on or that the this to was were which with you "
    "au aux dans de des du elle en et il la le les ne pas par pour que qui sur un une "
    "auf das dem den der die ein eine er es im ist mit nicht sich sie und von zu "
    "al como con del el ella está esta las lo los más no para se su una y"
).split()

STATS = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "sentence_marks", "symbols", "beyond_ascii", "line_breaks",
    "distinct_words", "distinct_pairs", "distinct_fives", "commonest_word", "function_words", "symbol_ends", "no_letters", "repeated_lines",
    "words_per_line", "capital_starts", "long_words", "longest_word",
]

# classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 . , ; : ? and quotes, 7 other marks, 8 beyond ASCII
_CLASS = np.zeros(256, np.uint8)
for _k, _c in enumerate([byte_class((97, 122)), byte_class((65, 90)), byte_class((48, 57)), SPACE, byte_class((10, 10)), byte_class((33, 126)), byte_class((128, 255))], 1):
    _CLASS[_c & ((_CLASS == 0) | (_k == 5))] = _k if _k < 6 else _k + 1
for _m in b".,;:?'\"-":
    _CLASS[_m] = 6


def _row_max(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Largest value by row (0 without any); rows in order."""
    out = np.zeros(n)
    if len(rows):
        begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[begin]] = np.maximum.reduceat(values, begin)
    return out


def _distinct_share(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct hashes and of the commonest one, by row (1 and 0 without any)."""
    total = np.bincount(rows, minlength=n)
    shift = np.uint64(max(1, n.bit_length()))  # the row in the high bits, the hash below
    key = np.sort((rows.astype(np.uint64) << (np.uint64(64) - shift)) | (hashes >> shift))
    r = (key >> (np.uint64(64) - shift)).astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    most = _row_max(r[at], np.diff(np.append(at, len(r))), n)
    some = np.maximum(total, 1)
    return np.where(total > 0, np.bincount(r[at], minlength=n) / some, 1.0), most / some


def _function_word_hashes() -> np.ndarray:
    blob = np.frombuffer((" ".join(FUNCTION_WORDS) + " ").encode(), np.uint8)
    ends = np.flatnonzero(blob == 32)
    return np.unique(span_hashes(blob, np.concatenate([[0], ends[:-1] + 1]), ends))


def doc_stats(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """STATS of consecutive whole texts, one row each; an empty text has zeros
    (and ones for the distinct shares)."""
    n = len(starts)
    lo, hi = int(starts[0]), int(ends[-1])
    size = ends - starts
    v = values[lo:hi]
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 9 + _CLASS[v], minlength=9 * n).reshape(n, 9).astype(float)
    s, e, (h,), first = words_of(values, starts, ends)
    words = np.diff(first)
    wrow = np.repeat(np.arange(n), words)
    length = (e - s).astype(float)
    some, letters = np.maximum(words, 1), np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 8], 1)
    bytes_ = np.maximum(size, 1)
    mean = np.bincount(wrow, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(wrow, length**2, n) / some - mean**2, 0))
    per_word = lambda x: np.bincount(wrow, x, n) / some
    one, most = _distinct_share(wrow, h, n)
    share = []
    for k in (2, 5):
        at = np.arange(max(len(h) - k + 1, 0))
        at = at[wrow[at] == wrow[at + k - 1]] if len(at) else at
        share.append(_distinct_share(wrow[at], span_hashes(h, at, at + k), n)[0])
    letter = np.zeros(len(v) + 1, np.int64)
    np.cumsum(np.isin(_CLASS[v], (1, 2, 8)), out=letter[1:])
    last, begin = _CLASS[values[e - 1]], _CLASS[values[s]]
    breaks = np.flatnonzero(v == 10) + lo
    line_s, line_e = np.sort(np.concatenate([starts, breaks + 1])), np.sort(np.concatenate([ends, breaks]))
    line_row = np.repeat(np.arange(n), 1 + np.searchsorted(breaks, ends) - np.searchsorted(breaks, starts))
    full = line_e > line_s
    line_row, lh = line_row[full], mix(span_hashes(v, line_s[full] - lo, line_e[full] - lo))
    lines = np.bincount(line_row, minlength=n)
    longest = _row_max(wrow, length, n)
    known = _function_word_hashes()
    common = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    return np.stack([
        np.log1p(size), np.log1p(words), mean, spread, kinds[:, 2] / letters, kinds[:, 3] / bytes_, kinds[:, 6] / some, kinds[:, 7] / bytes_, kinds[:, 8] / bytes_, kinds[:, 5] / some,
        one, share[0], share[1], most, per_word(common), per_word((last == 7) | (last == 0)), per_word(letter[e - lo] == letter[s - lo]),
        1 - _distinct_share(line_row, lh, n)[0], np.log1p(words / np.maximum(lines, 1)), per_word(begin == 2), per_word(length > 20), np.log1p(longest),
    ], axis=1)


def stats_of(docs: DataFrame, text_col: str, keep: list[str], stats_col: str = "stats") -> DataFrame:
    """keep columns and stats_col array<float> of every whole text."""
    small_batches(docs.sparkSession)

    def measure(batches):
        for batch in batches:
            values, starts, ends = text_column(batch.column(len(keep)))
            parts = [doc_stats(values, starts[i:j], ends[i:j]) for i, j in groups_of(starts, ends)]
            rows = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATS)), pa.array(rows.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], stats], [*keep, stats_col])

    rows = docs.select(*map(named, keep), named(text_col).alias(private(keep) + "text"))
    return in_arrow(rows, measure, docs.select(*map(named, keep), F.array().cast("array<float>").alias(stats_col)).schema)


class Features:
    """Standardised statistics, their random Fourier features and a constant."""

    def __init__(self, mean, std, m: int = FEATURES, bandwidth: float = BANDWIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = np.asarray(mean), np.where(np.asarray(std) > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / bandwidth, (len(self.mean), m))
        self.b = rng.uniform(0, 2 * np.pi, m)

    @property
    def size(self) -> int:
        return self.w.shape[0] + self.w.shape[1] + 1

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b), 0.1 * x, np.ones((len(x), 1))], axis=1)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, len(STATS)))


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators on bins in order of x: (block centres, block means)."""
    blocks: list[list[float]] = []
    for at, count, good in zip(x, n, positive):
        blocks.append([at * count, count, good])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], (b[:, 2] + 0.5 * b[:, 2].sum() / b[:, 1].sum()) / (b[:, 1] + 0.5)


class Model:
    """Ridge weights and calibration; calling it gives scores in (0, 1)."""

    def __init__(self, features: Features, beta: np.ndarray, centres: np.ndarray, means: np.ndarray):
        self.features, self.beta, self.centres, self.means = features, beta, centres, means

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        ridge = self.features(stats) @ self.beta
        # within a block of the calibration the ridge score keeps the order
        return np.clip(0.998 * np.interp(ridge, self.centres, self.means) + 0.002 / (1 + np.exp(-4 * (ridge - 0.5))), 0.0, 1.0)


def fit(rows: DataFrame) -> Model | None:
    """rows: (id long, label int, stats); None without any labelled row."""
    spark = rows.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    rows = stored(rows.select((F.abs(F.xxhash64("id") % FOLDS)).cast("int").alias("fold"), F.col("label").cast("double").alias("label"), "stats"), "quality-train").coalesce(tasks)
    d = len(STATS)
    moments = rows.agg(F.count("*"), *[f(F.col("stats")[k].cast("double")) for f in (F.avg, F.stddev_pop) for k in range(d)]).first()
    if not moments[0]:
        return None
    features = Features(np.array(moments[1 : 1 + d]), np.array(moments[1 + d :]))
    m = features.size

    def sums(batches):
        total = np.zeros((FOLDS, m, m + 1))
        for batch in batches:
            fold, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), features(_matrix(batch.column(2)))
            for k in range(FOLDS):
                z = x[fold == k]
                total[k] += z.T @ np.concatenate([z, y[fold == k, None]], axis=1)
        at = np.arange(total.size, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    total = np.zeros(FOLDS * m * (m + 1))
    added = rows.mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # FOLDS * m * (m + 1) rows
    total[added["at"].to_numpy()] = added["value"].to_numpy()
    total = total.reshape(FOLDS, m, m + 1)
    count = float(moments[0])

    def solve(part):
        return np.linalg.solve(part[:, :m] + RIDGE * count * np.eye(m), part[:, m])

    everything = total.sum(axis=0)
    betas = [solve(everything - total[k]) for k in range(FOLDS)]

    def bins(batches):
        for batch in batches:
            fold, x = batch.column(0).to_numpy(), features(_matrix(batch.column(2)))
            ridge = np.einsum("ij,ij->i", x, np.stack(betas)[fold]) if len(x) else np.zeros(0)
            at = np.clip((ridge + 1) / 3 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "label"])

    table = rows.mapInArrow(bins, "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect()  # BINS rows
    x = np.array([(r["bin"] + 0.5) / BINS * 3 - 1 for r in table])
    centres, means = isotonic(x, np.array([r["n"] for r in table], float), np.array([r["good"] for r in table], float))
    return Model(features, solve(everything), centres, means)


def score_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
                  keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``, default the id) with score: how likely label 1 is.

    labels: (id_col, label_col), only rows to learn from. All labelled rows are
    used; repeated labels of an id count as the largest. Nulls: a null text is
    an empty text, null labels and labels of null ids are left out. Without any
    labelled row every score is 0.5. Repeated rows get equal scores; an empty
    table gives no rows. An input column called score is replaced.
    """
    keep = [c for c in (keep or [id_col]) if c.lower() not in COLUMNS]
    own = private([*keep, text_col])
    keys = docs.select(*map(named, keep), named(text_col).alias(own + "text"), id_of(id_col).alias(own + "id"))
    measured = stored(stats_of(keys, own + "text", [*keep, own + "id"], own + "stats"), "quality-stats")
    known = labels.select(named(id_col).cast("long").alias("id"), named(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    model = fit(measured.select(F.col(own + "id").alias("id"), F.col(own + "stats").alias("stats")).join(known, "id"))

    def score(batches):
        for batch in batches:
            x = _matrix(batch.column(len(keep)))
            y = np.full(len(x), 0.5) if model is None else model(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(y)], [*keep, "score"])

    schema = docs.select(*map(named, keep), F.lit(None).cast("double").alias("score")).schema
    return in_arrow(measured.select(*map(named, keep), own + "stats"), score, schema)
