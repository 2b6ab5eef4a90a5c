"""Toxicity: FTRL-proximal logistic regression on hashed word features.

Features of a whole text: its distinct words, word pairs, skip pairs (one word
between) and word stems, hashed to ``2**HASH_BITS`` slots. Training texts are a
bounded sample of the labelled rows, written once to the shared folder. In each
round every task runs FTRL-proximal over its rows from the common state (z, n)
and returns its changes of the slots it touched, weighted by its share of the
rows; Spark sums them by slot into a table, as whole numbers, so that a task
that runs again changes nothing. Per-coordinate rates come from n, and L1 leaves
few slots with a weight, so the model is a small sorted table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import in_arrow, named, private, small_batches, stored
from .words import ALNUM, LOWER, groups_of, mix, span_hashes, text_column, words_of

HASH_BITS = 20
STEMS = (4, 5)  # bytes of a word's beginning
ALPHA, BETA, L2 = 1.0, 1.0, 0.01
L1_PER_ROOT_ROW = 0.016  # L1 follows the noise of a sum over the training rows
ROUNDS = 5
ROWS_PER_TASK, TASKS = 1000, 8  # tasks that train side by side
MAX_TRAIN_ROWS = 30_000  # bound of the sample of labelled rows, taken by hash
UNIT = 2.0**-32  # in which changes of a slot are summed
CUT = 0.3
COLUMNS = ["score"]


def features(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, only: np.ndarray | None = None):
    """Distinct slots of consecutive texts: (row, slot) in order of the row, and
    the number of words by row. ``only``: a table of the slots of interest."""
    s, e, (h,), first = words_of(values, starts, ends, ALNUM, lower=True)
    n = len(starts)
    row = np.repeat(np.arange(n), np.diff(first))
    slots, rows = [], []
    shift = np.uint64(64 - HASH_BITS)

    def add(r, hashes):
        slot = (hashes >> shift).astype(np.int64)
        if only is not None:
            hit = only[slot]
            r, slot = r[hit], slot[hit]
        rows.append(r)
        slots.append(slot)

    add(row, mix(h))
    for gap in (1, 2):
        at = np.arange(max(len(h) - gap, 0))
        at = at[row[at] == row[at + gap]] if len(at) else at
        add(row[at], mix(h[at] * np.uint64(2 * gap + 1) + mix(h[at + gap])))
    if len(s):
        lo = int(starts[0])
        v = LOWER[values[lo : int(ends[-1])]]
        for k in STEMS:
            long = e - s >= k
            add(row[long], mix(span_hashes(v, s[long] - lo, s[long] - lo + k, 2)))
    key = np.sort((np.concatenate(rows) << HASH_BITS) | np.concatenate(slots))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return key >> HASH_BITS, key & ((1 << HASH_BITS) - 1), np.diff(first)


def scale(n_words):
    """Value of a present feature: large texts count each one for less."""
    return 1 / np.sqrt(1 + np.log1p(n_words))


class Ftrl:
    """State (z, n) of all slots, and of the constant in slot 2**HASH_BITS."""

    def __init__(self, z: np.ndarray, n: np.ndarray, l1: float):
        self.z, self.n, self.l1 = z, n, l1

    @staticmethod
    def new(base_rate: float, l1: float) -> "Ftrl":
        size = (1 << HASH_BITS) + 1
        model = Ftrl(np.zeros(size), np.zeros(size), l1)
        model.z[-1] = -np.log(base_rate / (1 - base_rate)) * BETA / ALPHA
        return model

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = at == len(self.z) - 1  # the constant
        l1, l2 = np.where(free, 0.0, self.l1), np.where(free, 0.0, L2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    def learn(self, slots: np.ndarray, n_words: int, label: float) -> None:
        at = np.append(slots, len(self.z) - 1)
        x = np.full(len(at), scale(n_words))
        x[-1] = 1.0
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


class Model:
    """The non-zero weights: sorted slots, their weights and the constant."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, constant: float):
        self.slots, self.weights, self.constant = slots, weights, constant

    def scores(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        only = np.zeros(1 << HASH_BITS, bool)
        only[self.slots] = True
        out = np.zeros(len(starts))
        for i, j in groups_of(starts, ends):
            rows, slots, words = features(values, starts[i:j], ends[i:j], only)
            found = np.bincount(rows, self.weights[np.searchsorted(self.slots, slots)], j - i) if len(rows) else np.zeros(j - i)
            out[i:j] = 1 / (1 + np.exp(-np.clip(found * scale(words) + self.constant, -35, 35)))
        return out


def train_rows(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(label, text) of at most about max_rows labelled rows, taken by a hash of
    the id. The sampled labels are broadcast: the bound is their proven size."""
    known = labels.select(named(id_col).cast("long").alias("id"), named(label_col).cast("double").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    known = stored(known, "toxicity-labels")
    share = min(1.0, max_rows / max(known.count(), 1))
    order = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(1 << 30))
    sample = known.filter(order < int(share * (1 << 30)) if share < 1 else F.lit(True))
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")).join(F.broadcast(sample), "id")
    tasks = max(1, min(TASKS, -(-min(max_rows, known.count()) // ROWS_PER_TASK)))
    rows = rows.withColumn("order", order).repartition(tasks, "order").sortWithinPartitions("order", "id", "label", "text")
    return stored(rows.select("label", "text"), "toxicity-train")


def fit(rows: DataFrame) -> Model | None:
    """rows: (label, text). Rounds of FTRL-proximal in tasks, averaged by their rows.

    The driver reads one row a touched slot and round, 2**HASH_BITS + 1 at most,
    whatever the number of tasks.
    """
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    if not n:
        return None
    rate = min(max(positive / n, 0.5 / (n + 1)), (n + 0.5) / (n + 1))
    model = Ftrl.new(rate, min(3.0, L1_PER_ROOT_ROW * n**0.5))
    parts = rows.coalesce(TASKS)
    for _ in range(ROUNDS):
        start = Ftrl(model.z.astype(np.float32), model.n.astype(np.float32), model.l1)

        def learn(batches, start=start):
            own, count = Ftrl(start.z.astype(float), start.n.astype(float), start.l1), 0
            for batch in batches:
                labels = batch.column(0).to_numpy(zero_copy_only=False)
                values, starts, ends = text_column(batch.column(1))
                for i, j in groups_of(starts, ends):
                    row, slots, words = features(values, starts[i:j], ends[i:j])
                    cut = np.searchsorted(row, np.arange(j - i + 1))
                    for k in range(j - i):
                        own.learn(slots[cut[k] : cut[k + 1]], int(words[k]), float(labels[i + k]))
                count += len(labels)
            change = [np.rint((a - b) * (count / n / UNIT)).astype(np.int64) for a, b in ((own.z, start.z), (own.n, start.n))]
            at = np.flatnonzero(change[0] | change[1])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(change[0][at]), pa.array(change[1][at])], ["slot", "z", "n"])

        summed = parts.mapInArrow(learn, "slot int, z long, n long").groupBy("slot").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
        changed = stored(summed, "toxicity-round").toArrow()
        at = changed["slot"].to_numpy()
        model.z[at] += changed["z"].to_numpy() * UNIT
        model.n[at] += changed["n"].to_numpy() * UNIT
    w = model.weights(np.arange(len(model.z)))
    slots = np.flatnonzero(w[:-1])
    return Model(slots, w[slots], float(w[-1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
                   keep: list[str] | None = None, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """docs (columns ``keep``, default the id) with score: how likely label 1 is.

    labels: (id_col, label_col), only rows to learn from; at most about
    max_train_rows of them are used, every document is scored over its whole
    text. Repeated labels of an id count as the largest. Nulls: a null text is
    an empty text, null labels and labels of null ids are left out. Without any
    labelled row every score is 0.5. Repeated rows get equal scores; an empty
    table gives no rows. An input column called score is replaced.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (keep or [id_col]) if c.lower() not in COLUMNS]
    model = fit(train_rows(docs, labels, text_col, id_col, label_col, max_train_rows))
    rows = docs.select(*map(named, keep), named(text_col).alias(private(keep) + "text"))

    def score(batches):
        for batch in batches:
            values, starts, ends = text_column(batch.column(len(keep)))
            y = np.full(len(starts), 0.5) if model is None else model.scores(values, starts, ends)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(y)], [*keep, "score"])

    return in_arrow(rows, score, docs.select(*map(named, keep), F.lit(None).cast("double").alias("score")).schema)
