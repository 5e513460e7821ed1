"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): all ordered thresholds share the weights w. The score is the expected grade.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, table, tidy

#: Labelled documents that the model is fitted on, at most: the ones whose ids have the smallest hashes.
SAMPLE_ROWS = 6_000
#: Of the sample, texts count as far as they have this many bytes in all, by the same order; so the driver's memory is bounded by bytes, too.
SAMPLE_BYTES = 24_000_000
#: Grades above 0 that toxic documents are split into, the L1 penalty, which leaves few features, and the limit of P(grade > 0).
LEVELS, L1, REJECT = 3, 5e-5, 0.5
#: Bytes of a stem.
STEM = 5
_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def features(text: str) -> tuple[Counter, Counter, int]:
    """Lower-case words without ASCII punctuation at their ends, their first 5 bytes, both counted, and the number of words."""
    words: Counter = Counter()
    for w, k in Counter(text.lower().encode().split()).items():
        words[w.strip(_PUNCTUATION)] += k
    words.pop(b"", None)
    stems: Counter = Counter()
    for w, k in words.items():
        if len(w) >= STEM:
            stems[w[:STEM]] += k
    return words, stems, max(1, words.total())


def density(count, n):
    """The value of a stem: 1 if a tenth of the words have it, near 0 for one in a long text. A word's value is 1."""
    return np.minimum(1.0, np.log1p(200 * count / n) / 3)


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    words, stems, n = features(text)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words] + [xxhash.xxh3_64_intdigest(w, 1) for w in stems], "<u8")
    return h, np.r_[np.ones(len(words)), density(np.array(list(stems.values()), float), n)].astype("<f4")


@dataclass
class OrdinalModel:
    weights: dict[int, float]  # by 64-bit hash of the word (seed 0) or stem (seed 1)
    thresholds: np.ndarray  # ascending, one per cut between grades

    def __post_init__(self) -> None:
        self.known: dict[bytes, tuple[bytes, float, float]] = {}

    def _look_up(self, raw: bytes) -> tuple[bytes, float, float]:
        w = raw.strip(_PUNCTUATION)
        get = self.weights.get
        found = (w, get(xxhash.xxh3_64_intdigest(w), 0.0), get(xxhash.xxh3_64_intdigest(w[:STEM], 1), 0.0) if len(w) >= STEM else 0.0)
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[raw] = found
        return found

    def margin(self, text: str) -> float:
        known, seen, stems, n = self.known, set(), {}, 0
        total = 0.0
        for raw, k in Counter(text.lower().encode().split()).items():
            found = known.get(raw) or self._look_up(raw)
            if found[0]:
                n += k
            if found[1] and found[0] not in seen:
                seen.add(found[0])
                total += found[1]
            if found[2]:
                stem = found[0][:STEM]
                stems[stem] = (stems.get(stem, (0, 0))[0] + k, found[2])
        return total + sum(w * float(density(k, n)) for k, w in stems.values())

    def tail(self, margin: float) -> np.ndarray:
        """P(grade > k) for each cut k; they sum to the expected grade."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - margin, -60, 60)))


def fit(features: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> OrdinalModel:
    """features: of each document the hashes and values of its words and stems; toxic: 0 or 1.

    The labels have no grades, so toxic documents get grades 1 to LEVELS by how many different words and stems they hold that mark toxic
    ones (at least 5 toxic documents hold it, and of its documents 9 in 10 are toxic), cut at equal shares. The model is then fitted to all grades
    by proximal gradient descent with momentum; the L1 penalty keeps it to few features. With one class only, all margins are 0 and
    the thresholds give that class's share.
    """
    toxic = np.asarray(toxic, np.int64)
    n = len(toxic)
    if n == 0 or toxic.min() == toxic.max():
        certain = 30.0 if n == 0 or not toxic.any() else -30.0
        return OrdinalModel({}, np.full(LEVELS, certain))
    row = np.repeat(np.arange(n), [len(f) for f, _ in features])
    flat = np.concatenate([f for f, _ in features])
    val = np.concatenate([v for _, v in features]).astype(np.float64)
    hashes, col = np.unique(flat, return_inverse=True)
    df = np.bincount(col, minlength=len(hashes))
    df_toxic = np.bincount(col, weights=toxic[row], minlength=len(hashes))
    marks = (df_toxic >= 5) & (df_toxic >= 0.9 * df)
    held = np.bincount(row, weights=marks[col], minlength=n)
    cuts = np.quantile(held[toxic == 1], np.arange(1, LEVELS) / LEVELS)
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, held, side="left"), 0)
    # Univariate screening: the features whose mass among toxic documents is furthest from their share of it, in standard errors.
    p = toxic.mean()
    mass, mass_toxic = (np.bincount(col, weights=x, minlength=len(hashes)) for x in (val, val * toxic[row]))
    z = np.abs(mass_toxic - mass * p) / np.sqrt(np.maximum(np.bincount(col, weights=val * val, minlength=len(hashes)) * p * (1 - p), 1e-9))
    z[df < 3] = 0
    chosen = np.flatnonzero(z > 4)
    new = np.full(len(hashes), -1)
    new[chosen] = np.arange(len(chosen))
    keep = new[col] >= 0
    row, col, val, d = row[keep], new[col[keep]], val[keep], len(chosen)
    w = np.zeros(d)
    share = np.array([(grade > k).mean() for k in range(LEVELS)])
    t = np.maximum.accumulate(np.log((1 - share + 1e-3) / (share + 1e-3)) + np.arange(LEVELS) * 1e-3)
    over = grade[:, None] > np.arange(LEVELS)[None, :]
    vw, vt = w.copy(), t.copy()
    step = 4.0
    for k in range(600):
        m = np.bincount(row, weights=vw[col] * val, minlength=n)
        s = 1 / (1 + np.exp(np.clip(vt[None, :] - m[:, None], -60, 60)))  # P(grade > k)
        upper = np.c_[np.ones(n), s][np.arange(n), grade]
        lower = np.c_[s, np.zeros(n)][np.arange(n), grade]
        mass = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        gm = -(du - dl) / mass / n  # derivative of the mean loss by the margin
        gt = np.zeros(LEVELS)
        np.add.at(gt, np.maximum(grade - 1, 0), np.where(grade > 0, du / mass / n, 0))
        np.add.at(gt, np.minimum(grade, LEVELS - 1), np.where(grade < LEVELS, -dl / mass / n, 0))
        gw = np.bincount(col, weights=gm[row] * val, minlength=d)
        rate = step / (1 + k / 100)
        w_new = vw - rate * gw
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * L1, 0)
        t_new = np.maximum.accumulate(vt - rate * gt)
        t_new += np.arange(LEVELS) * 1e-6
        b = k / (k + 3)
        vw, vt = w_new + b * (w_new - w), np.maximum.accumulate(t_new + b * (t_new - t)) + np.arange(LEVELS) * 1e-6
        w, t = w_new, t_new
    return OrdinalModel({int(h): float(x) for h, x in zip(hashes[chosen], w) if x}, t)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [hashed(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"toxic": batch.column(0), "hashes": pa.array([h.tobytes() for h, _ in both], pa.binary()), "amounts": pa.array([v.tobytes() for _, v in both], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> OrdinalModel:
    """Fits on at most sample_rows labelled documents of at most sample_bytes in all, in the order of the ids' hashes. A document labelled more than once is toxic if any of its labels says so;
    labels that are null or of unknown documents are left out. Only the sample's hashed features reach the driver."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # The sample has at most sample_rows rows of two numbers, so it can be broadcast.
    both = keyed(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    # One narrow row for each document of the sample.
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = both.select("doc_id", F.octet_length("text").alias("bytes")).withColumn("upto", F.sum("bytes").over(upto))
    fits = sizes.where(F.col("upto") <= sample_bytes).select("doc_id").distinct()
    texts = both.join(F.broadcast(fits), "doc_id", "left_semi").select("toxic", "text")
    rows = texts.mapInArrow(_hashes, "toxic int, hashes binary, amounts binary").collect()
    rows.sort(key=lambda r: (r["toxic"], bytes(r["hashes"]), bytes(r["amounts"])))
    return fit([(np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["amounts"], "<f4")) for r in rows], np.array([r["toxic"] for r in rows]))


def score(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: all its columns, with expected_severity (0 to LEVELS), toxic_probability, severity (the most likely
    grade) and toxic (toxic_probability >= 0.5) after them; Null and empty texts have no words and get the thresholds' base rate.
    Rows are independent: nothing is shuffled. Columns named like the new ones, in any case of letters, are replaced."""
    weights, thresholds = model.weights, model.thresholds
    mine = "expected_severity double, toxic_probability double, severity int, toxic boolean".split(", ")
    rest = [c for c in docs.columns if c.lower() not in {m.split()[0] for m in mine}]
    held = OrdinalModel(weights, thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.array([held.margin(t or "") for t in batch.column(rest.index(text_col)).to_pylist()])
            tails = 1 / (1 + np.exp(np.clip(held.thresholds[None, :] - margins[:, None], -60, 60)))
            edges = np.c_[np.ones(len(tails)), tails, np.zeros(len(tails))]
            extra = [pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(np.argmax(edges[:, :-1] - edges[:, 1:], 1).astype(np.int32)), pa.array(tails[:, 0] >= REJECT)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*rest, *(m.split()[0] for m in mine)])
        held.known = {}
        tidy()

    kept = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *mine])
    return kept.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every row and whole text of documents by a model fitted to labels; null and empty texts have no words. Empty labels reject
    nothing; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text")
