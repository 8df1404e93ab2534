"""Quality rules: base counts of each text, and a calibrated classifier with a fixed threshold.

The classifier is a logistic regression on hashed word unigrams and bigrams and character n-grams of the lower-cased
text, each family as shares of its total, fitted to `quality` of a bounded sample of labelled rows (FIT_ROWS, by a
hash of doc_id) and calibrated on a quarter of the sample that the fit leaves out. The model is at most 2^18 numbers
for each family, whatever the corpus, and texts are scored in Arrow batches.

Null text: no words, so base_failed. No labels, or labels of one kind: every text that passes the base rules is kept.
Null qualities are left out; of several labels of a doc_id the least counts. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BASES, LOWER, arrow_map, batch, grams, utf8
from .repeats import byte_symbols, word_symbols

#: Labelled rows that a fit takes at most.
FIT_ROWS = 3000
BITS = 18
FAMILIES = 4
#: Least probability of good quality.
THRESHOLD = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT = 20, 30, 8
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], n: int = REPEAT) -> int:
    """Words in windows of n words that the text holds twice or more, all occurrences counted."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    runs = grams(seq.astype(np.uint64) + np.uint64(1), n, BASES[0])
    _, of, counts = np.unique(runs, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[of] > 1)
    if not len(at):
        return 0
    exact: dict[tuple, list[int]] = {}
    for i in at.tolist():
        exact.setdefault(tuple(seq[i : i + n].tolist()), []).append(i)
    hit = np.zeros(len(words) + 1, np.int64)
    for places in exact.values():
        if len(places) > 1:
            for i in places:
                hit[i] += 1
                hit[i + n] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = raw.split()
    solid = np.frombuffer(raw.translate(None, b" \t\n\x0b\x0c\r"), np.uint8)
    chars = int(((solid & 0xC0) != 0x80).sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * len(words)
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), again, failed


def features(raw: bytes) -> list[np.ndarray]:
    """Places of each family's n-grams, in order of the text."""
    low = raw.translate(LOWER)
    out = []
    for symbols, sizes in ((word_symbols(low), (1, 2)), (byte_symbols(low), (3, 5))):
        for n in sizes:
            got = grams(symbols, n, BASES[0])
            out.append((got >> np.uint64(64 - BITS)).astype(np.int32))
    return out


class Model:
    """Weights of each family, a bias and the calibration (a, b): probability = 1 / (1 + exp(-(a * score + b)))."""

    def __init__(self, weights: np.ndarray, bias: float, a: float = 1.0, b: float = 0.0):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def score(self, raw: bytes) -> float:
        return self.bias + float(sum(w[x].mean() if len(x) else 0.0 for w, x in zip(self.weights, features(raw))))

    def probability(self, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.score(raw) + self.b, -50, 50))))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Sample:
    """Texts' features: places in the joined families and shares of each text, and good (0 or 1)."""

    def __init__(self, at: list[np.ndarray], share: list[np.ndarray], good: np.ndarray):
        self.at, self.share, self.good = at, share, good

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and shares of some texts, one text after another, and the texts' sizes."""
        at = [self.at[i] for i in rows.tolist()]
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *at]), np.concatenate([none.astype(np.float32), *(self.share[i] for i in rows.tolist())]), np.array([len(x) for x in at], np.int64)


def fit(sample: Sample, epochs: int = 30, size: int = 128, rate: float = 0.7, decay: float = 1e-6, least_gain: float = 0.005) -> Model | None:
    """None where one kind is missing. The same sample gives the same model. Ends after `epochs`, or when an epoch lowers the loss by less than that share of it."""
    good = sample.good
    rows = len(good)
    if rows < 8 or good.min() == good.max():
        return None
    held = np.arange(rows) % 4 == 3
    if good[held].min() == good[held].max() or good[~held].min() == good[~held].max():
        held[:] = False
    balance = np.where(good > 0, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    n = FAMILIES << BITS
    w, g2, bias, b2 = np.zeros(n), np.full(n, 1e-8), 0.0, 1e-8
    rng = np.random.default_rng(3)
    use = np.flatnonzero(~held)
    parts = []  # of texts, drawn once: their features are numbered once
    for part in np.array_split(rng.permutation(use), max(1, len(use) // size)):
        at, x, sizes = sample.part(part)
        places, back = np.unique(at, return_inverse=True)
        parts.append((part, places, back.astype(np.int32), x, sizes))
    before = np.inf
    for _ in range(epochs):
        loss = 0.0
        for k in rng.permutation(len(parts)):
            part, places, back, x, sizes = parts[k]
            of = np.repeat(np.arange(len(part)), sizes)
            z = np.bincount(of, w[places][back] * x, len(part)) + bias
            loss += (balance[part] * np.logaddexp(0, np.where(good[part] > 0, -z, z))).sum()
            err = (_sigmoid(z) - good[part]) * balance[part] / len(part)
            g = np.bincount(back, err[of] * x, len(places)) + decay * w[places]
            g2[places] += g * g
            w[places] -= rate * g / np.sqrt(g2[places])
            b2 += err.sum() ** 2
            bias -= 0.1 * rate * err.sum() / np.sqrt(b2)
        if before - loss < least_gain * before:
            break
        before = loss
    model = Model(w.reshape(FAMILIES, -1).astype(np.float32), bias)
    check = np.flatnonzero(held) if held.any() else use
    z = np.array([(w[sample.at[i]] * sample.share[i]).sum() + bias for i in check])
    y = good[check]
    # Calibration (Platt): targets drawn in by the counts of each kind, Newton steps on two numbers.
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([((p - t) * z).sum(), (p - t).sum()]))
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    model.a, model.b = float(max(a, 1e-3)), float(b)
    return model


_MODEL = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("a", pa.float64()), ("b", pa.float64())])
_ROW = pa.schema([("doc", pa.int64()), ("at", pa.binary()), ("share", pa.binary()), ("good", pa.float64())])


def _featured(batches):
    for rb in batches:
        ats, shares = [], []
        for raw in utf8(rb.column("text")):
            at, share = [], []
            for k, x in enumerate(features(raw)):
                places, counts = np.unique(x, return_counts=True)
                at.append(places + (k << BITS))
                share.append(counts / max(1, len(x)))
            ats.append(np.concatenate(at).astype("<i4").tobytes())
            shares.append(np.concatenate(share).astype("<f4").tobytes())
        yield batch(_ROW, [rb.column("doc"), ats, shares, rb.column("good")])


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model of labels.quality, fitted to fit_rows documents at most. Of several texts of a doc_id the least counts. A text has 2^18 features a family at most, however long it is."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min("quality").cast("double").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc"), "doc").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(chosen), "doc").groupBy("doc", "good").agg(F.min("text").alias("text"))
    features = arrow_map(texts, _featured, "doc long, at binary, share binary, good double")
    got = arrow_map(features.repartition(1).sortWithinPartitions("doc"), _fitted, "weights binary, bias double, a double, b double").collect()
    return Model(np.frombuffer(got[0]["weights"], "<f4").reshape(FAMILIES, -1), got[0]["bias"], got[0]["a"], got[0]["b"]) if got else None


def _fitted(batches):
    """The sample, which has a bound, in one task: a row with the model, or none."""
    at, share, good = [], [], []
    for rb in batches:
        at += [np.frombuffer(x, "<i4") for x in rb.column("at").to_pylist()]
        share += [np.frombuffer(x, "<f4") for x in rb.column("share").to_pylist()]
        good += rb.column("good").to_pylist()
    model = fit(Sample(at, share, np.array(good, float)))
    if model:
        yield batch(_MODEL, [[model.weights.astype("<f4").tobytes()], [model.bias], [model.a], [model.b]])


_OUT = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())])


def judged(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and text of docs with the counts, probability (null without a model) and kept, a row for each row."""
    from .common import ship

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trained(docs, labels, fit_rows))

    def run(batches):
        model = shared.value
        for rb in batches:
            out = [[] for _ in _OUT]
            for raw in utf8(rb.column("text")):
                counts = base_counts(raw)
                p = model.probability(raw) if model else None
                for to, x in zip(out, (*counts, p, not counts[-1] and (p is None or p >= threshold))):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([*rb.columns, *batch(_OUT, out).columns], names=[*rb.schema.names, *_OUT.names])

    schema = "doc_id long, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def kept_only(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that are kept, in one pass without a shuffle; all columns stay, whatever their names."""
    from .common import ship

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trained(docs, labels, fit_rows))

    def run(batches):
        model = shared.value
        for rb in batches:
            keep = [not base_counts(raw)[-1] and (model is None or model.probability(raw) >= threshold) for raw in utf8(rb.column("text"))]
            yield rb.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op4_hashed_lr(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels).drop("text")
