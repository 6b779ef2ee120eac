"""Toxicity by maximum-scoring segments.

Words get log-odds between toxic and other labelled texts with an informative Dirichlet prior, whose
word shares are those of all documents; a word counts once for each text, as one that a single text
repeats says little. The words whose log-odds are significant keep them, all others cost a constant.
One linear scan of a text finds all its maximal segments (Ruzzo and Tompa). A segment's score has an
extreme-value distribution in texts without toxic passages (Karlin and Altschul), its decay from the
significant words' share of all documents: the chance of a segment this good in a text this long. The
significant ones are added up, and a logistic curve, fitted on the labelled training texts, turns the
evidence into a probability.

Labels are taken from at most `max_labelled` rows, chosen by a hash of the doc_id; what the model holds
is significant words of these rows' texts. Word counts and scoring cover all documents. Settings are
compared by cross_validate(), inside the training rows alone.

Edge cases: null text counts as empty, with the probability of a text without evidence. Labels
that are null or of unknown documents are ignored; of repeated labels the highest counts. Without
both kinds of labels every score is the share of toxic labels, or 0. Of segments of equal score all
count; a word whose log-odds are just significant counts. Very long texts are scanned whole. Repeated
rows are scored alike. An empty table gives an empty result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import map_arrow, materialize, raw
from embedspace.llm.lm_scoring import held_out

#: Stripped from the ends of a word.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class ToxicityConfig:
    max_labelled: int = 50_000
    #: Strength of the prior, as a share of the smaller class's words: with a constant one, words
    #: that other texts never have would not get more significant as their number grows.
    prior: float = 1.0
    #: Standard deviations from which log-odds are significant.
    least_z: float = 2.5
    #: Cost of any other word.
    drift: float = 0.5
    #: A segment counts if its chance in a clean text is below this.
    level: float = 0.9
    threshold: float = 0.3


@dataclass
class ToxicityModel:
    words: dict[bytes, float]
    drift: float
    decay: float
    level: float
    weights: list[float] = field(default_factory=list)
    constant: float | None = None

    def scores(self, words: list[bytes]) -> np.ndarray:
        get, drift = self.words.get, -self.drift
        return np.array([get(w, drift) for w in words])

    def evidence(self, text: bytes) -> tuple[float, float, float]:
        """Of the significant segments: the best one's and all their evidence, and their share of the words."""
        words = [w.strip(MARKS) for w in text.lower().split()]
        values = self.scores(words)
        found = []
        if (values > 0).any():
            for a, b, s in segments(values):
                # Chance of a segment of this score or more anywhere in a clean text of this length.
                expected = len(words) * math.exp(-self.decay * s)
                if -math.expm1(-expected) <= self.level:
                    found.append((self.decay * s - math.log(len(words)), b - a))
        if not found:
            return 0.0, 0.0, 0.0
        return max(x for x, _ in found), math.log1p(sum(max(x, 0.0) for x, _ in found)), sum(n for _, n in found) / len(words)

    def probability(self, evidence: tuple[float, float, float]) -> float:
        if self.constant is not None:
            return self.constant
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], evidence, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in one scan with a stack."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sums before and after, link to the last one that starts lower
    sums = np.concatenate(([0.0], np.cumsum(values)))
    for at in np.flatnonzero(values > 0).tolist():
        first, before, after = at, float(sums[at]), float(sums[at + 1])
        link = len(stack) - 1
        while True:
            while link >= 0 and stack[link][2] >= before:
                link = stack[link][4]
            if link < 0 or stack[link][3] >= after:
                break
            first, before = stack[link][0], stack[link][2]
            del stack[link:]
            link = len(stack) - 1
        stack.append((first, at + 1, before, after, link))
    return [(a, b, y - x) for a, b, x, y, _ in stack]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> list[float]:
    """Newton's method; constant first."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def decay_of(rate: float, gain: float, drift: float) -> float:
    """The positive solution of rate * exp(gain x) + (1 - rate) * exp(-drift x) = 1."""
    low, high = 1e-6, 20.0
    total = lambda x: rate * math.exp(min(700.0, gain * x)) + (1 - rate) * math.exp(-drift * x)
    if rate <= 0 or total(low) >= 1:
        return 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return low


def labelled(docs: DataFrame, labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """(text, toxic) of the training sample, written down. Its doc_ids and labels are at most max_labelled small rows and are broadcast."""
    clean = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    clean = materialize(clean.filter(~held_out(F.col("doc_id"), 4)))
    # Of many more rows than wanted most are dropped where they are, so that the sort's candidates stay few.
    share = min(1.0, 1.2 * config.max_labelled / max(1, clean.count()))
    sample = clean.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id").limit(config.max_labelled)
    sample = sample.select(F.col("doc_id").cast("long").alias("__i"), "toxic")
    return materialize(docs.select(F.col("doc_id").cast("long").alias("__d"), "text").join(F.broadcast(sample), F.expr("__d = __i")).select("text", "toxic"))


def words_of(text: bytes) -> set[bytes]:
    return {w.strip(MARKS) for w in text.lower().split()}


def word_texts(docs: DataFrame) -> DataFrame:
    """(word, n): in how many texts of docs(text) a word is; written down."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for text in raw(b.column(0)):
                counts.update(words_of(text))
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    return materialize(map_arrow(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def train_on(sample: DataFrame, corpus: DataFrame, config: ToxicityConfig) -> ToxicityModel:
    """From sample(text, toxic) and corpus(word, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        texts = [0, 0]
        for b in batches:
            for text, toxic in zip(raw(b.column(0)), b.column(1).to_pylist(), strict=True):
                counts[bool(toxic)].update(words_of(text))
                texts[bool(toxic)] += 1
        both = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch([pa.array([*both, None], pa.binary()), *(pa.array([*(counts[i][w] for w in both), texts[i]], pa.int64()) for i in (0, 1))], ["word", "c0", "c1"])

    counts = materialize(map_arrow(sample, count, "word binary, c0 long, c1 long").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    texts = counts.filter("word is null").first()
    words = counts.filter("word is not null")
    n = words.agg(F.coalesce(F.sum("c0"), F.lit(0)).alias("n0"), F.coalesce(F.sum("c1"), F.lit(0)).alias("n1")).first()
    t0, t1 = (int(texts["c0"]), int(texts["c1"])) if texts else (0, 0)
    if not t0 or not t1 or not n["n0"] or not n["n1"]:
        return ToxicityModel({}, config.drift, 1.0, config.level, constant=t1 / (t0 + t1) if t0 + t1 else 0.0)
    n0, n1 = int(n["n0"]), int(n["n1"])
    everywhere = int(corpus.agg(F.sum("n")).first()[0])
    prior = config.prior * min(n0, n1)
    share = prior * F.col("n") / F.lit(float(everywhere))
    odds = lambda c, total: F.log((c + share) / F.greatest(F.lit(total + prior) - c - share, F.lit(0.5)))
    gain = odds(F.col("c1"), n1) - odds(F.col("c0"), n0)
    z = gain / F.sqrt(1 / (F.col("c1") + share) + 1 / (F.col("c0") + share))
    known = words.filter("c1 > 0").join(corpus.withColumnRenamed("word", "__w"), F.expr("word = __w"))
    best = known.select("word", "n", gain.alias("gain"), z.alias("z")).filter((F.col("z") >= config.least_z) & (F.col("gain") > 0)).collect()
    hits = sum(r["n"] for r in best)
    mean = sum(r["gain"] * r["n"] for r in best) / hits if best else 1.0
    model = ToxicityModel({bytes(r["word"]): float(r["gain"]) for r in best}, config.drift, decay_of(max(hits, 0.5) / everywhere, mean, config.drift), config.level)
    x, y = evidence_of(sample, model)
    model.weights = fit_logistic(x, y)
    return model


def evidence_of(sample: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """The evidence in each text of sample(text, toxic), and the labels: four numbers for each labelled text."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.evidence(x) for x in raw(b.column(0))]
            yield pa.record_batch([*(pa.array([e[i] for e in found], pa.float64()) for i in range(3)), b.column(1)], ["best", "all", "share", "toxic"])

    seen = map_arrow(sample.select("text", "toxic"), collect, "best double, all double, share double, toxic int").toArrow()
    return np.column_stack([seen.column(i).to_numpy() for i in range(3)]), seen.column(3).to_numpy().astype(float)


def train_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None) -> ToxicityModel:
    config = config or ToxicityConfig()
    return train_on(labelled(docs, labels, config), word_texts(docs), config)


def cross_validate(docs: DataFrame, labels: DataFrame, configs: list[ToxicityConfig], folds: int = 4) -> list[dict[str, float]]:
    """For each setting what models trained without a fold of the training rows say of that fold: mean log loss, recall and precision at the threshold. Held-out rows take no part."""
    corpus, out = word_texts(docs), []
    sample = materialize(labelled(docs, labels, configs[0]).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(folds))))
    for config in configs:
        scores, truth = [], []
        for fold in range(folds):
            model = train_on(sample.filter(F.col("fold") != fold).select("text", "toxic"), corpus, config)
            x, y = evidence_of(sample.filter(F.col("fold") == fold), model)
            scores += [model.probability(tuple(e)) for e in x.tolist()]
            truth += y.tolist()
        p, y = np.clip(np.array(scores), 1e-6, 1 - 1e-6), np.array(truth) > 0
        said = p >= config.threshold
        out.append({"loss": float(-np.where(y, np.log(p), np.log(1 - p)).mean()), "recall": float((said & y).sum() / max(1, y.sum())), "precision": float((said & y).sum() / max(1, said.sum()))})
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    config = config or ToxicityConfig()
    sent = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels, config))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([model.probability(model.evidence(x)) for x in raw(b.column(2))], pa.float64())], ["doc_id", "held_out", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4).alias("held_out"), "text")
    return map_arrow(own, score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= config.threshold).cast("int"))


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, first_word, n_words, segment_score) of every maximal segment with a positive score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                rows += [(doc_id, x, y - x, s) for x, y, s in segments(sent.value.scores([w.strip(MARKS) for w in text.lower().split()]))]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "first_word", "n_words", "segment_score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), find, "doc_id long, first_word long, n_words long, segment_score double")
