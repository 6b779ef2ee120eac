"""Scoring by a log-bilinear language model.

Tokens are words with A-Z lowered, and an end. The most frequent words are classes of their own (the
more, the larger the vocabulary); the others fall into classes by their last two characters. Classes
are ranked by frequency and cut into clusters of about equal sums of roots of their frequency.

The three classes before a token, each through the matrix of its position, add up to a predicted
vector h. A cluster has the energy h . u + a and a class within its cluster h . q + b. Both are trained in
numpy by noise-contrastive estimation, on batches of tokens against noise drawn from the clusters'
and the classes' frequencies. Every task trains on all tokens of its part of the corpus from the same
start, and the tasks' parameters are averaged, weighted by their tokens; the next round starts there.
Batched matrix products then give the log-probabilities of a cluster and of a class in it, both
normalised. Within a class that several words share, a word has its add-one share, with one place for
words never seen. So the probabilities of all words after any context add up to one.

Spark counts every word of all training texts. Only words that hold over 1 / dictionary of all tokens,
so fewer than `dictionary`, reach the driver and are sent out, beside the model, whose size has the
bound of `most_words`. Counts of rarer words are joined in Spark by the word; by the same bound none
of those is hot. Parameters are summed block by block, so that no task holds more than a batch of them.

Edge cases: null text counts as empty and has the end alone. A null doc_id is a training row.
Repeated rows each count. Words of equal counts are ranked by their bytes. Very long texts are scored
whole, in slices of tokens. Without training tokens all probabilities are those of one unseen word. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import map_arrow, materialize, raw

END = b""
#: Classes before a token that predict it.
CONTEXT = 3


@dataclass(frozen=True)
class LmConfig:
    dictionary: int = 1_000_000
    #: Words with a class of their own: this share of the words that reach the driver, within these bounds.
    own_share: float = 0.1
    least_words: int = 1024
    most_words: int = 16_384
    groups: int = 64
    dims: int = 16
    #: Noise draws for a batch, at each level.
    noise: int = 16
    batch: int = 8192
    rounds: int = 1
    rate: float = 0.05
    #: Deviation of the vectors' first values.
    spread: float = 0.1
    seed: int = 1


def held_out(doc_id: Column, parts: int = 7) -> Column:
    """Whether crc32 of the doc_id as text leaves 2; null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % parts == 2, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


#: Bytes of text that are cut into words at a time; a longer text is a slice of its own.
SLICE = 16 << 20


def token_slices(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Slices of the texts as (distinct words, the end first; place of every token among them; where each text starts, and the end), all cut and numbered in Arrow."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, until - at)))
        coded = split.flatten().dictionary_encode()
        words = [END, *coded.dictionary.cast(pa.binary()).to_pylist()]
        place = coded.indices.to_numpy(zero_copy_only=False) + 1
        cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
        if END in words[1:]:  # what is left of spaces at an end of a text is no word
            real = place != words.index(END, 1)
            cuts = np.concatenate(([0], np.cumsum(real)))[cuts]
            place = place[real]
        yield words, np.insert(place, cuts[1:], 0), cuts + np.arange(len(cuts))
        at = until


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (word, n); counts are given out before they fill the memory."""
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for b in batches:
        for text in raw(b.column(0)):
            counts.update(tokens(text))
            if len(counts) > 400_000:
                yield flush()
    yield flush()


def group_of(word: bytes, config: LmConfig) -> int:
    return zlib.crc32(word.decode()[-2:].encode()) % config.groups


@dataclass
class Words:
    """What is sent out about words: frequent ones by number, with their class and log10(count + 1); the classes of groups, and the end's."""

    numbers: dict[bytes, int]
    classes: np.ndarray
    logs: np.ndarray
    groups: np.ndarray
    end: int
    config: LmConfig


class WordNumbers(dict):
    """Numbers of frequent words, and -1 less its class for any other word; the latter are remembered with a bound."""

    def __init__(self, words: Words):
        super().__init__(words.numbers)
        self.words, self.most = words, len(words.numbers) + 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
            self.update(self.words.numbers)
        self[word] = c = -1 - int(self.words.groups[group_of(word, self.words.config)])
        return c

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def classes(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers >= 0, self.words.classes[numbers], -1 - numbers) if len(self.words.classes) else -1 - numbers


def contexts(classes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The classes before each token, the nearest first, of texts that start at these places; ends come before a text."""
    out = np.full((CONTEXT, len(classes)), end, classes.dtype)
    for i in range(1, CONTEXT + 1):
        out[i - 1, i:] = classes[:-i]
        for k in range(i):
            at = starts + k
            out[i - 1, at[at < len(classes)]] = end
    return out.T


@dataclass
class LogBilinear:
    """Classes are numbered by rank; cluster c holds those from bounds[c] to bounds[c + 1]."""

    bounds: np.ndarray
    #: Frequencies of the classes; the noise is drawn from them.
    share: np.ndarray
    #: Vectors of context classes, matrices of positions, vectors and biases of clusters, and of classes in them.
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, counts: np.ndarray, config: LmConfig) -> LogBilinear:
        """From the classes' counts, in descending order."""
        share = (counts + 1.0) / (counts.sum() + len(counts))
        weight = np.cumsum(np.sqrt(share))
        wanted = max(1, round(len(counts) ** 0.5 / 2))
        part = np.minimum((weight / weight[-1] * wanted).astype(int), wanted - 1)
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(counts)]))
        rng, d, k, c = np.random.default_rng(config.seed), config.dims, len(counts), len(bounds) - 1
        whole = np.add.reduceat(share, bounds[:-1])
        near = lambda n: rng.normal(0, config.spread, (n, d))
        parts = {"r": near(k), "c": np.stack([np.eye(d) / 2**i for i in range(CONTEXT)]), "u": near(c), "a": np.log(whole), "q": near(k), "b": np.log(share) - np.log(np.repeat(whole, np.diff(bounds)))}
        return cls(bounds, share, {n: p.astype(np.float32) for n, p in parts.items()})

    def log_probabilities(self, before: np.ndarray, after: np.ndarray, slice_: int = 1 << 14) -> np.ndarray:
        """log P(after | before) in natural logarithms, as doubles."""
        p, out = self.parts, np.zeros(len(after))
        tables = [p["r"] @ m for m in p["c"]]
        cluster = np.searchsorted(self.bounds, after, "right") - 1
        for i in range(0, len(after), slice_):
            x, own, at = before[i : i + slice_], cluster[i : i + slice_], after[i : i + slice_]
            h = tables[0][x[:, 0]]
            for k in range(1, CONTEXT):
                h = h + tables[k][x[:, k]]
            found = normalised(h @ p["u"].T + p["a"], own)
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(len(self.bounds)))
            for c in np.flatnonzero(np.diff(cuts)).tolist():
                low, high = self.bounds[c], self.bounds[c + 1]
                if high - low > 1:
                    rows = order[cuts[c] : cuts[c + 1]]
                    found[rows] += normalised(h[rows] @ p["q"][low:high].T + p["b"][low:high], at[rows] - low)
            out[i : i + slice_] = found
        return out


def normalised(energy: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each row's energies, at one place of each. Works in the energies' memory."""
    if energy.size and max(energy.max(), -energy.min()) > 60:
        energy -= energy.max(axis=1, keepdims=True)
    chosen = energy[np.arange(len(at)), at].astype(np.float64)
    return chosen - np.log(np.exp(energy, out=energy).sum(axis=1, dtype=np.float64))


class Trainer:
    """Noise-contrastive estimation of a model's parts, by steps of Adagrad."""

    def __init__(self, model: LogBilinear, config: LmConfig, seed: list[int]):
        self.model, self.config, self.rng = model, config, np.random.default_rng(seed)
        self.parts = {n: p.copy() for n, p in model.parts.items()}
        self.seen = {n: np.full_like(p, 1e-8) for n, p in model.parts.items()}
        bounds, k = model.bounds, np.float32(np.log(config.noise))
        whole = np.add.reduceat(model.share, bounds[:-1])
        within = model.share / np.repeat(whole, np.diff(bounds))
        #: For each level: running sums of the noise's shares, and log odds of a draw of noise.
        self.edges = {"u": np.cumsum(whole), "q": np.cumsum(model.share)}
        self.odds = {"u": np.log(whole).astype(np.float32) + k, "q": np.log(within).astype(np.float32) + k}

    def move(self, name: str, rows: np.ndarray | slice, slope: np.ndarray) -> None:
        """A step for rows that are all different."""
        seen = self.seen[name][rows] + slope * slope
        self.seen[name][rows] = seen
        self.parts[name][rows] -= self.config.rate * slope / np.sqrt(seen)

    def contrast(self, h: np.ndarray, at: np.ndarray, vectors: str, biases: str, low: int, high: int, scale: np.float32) -> np.ndarray:
        """One level: targets `at` among low to high, ascending, against noise drawn by frequency. Moves vectors and biases; returns the slope by h."""
        v, b, odds, edges = self.parts[vectors], self.parts[biases], self.odds[vectors], self.edges[vectors]
        least = edges[low - 1] if low else 0.0
        noise = np.searchsorted(edges, least + self.rng.random(self.config.noise) * (edges[high - 1] - least), "right")
        noise = np.minimum(np.maximum(noise, low), high - 1)
        offset, own, drawn = b - odds if high - low == len(b) else None, v[at], v[noise]
        data = np.einsum("ij,ij->i", h, own) + (offset[at] if offset is not None else b[at] - odds[at])
        fake = h @ drawn.T
        fake += offset[noise] if offset is not None else b[noise] - odds[noise]
        wrong = -1 / (1 + np.exp(np.minimum(data, 30)))  # probability of data, less one
        np.negative(fake, out=fake)
        np.exp(np.minimum(fake, 30, out=fake), out=fake)
        fake += 1
        fooled = np.divide(1, fake, out=fake)
        own *= wrong[:, None]
        own += fooled @ drawn
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sv, sb = np.zeros((high - low, h.shape[1]), np.float32), np.zeros(high - low, np.float32)
        sv[at[first] - low], sb[at[first] - low] = np.add.reduceat(wrong[:, None] * h, first, axis=0), np.add.reduceat(wrong, first)
        np.add.at(sv, noise - low, fooled.T @ h)
        np.add.at(sb, noise - low, fooled.sum(axis=0))
        touched = slice(low, high)
        self.move(vectors, touched, sv * scale)
        self.move(biases, touched, sb * scale)
        return own

    def step(self, before: np.ndarray, after: np.ndarray) -> None:
        order = np.argsort(after, kind="stable")  # of 16-bit numbers: by radix
        before, after = before[order], after[order]
        p, bounds, scale = self.parts, self.model.bounds, np.float32(1 / len(after))
        own = np.searchsorted(bounds, after, "right") - 1
        rows = [p["r"][before[:, i]] for i in range(CONTEXT)]
        h = sum(x @ m for x, m in zip(rows, p["c"], strict=True))
        slope = self.contrast(h, own, "u", "a", 0, len(bounds) - 1, scale)
        cuts = np.searchsorted(own, np.arange(len(bounds)))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            low, high, part = int(bounds[c]), int(bounds[c + 1]), slice(cuts[c], cuts[c + 1])
            if high - low > 1:
                slope[part] += self.contrast(h[part], after[part], "q", "b", low, high, scale)
        slope *= scale
        at = before.T.reshape(-1)
        by_row = np.concatenate([slope @ m.T for m in p["c"]])
        self.move("c", slice(None), np.stack([x.T @ slope for x in rows]))
        turn = np.argsort(at, kind="stable")
        at = at[turn]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.move("r", at[first], np.add.reduceat(by_row[turn], first, axis=0))


#: Numbers in a block of parameters.
BLOCK = 1 << 14


def train_round(training: DataFrame, model: LogBilinear, words: Words, config: LmConfig, number: int) -> LogBilinear:
    """The mean of what the tasks make of the model, each on all tokens of its texts(text), weighted by tokens."""
    sent = training.sparkSession.sparkContext.broadcast((model, words))
    names = sorted(model.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words = sent.value
        known, trainer = WordNumbers(words), Trainer(start, config, [config.seed, number, TaskContext.get().partitionId()])
        before, after, held, seen = [], [], 0, 0

        def work(least: int) -> None:
            nonlocal before, after, held, seen
            if held < max(1, least):
                return
            x, y = np.concatenate(before), np.concatenate(after)
            done = held if least <= 1 else held // least * least
            turn = trainer.rng.permutation(done)
            for i in range(0, done, config.batch):
                trainer.step(x[turn[i : i + config.batch]], y[turn[i : i + config.batch]])
            before, after, held, seen = [x[done:]], [y[done:]], held - done, seen + done

        for b in batches:
            for distinct, place, cuts in token_slices(b.column(0)):
                classes = known.classes(known.of(distinct)).astype(np.int16)[place]
                before.append(contexts(classes, cuts[:-1], words.end))
                after.append(classes)
                held += len(classes)
                work(16 * config.batch)
        work(1)
        if seen:
            flat = np.concatenate([trainer.parts[n].reshape(-1) for n in names]).astype(np.float64) * seen
            blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            yield pa.record_batch([pa.array(range(len(blocks)), pa.int64()), pa.array([seen] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], ["block", "tokens", "numbers"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for block, n, numbers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                had = sums.setdefault(block, [0, 0.0])
                had[0], had[1] = had[0] + n, had[1] + np.frombuffer(numbers)
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], ["block", "tokens", "numbers"])

    kinds = "block long, tokens long, numbers binary"
    made = materialize(map_arrow(training, run, kinds))
    found = sorted(map_arrow(made.repartition("block"), add, kinds).collect(), key=lambda r: r["block"])  # a row for each block
    if not found:
        return model
    flat, at, parts = np.concatenate([np.frombuffer(bytes(r["numbers"])) / r["tokens"] for r in found]), 0, {}
    for n in names:
        size = model.parts[n].size
        parts[n] = flat[at : at + size].reshape(model.parts[n].shape).astype(np.float32)
        at += size
    return LogBilinear(model.bounds, model.share, parts)


def lm_scores(docs: DataFrame, config: LmConfig | None = None) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    config = config or LmConfig()
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    training = own.filter("not held_out").select("text")
    vocabulary = materialize(map_arrow(training, count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")))
    group = (F.crc32(F.substring("word", -2, 2).cast("binary")) % config.groups).cast("int")
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total["n"]), int(total["v"])
    is_often = (F.col("c") * config.dictionary > n_all) | (F.col("word") == "")  # the end always is
    often = vocabulary.filter(is_often).toArrow()
    frequent = dict(sorted(zip((w.encode() for w in often.column("word").to_pylist()), often.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0])))
    wanted = min(config.most_words, max(config.least_words, int(config.own_share * len(frequent))))
    singles = [END, *(w for w in list(frequent)[:wanted] if w != END)][:wanted]
    shared = {r["g"]: (r["n"], r["v"]) for r in vocabulary.groupBy(group.alias("g")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    left = np.array([shared.get(g, (0, 0)) for g in range(config.groups)], dtype=np.int64).reshape(-1, 2)
    for w in singles:
        if w in frequent:
            left[group_of(w, config)] -= (frequent[w], 1)
    counts = np.array([*(frequent.get(w, 0) for w in singles), *left[:, 0]], dtype=float)
    rank = np.argsort(-counts, kind="stable")
    place = np.argsort(rank, kind="stable")
    names = list(frequent)
    own_place = {w: int(place[i]) for i, w in enumerate(singles)}
    groups = place[len(singles) :]
    known_classes = np.array([own_place[w] if w in own_place else groups[group_of(w, config)] for w in names], np.int64)
    words = Words({w: i for i, w in enumerate(names)}, known_classes, np.log10(np.array([frequent[w] for w in names], float) + 1), groups, int(place[0]), config)
    if END not in frequent:  # no training text: the end still has its class
        words.numbers[END] = -1 - words.end
    model = LogBilinear.start(counts[rank], config)
    for number in range(config.rounds):
        model = train_round(training, model, words, config, number)
    room = np.zeros(len(counts))
    room[groups] = np.log10(left.sum(axis=1) + 1.0)  # add-one counts of a group's words and of one never seen
    sent = spark.sparkContext.broadcast((words, model, room))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, room = sent.value
        known, nth = WordNumbers(words), TaskContext.get().partitionId() << 33
        shared = np.zeros(len(room), bool)
        shared[words.groups] = True
        names = ["doc_id", "held_out", "row", "n_tokens", "n_frequent", "base", "model", "words", "counts"]
        for b in batches:
            at = 0
            for distinct, place, cuts in token_slices(b.column("text")):
                numbers = known.of(distinct)
                of_word = known.classes(numbers)
                classes, often, first = of_word[place], numbers >= 0, cuts[:-1]
                logs = np.where(often, words.logs[numbers], 0.0) if len(words.logs) else np.zeros(len(distinct))
                texts, total = len(first), lambda x, first=first: np.add.reduceat(x, first)
                n_tokens, n_frequent = np.diff(cuts), total(often[place].astype(np.int64))
                base = total(logs[place]) - n_tokens * np.log10(n_all + v_all + 1)
                inside = np.where(shared[of_word], logs, 0.0) - room[of_word]
                found = total(model.log_probabilities(contexts(classes, first, words.end), classes)) / np.log(10) + total(inside[place])
                rare = np.flatnonzero(~often[place])
                text_of = np.searchsorted(cuts, rare, "right") - 1
                pairs, n = np.unique(text_of * len(distinct) + place[rare], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs // len(distinct), np.arange(texts + 1)), pa.int32())
                rare_words = pa.array(distinct, pa.binary()).cast(pa.string()).take(pa.array(pairs % len(distinct)))
                part = b.slice(at, texts)
                yield pa.record_batch([
                    part.column("doc_id"), part.column("held_out"), pa.array(np.arange(nth, nth + texts)), pa.array(n_tokens.astype(np.int64)), pa.array(n_frequent), pa.array(base), pa.array(found),
                    pa.ListArray.from_arrays(offsets, rare_words), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64))),
                ], names)
                at, nth = at + texts, nth + texts

    rows = materialize(map_arrow(own, score, "doc_id long, held_out boolean, row long, n_tokens long, n_frequent long, base double, model double, words array<string>, counts array<long>"))
    rare = rows.select("row", F.inline(F.arrays_zip("words", "counts")))
    known = vocabulary.filter(~is_often).select(F.col("word").alias("__w"), "c")
    more = rare.join(known, F.expr("words = __w")).groupBy(F.col("row").alias("__r")).agg(F.sum("counts").alias("seen"), F.sum(F.col("counts") * F.log10(F.col("c") + 1)).alias("more"))
    out = rows.drop("words", "counts").join(more, F.expr("row = __r"), "left")
    extra = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"))
