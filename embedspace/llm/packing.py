"""Packing of token sequences as a cutting-stock problem, by column generation.

Each document's tokens, with an end token, are cut into full sequences and a rest. Lengths of rests
fall into at most 512 classes, whose ends are dealt by the histogram so that little is rounded up. A
linear program over patterns, a pattern being how many rests of each class one sequence takes, is
solved by column generation: the simplex method prices new patterns by a knapsack dynamic program
over the dual values, many in each round, and starts from the patterns of best fit decreasing. It
ends when no pattern is worth more than a sequence, or when a lower bound shows that the program's
best is less than half a sequence or two in ten thousand away. Patterns are used a whole number of
times, rounded down, and what remains is placed best fit decreasing; if best fit alone takes fewer
sequences, its patterns are used. Where even so less than the wanted share is filled, as when
all documents have one awkward length, the emptiest sequences are dissolved and their rests cut
once more, into the gaps of the others.

Documents are ranked within their class and the ranks are handed to the places in the patterns;
ranks are counted in salted parts, more of them the more rests a class has, so that one length that
a third of the documents share is not ranked in one task.

Only the histogram (a count for each length) reaches the one task that makes the plan, and only the
plan (rows for each pattern and class) is sent out.

Edge cases: null text counts as empty and has the end token alone. A null doc_id is packed like any
other. Repeated rows are packed each by itself; which of equal rows takes which place is left open.
Rests of one class take places in the order of salted part, doc_id, text and start. Very long
texts are encoded in slices of their own and give many full sequences. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import math
import pickle
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedspace.llm.common import map_arrow, materialize, text_key

#: Bytes of text that are encoded at a time; a longer text is a slice of its own.
SLICE = 8 << 20


@dataclass(frozen=True)
class PackingConfig:
    tokenizer: str
    end_id: int = 2
    capacity: int = 4096
    #: Classes of lengths.
    classes: int = 512
    #: Rests of a class whose ranks are counted in one part, at most about; a class of some hundreds has parts too.
    part: int = 10_000
    #: Share of all sequences' room up to which rests are cut to fill gaps.
    fill: float = 0.995
    #: Gaps, as a share of the capacity, that rests are cut for.
    least_gap: float = 1 / 128
    #: Distance from the lower bound, as a share, at which the linear program ends.
    tolerance: float = 2e-4


class PartIds(dict):
    """Ids of the parts that the tokenizer cuts a text into, as little-endian 32-bit bytes; remembered with a bound.

    Plain texts are normalised and cut as the tokenizer does it, all in Arrow, which also numbers
    the parts, so that only distinct ones are looked up. Parts that are new are encoded many at a
    time: each part's last id, and no other, ends a word. Other texts are encoded whole.
    """

    #: The pattern by which the tokenizer's file cuts normalised text. Letters in between are parts too.
    PARTS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+)"
    #: How the tokenizer's file normalises and cuts. With a file that does otherwise all texts are encoded whole.
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Not plain: control and format characters, spaces other than ASCII ones, the sigma, whose small form depends on its place, and what could be a special token.
    ODD = "[^\\p{L}\\p{N}\\p{P}\\p{S}\\p{M} \\t-\\r]|\u03a3|<\\|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), 1_000_000
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cuts = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.known_cut = (spec["normalizer"] or {}).get("normalizers") == self.NORMALIZER and cuts[:1] == [self.CUT]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(some) and cuts[-1] == 4 * len(ids):
                data, at = ids.tobytes(), [0, *cuts.tolist()]
                self.update((p, data[at[k] : at[k + 1]]) for k, p in enumerate(some))
            else:
                self.update((p, self.whole(p).tobytes()) for p in some)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string array."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
            yield from self.encode_slice(pc.fill_null(texts.slice(at, end - at), ""))
            at = end

    def encode_slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.known_cut:
            yield from map(self.whole, texts.to_pylist())
            return
        odd = pc.match_substring_regex(texts, self.ODD).to_pylist()
        strings = texts.to_pylist()
        odd = [o or not unicodedata.is_normalized("NFC", t) for o, t in zip(odd, strings, strict=True)]
        small = pa.array(["" if o else t.lower() for o, t in zip(odd, strings, strict=True)], pa.string())
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(small, self.PARTS, r" \1 "))
        coded = split.flatten().dictionary_encode()
        place, parts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self) > self.limit:
            self.clear()
        self[""] = b""  # before a leading space
        self.learn([p for p in parts if p not in self])
        found = [self[p] for p in parts]
        flat, lengths = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        begins = np.cumsum(lengths) - lengths
        size = lengths[place]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(begins[place] - ends[:-1], size) + np.arange(ends[-1])]
        of_text = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
        cuts = ends[of_text]
        for i, o in enumerate(odd):
            yield self.whole(strings[i]) if o else ids[cuts[i] : cuts[i + 1]]


@functools.lru_cache(maxsize=2)
def part_ids(path: str) -> PartIds:
    """One for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PartIds(path)


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), "text")


def cut_pieces(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """(doc_id, th, start, length, ids_crc32, doc_tokens): full sequences and one rest for each document; th is the key of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = part_ids(config.tokenizer), np.array([config.end_id], "<u4")
        for b in batches:
            rows = []
            for doc_id, th, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), known.encode(b.column(2)), strict=True):
                ids, n = np.concatenate((own, end)), len(own) + 1
                rows += [(doc_id, th, s, min(config.capacity, n - s), zlib.crc32(ids[s : s + config.capacity]), n) for s in range(0, n, config.capacity)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["doc_id", "th", *PIECE[1:]])

    return map_arrow(with_key(docs), run, "doc_id long, th long, start long, length long, ids_crc32 long, doc_tokens long")


#: Rests of a class, by its place in the list of sizes, and how many of them one sequence takes.
Pattern = dict[int, int]


def classes_of(histogram: np.ndarray, most: int) -> np.ndarray:
    """Ends of at most that many classes: all lengths if they are few, else equal parts of the sum of roots of counts, which loses least."""
    lengths = np.flatnonzero(histogram)
    if len(lengths) <= most:
        return lengths
    weight = np.cumsum(np.sqrt(histogram[lengths]))
    part = np.minimum((weight / weight[-1] * most).astype(int), most - 1)
    return lengths[np.flatnonzero(np.diff(np.append(part, most)))]


def best_fit(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing; equal rests go into equal sequences many at a time, so the work depends on the classes alone."""
    open_: dict[int, dict[tuple, int]] = {}  # by room left: patterns and how many sequences have them
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, n = int(sizes[i]), int(counts[i])
        while n:
            left = min((r for r in open_ if r >= size), default=None)
            pattern, have = ((), n) if left is None else next(iter(open_[left].items()))
            each = (room if left is None else left) // size
            take, m = (min(have, n // each), each) if n >= each else (1, n)
            if left is not None:
                if have == take:
                    del open_[left][pattern]
                    if not open_[left]:
                        del open_[left]
                else:
                    open_[left][pattern] = have - take
            to = open_.setdefault((room if left is None else left) - m * size, {})
            key = (*pattern, (i, m))
            to[key] = to.get(key, 0) + take
            n -= take * m
    return [(dict(p), k) for patterns in open_.values() for p, k in patterns.items()]


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the whole: the greatest value of rests (any number of each) that fit, and the class taken last, or -1. sizes ascend."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    items = np.flatnonzero(values > 1e-12)
    v, s = values[items], sizes[items]
    fits = np.searchsorted(s, np.arange(room + 1), "right").tolist()
    top = 0.0
    for r in range(int(s[0]) if len(s) else room + 1, room + 1):
        gain = best[r - s[: fits[r]]]
        gain += v[: fits[r]]
        k = int(gain.argmax())
        if gain[k] > top + 1e-12:
            top, took[r] = float(gain[k]), items[k]
        best[r] = top
    return best, took


def column_generation(sizes: np.ndarray, counts: np.ndarray, room: int, start: list[Pattern], tolerance: float) -> list[tuple[Pattern, float]]:
    """Patterns and how often each is used in the best fractional solution, or one that a lower bound shows to be within the tolerance."""
    n = len(sizes)
    rng = np.random.default_rng(0)
    demand = counts * (1 + 1e-7 * rng.random(n)) + 1e-7 * rng.random(n)  # no ties between ratios
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ demand
    known: set[bytes] = set()
    pool = np.zeros((n, 0))

    def add(columns: list[np.ndarray]) -> bool:
        nonlocal pool
        new = {c.tobytes(): c for c in columns}
        new = {k: c for k, c in new.items() if k not in known}
        known.update(new)
        pool = np.column_stack([pool, *new.values()])
        return bool(new)

    def column(pattern: Pattern) -> np.ndarray:
        out = np.zeros(n)
        out[list(pattern)] = list(pattern.values())
        return out

    add([column(p) for p in start])
    bound, pivots, idle = float(counts @ sizes) / room, 0, 0
    while idle <= 2 * n + 100:  # so many pivots in a row that save nothing are rounding errors that go round
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        while pool.shape[1] and idle <= 2 * n + 100:
            worth = prices @ pool
            k = int(worth.argmax())
            if worth[k] <= 1 + 1e-7:
                break
            direction = inverse @ pool[:, k]
            up = direction > 1e-7
            if not up.any():
                break
            ratio = np.where(up, used / np.where(up, direction, 1), np.inf)
            tie = np.flatnonzero(ratio <= ratio.min() * (1 + 1e-9) + 1e-9)
            out = int(tie[direction[tie].argmax()])
            step, pivot = ratio[out], inverse[out] / direction[out]
            inverse -= np.outer(direction, pivot)
            inverse[out], basis[:, out] = pivot, pool[:, k]
            used = np.maximum(used - direction * step, 0)
            used[out] = step
            idle = idle + 1 if step * (worth[k] - 1) <= 1e-9 * used.sum() else 0
            pivots += 1
            if pivots % 100 == 0:
                inverse = np.linalg.inv(basis)
                used = np.maximum(inverse @ demand, 0)
            prices = inverse.sum(axis=0)
        best, took = knapsack(np.maximum(prices, 0), sizes, room)
        bound = max(bound, used.sum() / max(best[room], 1.0))
        if best[room] <= 1 + 1e-7 or used.sum() - bound < max(0.5, tolerance * used.sum()):
            break

        def filled(r: int, pattern: Pattern, took: np.ndarray = took) -> Pattern:
            while r > 0:
                if (i := int(took[r])) < 0:
                    r -= 1
                else:
                    pattern[i] = pattern.get(i, 0) + 1
                    r -= int(sizes[i])
            return pattern

        with_each = prices + best[room - sizes]  # the best pattern that holds a class at all
        each = [int(i) for i in np.argsort(-with_each)[:100] if with_each[i] > 1 + 1e-7]
        if not add([column(filled(room, {})), *(column(filled(int(room - sizes[i]), {i: 1})) for i in each)]):
            break
        if pool.shape[1] > 4 * n + 100:
            pool = pool[:, np.sort(np.argsort(-(prices @ pool))[: 2 * n])]
            known.clear()
            known.update(c.tobytes() for c in np.ascontiguousarray(pool.T))
    used = np.maximum(np.linalg.solve(basis, counts.astype(float)), 0)
    return [({int(i): int(basis[i, k]) for i in np.flatnonzero(basis[:, k])}, float(used[k])) for k in range(n)]


def patterns_of(sizes: np.ndarray, counts: np.ndarray, config: PackingConfig) -> list[tuple[Pattern, int]]:
    """Patterns that hold exactly these rests, with their numbers of sequences."""
    alone = best_fit(sizes, counts, config.capacity)
    if not len(sizes):
        return alone
    left, out = counts.copy(), []
    for pattern, times in column_generation(sizes, counts, config.capacity, [p for p, _ in alone], config.tolerance):
        whole = min([int(times + 1e-6), *(int(left[i]) // m for i, m in pattern.items())])
        if whole > 0:
            out.append((pattern, whole))
            for i, m in pattern.items():
                left[i] -= m * whole
    out += best_fit(sizes, left, config.capacity)
    return min((out, alone), key=lambda x: sum(k for _, k in x))


def dissolved(patterns: list[tuple[Pattern, int]], sizes: np.ndarray, config: PackingConfig) -> list[tuple[Pattern, int, int]]:
    """Patterns with their numbers of sequences that stay and that go: the emptiest go, as far as the wanted fill asks for it and the others' gaps have room."""
    load = lambda p: sum(int(sizes[i]) * m for i, m in p.items())
    patterns = sorted(patterns, key=lambda x: (load(x[0]), sorted(x[0].items())))
    loads, times = [load(p) for p, _ in patterns], [k for _, k in patterns]
    least = max(1, int(config.capacity * config.least_gap))
    gaps = [g if (g := config.capacity - x) >= least else 0 for x in loads]
    wanted = max(0, sum(times) - math.ceil(sum(x * k for x, k in zip(loads, times, strict=True)) / (config.capacity * config.fill)))

    def split(go: int) -> tuple[list[int], bool]:
        gone = []
        for k in times:
            gone.append(min(k, go))
            go -= gone[-1]
        return gone, sum(x * g for x, g in zip(loads, gone, strict=True)) <= sum(g * (k - d) for g, k, d in zip(gaps, times, gone, strict=True))

    low, high = 0, wanted
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if split(mid)[1] else (low, mid - 1)
    return [(p, k - d, d) for (p, k), d in zip(patterns, split(low)[0], strict=True)]


@dataclass
class Plan:
    """Where the rests of each class go, by rank."""

    sizes: np.ndarray
    #: By class: rows (first rank, first sequence, rests of the class in a sequence, slot of the first one, place in the stream of those that are cut or -1), by rank.
    steps: dict[int, np.ndarray]
    #: Gaps that the stream fills, in its order: (place in the stream, gap, first sequence, slot).
    gaps: np.ndarray
    sequences: int

    def places(self, size_class: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and slot, or else the place in the stream, of each rank."""
        rows = self.steps[size_class]
        hit = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
        nth, cut = rank - hit[:, 0], hit[:, 4] >= 0
        each = np.maximum(hit[:, 2], 1)
        stream = np.where(cut, hit[:, 4] + nth * int(self.sizes[size_class]), -1)
        return np.where(cut, -1, hit[:, 1] + nth // each), hit[:, 3] + nth % each, stream

    def cuts(self, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """Parts (from, length, sequence, slot) of a rest at this place in the stream."""
        done = 0
        while done < length:
            first, gap, sequence, slot = self.gaps[np.searchsorted(self.gaps[:, 0], at + done, "right") - 1].tolist()
            nth, inside = divmod(at + done - first, gap)
            n = min(length - done, gap - inside)
            yield done, n, sequence + nth, slot + inside
            done += n


def plan(histogram: dict[int, int], config: PackingConfig) -> Plan:
    """histogram: how many rests there are of each length."""
    room = config.capacity
    counted = np.zeros(room + 1, np.int64)
    for length, n in histogram.items():
        counted[length] = n
    full, counted[room] = int(counted[room]), 0
    sizes = classes_of(counted, config.classes)
    counts = np.diff(np.concatenate(([0], np.cumsum(counted)[sizes])))
    rows: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    at, gaps, base, stream = Counter(), [], full, 0
    rows[len(sizes)] = [(0, 0, 1, 0, -1)] if full else []
    found = dissolved(patterns_of(sizes, counts, config), sizes, config)
    for pattern, stay, _ in found:
        slot = 0
        for c, m in sorted(pattern.items(), reverse=True):
            if stay:
                rows[c].append((at[c], base, m, slot, -1))
                at[c] += m * stay
            slot += m
        gap = room - sum(int(sizes[c]) * m for c, m in pattern.items())
        if stay and gap >= max(1, int(room * config.least_gap)):
            gaps.append((stream, gap, base, slot))
            stream += gap * stay
        base += stay
    stream = 0
    for pattern, _, gone in found:
        for c, m in sorted(pattern.items(), reverse=True):
            if gone:
                rows[c].append((at[c], -1, m, 0, stream))
                at[c] += m * gone
                stream += m * gone * int(sizes[c])
    steps = {c: np.array(r, np.int64).reshape(-1, 5) for c, r in rows.items() if r}
    return Plan(np.append(sizes, room), steps, np.array(gaps, np.int64).reshape(-1, 4), base)


def planned(histogram: DataFrame, config: PackingConfig) -> tuple[dict[int, int], Plan]:
    """histogram(length, n), a row for each length, and the plan for it, made in one task: Spark keeps its workers' linear algebra to one thread, and the driver stays free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for b in batches:
            counts.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        yield pa.record_batch([pa.array([pickle.dumps((dict(counts), plan(counts, config)))])], ["made"])

    found = histogram.select(F.col("length").cast("long").alias("length"), F.col("n").cast("long").alias("n")).coalesce(1).mapInArrow(run, "made binary").first()
    return pickle.loads(bytes(found["made"])) if found else ({}, plan({}, config))


def pack(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, config))
    histogram, made = planned(materialize(pieces.groupBy("length").agg(F.count("*").alias("n"))), config)
    size_class = {x: int(np.searchsorted(made.sizes, x)) for x in histogram}
    held = Counter()
    for x, n in histogram.items():
        held[size_class[x]] += n
    classes = spark.createDataFrame([(x, c, max(-(-held[c] // config.part), min(64, -(-held[c] // 100)))) for x, c in size_class.items()], "__length long, size_class int, parts int")
    pieces = pieces.join(F.broadcast(classes), F.expr("length = __length")).drop("__length")  # a row for each length
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "th"), F.col("parts")).cast("int")).drop("parts")
    counts = materialize(pieces.groupBy("size_class", "part").agg(F.count("*").alias("n")))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size_class").orderBy("part")) - F.col("n")).select(F.col("size_class").alias("__c"), F.col("part").alias("__p"), "before")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size_class", "part").orderBy("doc_id", "th", "start")))
    ranked = ranked.join(before, F.expr("size_class = __c and part = __p")).select("th", *PIECE, "size_class", (F.col("before") + F.col("rank") - 1).alias("rank"))
    sent = spark.sparkContext.broadcast(made)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ranks = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("size_class", "rank"))
            found = np.zeros((3, len(ranks)), np.int64)
            for c in np.unique(own).tolist():
                found[:, own == c] = sent.value.places(c, ranks[own == c])
            yield pa.record_batch([*(b.column(n) for n in ("th", *PIECE)), *map(pa.array, found)], ["th", *PIECE, "sequence_id", "slot", "stream"])

    kinds = ", ".join(f"{n} long" for n in ("th", *PIECE, "sequence_id", "slot", "stream"))
    placed = map_arrow(ranked, place, kinds)
    if any((r[:, 4] >= 0).any() for r in made.steps.values()):
        placed = materialize(placed)
        whole = placed.filter("sequence_id >= 0")
        placed = whole.select(*PIECE, "sequence_id", "slot").unionByName(cut_again(placed.filter("sequence_id < 0"), docs, sent, config))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(*PIECE, "sequence_id", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))


def cut_again(rests: DataFrame, docs: DataFrame, sent: Broadcast[Plan], config: PackingConfig) -> DataFrame:
    """Pieces of the rests(doc_id, th, start, length, doc_tokens, stream) that fill gaps, with sequence_id and slot; their texts are encoded once more."""
    rests = rests.select("doc_id", "th", "start", "length", "doc_tokens", "stream")
    keys = rests.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct()
    texts = with_key(docs).join(keys, F.expr("doc_id <=> __d and th = __t"), "left_semi").dropDuplicates(["doc_id", "th"])
    texts = materialize(texts.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = part_ids(config.tokenizer), np.array([config.end_id], "<u4")
        for b in batches:
            out = []
            for doc_id, start, length, tokens, stream, own in zip(*(b.column(i).to_pylist() for i in range(5)), known.encode(b.column(5)), strict=True):
                ids = np.concatenate((own, end))
                for skip, n, sequence, slot in sent.value.cuts(stream, length):
                    at = start + skip
                    out.append((doc_id, at, n, zlib.crc32(ids[at : at + n]), tokens, sequence, slot))
            yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], [*PIECE, "sequence_id", "slot"])

    joined = rests.join(texts, F.expr("doc_id <=> __d and th = __t")).select("doc_id", "start", "length", "doc_tokens", "stream", "text")
    return map_arrow(joined, run, ", ".join(f"{n} long" for n in (*PIECE, "sequence_id", "slot")))
