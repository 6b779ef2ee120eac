"""Near-duplicates at a Jaccard similarity of 0.8 on five-word shingles, by wide SimHash fingerprints.

Three differing bits of 64 mean a similarity far above 0.8, so this form of the operator keeps
1,024 bits of each set of shingles. A pair of similarity s differs in arccos(2s / (1 + s)) / pi of
them on average; the radius adds five standard deviations, so that it only saves work: what is within
it links if the Jaccard similarity of the sets of shingles, counted exactly, is 0.8 or more. Small sets
have wider radii, from exact binomials, as their majorities differ more often. Candidates share one of
32 keys, each made of five least hashes under random orders (a pair of 0.8 misses all of them with a
chance of 0.000003).

Distances are bit-sliced: 64 fingerprints are stored as bit planes and carry-save counters, which
start so that the count that passes the radius overflows, hold 64 distances at once; blocks whose
distances have all overflowed are abandoned. The classes of a key are compared with its hub (the
least class) first; only those that are not similar to it are compared with all others, in tiles of
bounded size. As whatever is similar to the hub is connected through it, no link between components
is lost, and large groups of copies take linear work. Of what lies within the radius a tile only
gives out which classes hang together, never all pairs. Those that hang together but aren't all linked
are one group: its classes meet once more, in tiles that hold their sets of shingles, where a pair that
isn't connected yet is counted exactly and only links that connect leave the task.

Edge cases: words are cut as elsewhere and A-Z lower-cased. Null text counts as empty; texts
without a word are one class. Texts of fewer than five words have one shingle, the whole. Very
long texts are sketched whole, 255 shingles at a time. Null doc_ids come after all others; ties
among equal doc_ids go to the least key of the text. Repeated rows are one class. An empty table
gives an empty result. Other columns are passed on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import map_arrow, materialize, raw, text_key
from embedspace.llm.components import components, memberships_of
from embedspace.llm.simhash import FULL, SEED, shingle_hashes, signed

#: Planes that meet the counters together, and the counters' levels below their carry.
STEP, LEVELS = 16, 4
#: Comparisons, and blocks of 64 lanes, that are worked on at a time.
ROWS, BLOCKS = 1 << 12, 1 << 11


@dataclass(frozen=True)
class WideConfig:
    similarity: float = 0.8
    shingle: int = 5
    #: Bits of a fingerprint, a multiple of 64.
    bits: int = 1024
    #: Standard deviations beyond the mean distance at the threshold.
    slack: float = 5.0
    bands: int = 32
    band_rows: int = 5
    #: Classes in a chunk of a long run.
    tile: int = 1024
    #: Classes in a chunk of a group, whose sets of shingles are at hand.
    group: int = 256
    #: Comparisons of a run up to which they are packed into blocks together with those of other runs.
    small: int = 1 << 12

    def reach(self, share: float) -> int:
        """Differing bits that hardly any pair exceeds whose bits differ with a chance of share."""
        return int(self.bits * share + self.slack * math.sqrt(self.bits * share * (1 - share)))

    @property
    def radius(self) -> int:
        return self.reach(math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi)


@lru_cache(maxsize=8)
def radii(config: WideConfig, sizes: int = 128) -> np.ndarray:
    """Radius by the size of a pair's smaller set; the last one is for all from `sizes` on. None is below a later one."""
    chance = [np.array([math.comb(k, j) / 2**k for j in range(k + 1)]) for k in range(2 * sizes)]

    def over(k: int, size: int, common: int) -> np.ndarray:
        """Chance that more than half of size bits are set, by how many of the common ones are, k being its other ones."""
        tail = np.append(np.cumsum(chance[k][::-1])[::-1], 0)
        return tail[np.clip(size // 2 + 1 - np.arange(common + 1), 0, k + 1)]

    out = np.full(sizes + 1, config.radius)
    for n in range(1, sizes):
        for x in range(n):
            i = n - x
            most = int(i / config.similarity + 1e-9) - n  # shingles that only the larger set may have
            for y in range(max(x, most - 1), most + 1):
                a, b = over(x, n, i), over(y, i + y, i)
                out[n] = max(out[n], config.reach(float((chance[i] * (a * (1 - b) + b * (1 - a))).sum())))
    return np.maximum.accumulate(out[::-1])[::-1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers, so that each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, salt: int) -> np.ndarray:
    """n numbers that depend on the salt."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: bytes, config: WideConfig) -> tuple[int, np.ndarray]:
    """Class and sorted hashes of a text's set of shingles."""
    hashes = np.unique(shingle_hashes(text, config.shingle))
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)), hashes


def sketch(text: bytes, config: WideConfig) -> tuple[int, bytes, list[int], int]:
    """Class, fingerprint, keys and size of a text's set of shingles."""
    cls, hashes = shingle_set(text, config)
    words = stream(config.bits // 64, 1)
    orders = stream(config.bands * config.band_rows, 2) | np.uint64(1)
    ones = np.zeros(config.bits, np.int64)
    least = np.full(len(orders), FULL)
    for i in range(0, len(hashes), 255):  # so that bytes can hold the counts
        part = hashes[i : i + 255, None]
        ones += np.unpackbits(mixed(part + words).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        np.minimum(least, (part * orders).min(axis=0), out=least)
    digest = xxhash.xxh64_intdigest
    bands = least.reshape(config.bands, -1)
    keys = [signed(digest(bands[b].tobytes(), b)) for b in range(config.bands)] if len(hashes) else []
    return cls, np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), keys, len(hashes)


def sketches(docs: DataFrame, config: WideConfig) -> DataFrame:
    """(doc_id, th, cls, fp, keys, reach) of each document; th is the key of its text, reach the radius for its size."""
    reach = radii(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(*s, int(reach[min(n, len(reach) - 1)])) for *s, n in (sketch(x, config) for x in raw(b.column(2)))]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32()))]
            yield pa.record_batch([b.column(0), b.column(1), *columns], ["doc_id", "th", "cls", "fp", "keys", "reach"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), "text"), run, "doc_id long, th long, cls long, fp binary, keys array<long>, reach int")


def shingle_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, config: WideConfig) -> DataFrame:
    """(__c, hashes): the sets of shingles of the wanted(__c) classes, built again from the texts, as few are wanted."""
    texts_of = materialize(classes.join(wanted, F.expr("cls = __c")).select(F.col("th").alias("__th")).distinct())

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(x, config) for x in raw(b.column(0))]
            yield pa.record_batch([pa.array([c for c, _ in found], pa.int64()), pa.array([h.tobytes() for _, h in found], pa.binary())], ["cls", "hashes"])

    texts = docs.select("text", text_key(F.col("text")).alias("th")).join(texts_of, F.expr("th = __th"), "left_semi").select("text")
    return materialize(map_arrow(texts, sets_of, "cls long, hashes binary").groupBy(F.col("cls").alias("__c")).agg(F.first("hashes").alias("hashes")))


def is_similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common)


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, config: WideConfig) -> DataFrame:
    """Those of pairs(a, b) of classes whose sets of shingles have the similarity, counted exactly."""
    sets = shingle_sets(pairs.select(F.col("a").alias("__c")).unionByName(pairs.select(F.col("b").alias("__c"))).distinct(), classes, docs, config)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [is_similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), config.similarity) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    x, y = sets.withColumnRenamed("hashes", "x"), sets.select(F.col("__c").alias("__d"), F.col("hashes").alias("y"))
    joined = pairs.join(x, F.expr("a = __c")).select("a", "b", "x").join(y, F.expr("b = __d")).select("a", "b", "x", "y")
    return materialize(map_arrow(joined, count, "a long, b long"))


def planes_of(fingerprints: np.ndarray) -> np.ndarray:
    """Vertical storage of (64 n, words): row b holds the bits b of n blocks, lane by lane."""
    blocks, words = len(fingerprints) // 64, fingerprints.shape[1]
    out = np.empty((words * 64, blocks), np.uint64)
    for i in range(0, blocks, 64):
        part = fingerprints[64 * i : 64 * (i + 64)].reshape(-1, 64, words).copy()
        for j in (32, 16, 8, 4, 2, 1):  # transposes 64 by 64 bits, by swapping ever smaller quarters
            low = np.uint64(sum(((1 << j) - 1) << k for k in range(0, 64, 2 * j)))
            halves = part.reshape(-1, 32 // j, 2, j, words)
            top, bottom = halves[:, :, 0], halves[:, :, 1]
            swap = ((top >> np.uint64(j)) ^ bottom) & low
            bottom ^= swap
            top ^= swap << np.uint64(j)
        out[:, i : i + 64] = part.transpose(2, 1, 0).reshape(words * 64, -1)
    return out


def within(plane: Callable[[int, np.ndarray], np.ndarray], n: int, bits: int, radius: int | np.ndarray) -> np.ndarray:
    """Lanes whose count of set bits is at most the radius, which may differ from lane to lane.

    plane(b, live): bit b of the differences of the live ones of n blocks.
    """
    least = int(np.min(radius))
    width = max(int(np.max(radius)).bit_length(), LEVELS + 1)
    start = (1 << width) - 1 - np.broadcast_to(radius, (n, 64))  # so that radius + 1 overflows
    out, live = np.zeros(n, np.uint64), np.arange(n)
    state = [np.packbits(start >> k & 1, axis=1, bitorder="little").view("<u8")[:, 0].copy() for k in range(width)]
    dead = np.zeros(n, np.uint64)
    for b in range(0, bits, STEP):
        items = [plane(b + i, live) for i in range(STEP)]
        for k in range(LEVELS):
            carries = []
            for x, y in zip(items[::2], items[1::2], strict=True):
                half = state[k] ^ x
                carries.append((state[k] & x) | (half & y))
                state[k] = half ^ y
            items = carries
        carry = items[0]
        for k in range(LEVELS, width):
            state[k], carry = state[k] ^ carry, state[k] & carry
        dead |= carry
        if b + STEP > least:
            stay = dead != FULL  # abandon blocks in which all have exceeded the radius
            if not stay.all():
                live, dead, state = live[stay], dead[stay], [s[stay] for s in state]
            if not len(live):
                break
    out[live] = ~dead
    return out


def padded(fingerprints: np.ndarray) -> np.ndarray:
    out = np.zeros((-(-len(fingerprints) // 64) * 64, fingerprints.shape[1]), np.uint64)
    out[: len(fingerprints)] = fingerprints
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int | np.ndarray) -> np.ndarray:
    """For each row whether a and b are within its radius; 64 rows make a block."""
    if not len(a):
        return np.zeros(0, bool)
    found, reach = [], np.broadcast_to(radius, len(a))
    reach = np.pad(reach, (0, -len(a) % 64), mode="edge").reshape(-1, 64)
    for i in range(0, len(a), 64 * BLOCKS):
        planes = planes_of(padded(a[i : i + 64 * BLOCKS] ^ b[i : i + 64 * BLOCKS]))
        found.append(within(lambda p, live, planes=planes: planes[p][live], planes.shape[1], len(planes), reach[i // 64 : i // 64 + BLOCKS]))
    lanes = np.concatenate(found).astype("<u8").view(np.uint8)
    return np.unpackbits(lanes, bitorder="little")[: len(a)].astype(bool)


def matrix(column: pa.Array, config: WideConfig) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, config.bits // 64)


def tile_links(queries: np.ndarray, q_class: np.ndarray, lanes: np.ndarray, l_class: np.ndarray, radius: int | tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
    """All pairs of a query and a lane within the radius of it; of radii of queries and lanes the greater one counts."""
    planes, blocks = planes_of(padded(lanes)), -(-len(lanes) // 64)
    query, block = np.repeat(np.arange(len(queries)), blocks), np.tile(np.arange(blocks), len(queries))
    hits = np.empty(len(query), np.uint64)
    q_reach, l_reach = radius if isinstance(radius, tuple) else (np.full(len(queries), radius), np.full(len(lanes), radius))
    l_reach = np.pad(l_reach, (0, -len(lanes) % 64), mode="edge").reshape(-1, 64)
    for i in range(0, len(query), ROWS):
        q, at = queries[query[i : i + ROWS]], block[i : i + ROWS]

        def differs(p: int, live: np.ndarray, q: np.ndarray = q, at: np.ndarray = at) -> np.ndarray:
            bit = (q[live, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
            return planes[p][at[live]] ^ (np.uint64(0) - bit)

        hits[i : i + ROWS] = within(differs, len(at), len(planes), np.maximum(q_reach[query[i : i + ROWS], None], l_reach[at]))
    bits = np.unpackbits(hits.astype("<u8").view(np.uint8), bitorder="little").reshape(len(queries), 64 * blocks)
    q, x = np.nonzero(bits[:, : len(lanes)])
    yield from zip(q_class[q].tolist(), l_class[x].tolist(), strict=True)


def hanging_together(pairs: np.ndarray) -> np.ndarray:
    """Rows (a, b) for pairs (a, b): each number with the least one that it hangs together with."""
    if not len(pairs):
        return np.zeros((0, 2), np.int64)
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.column_stack((nodes[moved], nodes[label[moved]]))


def runs_of(batches: Iterator[pa.RecordBatch], keys: int, read: Callable[[pa.RecordBatch], list]) -> Iterator[tuple[list, np.ndarray]]:
    """Sorted rows as columns, and where their runs of equal first `keys` columns start and end; a batch's last run waits for the next batch. Columns are arrays or lists."""
    held: list | None = None
    join = lambda x, y: x + y if isinstance(x, list) else np.concatenate((x, y))
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = read(batch)
        if held is not None:
            cols = [join(x, y) for x, y in zip(held, cols, strict=True)]
        change = np.ones(len(cols[0]), bool)
        change[1:] = False
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        held = [c[starts[-1] :] for c in cols]
        yield cols, starts
    if held is not None:
        yield held, np.array([0, len(held[0])])


def links(classes: DataFrame, docs: DataFrame, config: WideConfig) -> DataFrame:
    """Links (a, b) between classes(cls, th, fp, keys, reach) of docs that connect all that are similar to each other."""
    prints = classes.select(F.col("cls").alias("__c"), "fp", "reach")
    keys = classes.select("cls", F.explode("keys").alias("key"))
    runs = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("hub")).filter("n > 1"))
    shared = materialize(keys.join(runs.withColumnRenamed("key", "__k"), F.expr("key = __k")).select("key", "n", "cls", "hub"))

    def to_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = near_pairs(matrix(b.column(2), config), matrix(b.column(3), config), b.column(4).to_numpy()) if b.num_rows else []
            yield pa.record_batch([b.column(0), b.column(1), pa.array(near, pa.bool_())], ["cls", "hub", "near"])

    pairs = shared.filter("cls <> hub").select("cls", "hub").distinct().join(prints, F.expr("cls = __c")).select("cls", "hub", F.col("fp").alias("x"), F.col("reach").alias("xr"))
    pairs = pairs.join(prints, F.expr("hub = __c")).select("cls", "hub", "x", "fp", F.greatest("xr", "reach").alias("reach"))
    stars = materialize(map_arrow(pairs, to_hubs, "cls long, hub long, near boolean"))

    tested = stars.filter("near").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    linked = similar(tested, classes, docs, config)
    far = stars.join(linked, F.expr("cls = a and hub = b"), "left_anti").select(F.col("cls").alias("__c"), F.col("hub").alias("__h"))
    rest = materialize(shared.join(far, F.expr("cls = __c and hub = __h"), "left_semi").select("key", "n", "cls"))
    tiles = materialize(rest.groupBy(F.col("key").alias("__k")).agg(F.ceil(F.max("n") / config.tile).cast("int").alias("g"), F.ceil(F.count("*") / config.tile).cast("int").alias("h")))

    def placed(members: DataFrame, role: int) -> DataFrame:
        own, other = ("g", "h") if role == 0 else ("h", "g")
        met = materialize(members.select("key", "cls").join(tiles, F.expr("key = __k")).drop("__k"))
        each = met.join(prints, F.expr("cls = __c")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col(own)).cast("int"))
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        first, second = ("own", "other") if role == 0 else ("other", "own")
        return each.select("key", F.col(first).alias("c"), F.col(second).alias("d"), F.lit(role).alias("role"), "cls", "reach", "fp")

    def in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to pairs of classes that hang together."""

        def found(cols: list, starts: np.ndarray) -> pa.RecordBatch:
            role, cls, reach, prints = cols[3:]
            out, pairs, n = [np.zeros((0, 2), np.int64)], [], 0

            def compare(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
                q, x = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
                near = near_pairs(prints[q], prints[x], np.maximum(reach[q], reach[x]))
                out.append(hanging_together(np.column_stack((cls[q[near]], cls[x[near]]))))

            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                cut = a + int(np.searchsorted(role[a:z], 1))
                work = (z - cut) * (cut - a)
                if work > config.small:
                    out.append(hanging_together(np.array(list(tile_links(prints[cut:z], cls[cut:z], prints[a:cut], cls[a:cut], (reach[cut:z], reach[a:cut]))), np.int64).reshape(-1, 2)))
                elif work:
                    q, x = np.repeat(np.arange(cut, z), cut - a), np.tile(np.arange(a, cut), z - cut)
                    other = cls[q] != cls[x]
                    pairs.append((q[other], x[other]))
                    n += work
                    if n > 64 * ROWS:
                        compare(pairs)
                        pairs, n = [], 0
            if pairs:
                compare(pairs)
            ends = hanging_together(np.concatenate(out))
            return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        numbers = lambda b: [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)] + [matrix(b.column(6), config)]
        for cols, starts in runs_of(batches, 3, numbers):
            yield found(cols, starts)

    rows = placed(shared, 0).unionByName(placed(rest, 1))
    ordered = rows.repartition("key", "c", "d").sortWithinPartitions("key", "c", "d", "role")
    near = map_arrow(ordered, in_tiles, "a long, b long").filter("a <> b").unionByName(tested).distinct()
    return linked.unionByName(links_in_groups(materialize(near), linked, classes, docs, config))


def links_in_groups(near: DataFrame, linked: DataFrame, classes: DataFrame, docs: DataFrame, config: WideConfig) -> DataFrame:
    """Further links (a, b), exact ones, between classes that hang together by near(a, b) but aren't connected by linked(a, b).

    In a group, the classes of all its parts but the greatest one meet all of the group's, in tiles.
    """
    labels = components(linked).select(F.col("node").alias("__n"), F.col("label").alias("__l"))
    members = components(near).select(F.col("node").alias("cls"), F.col("label").alias("grp"))
    members = materialize(members.join(labels, F.expr("cls = __n"), "left").select("cls", "grp", F.coalesce("__l", "cls").alias("part")))
    parts = members.groupBy("grp", "part").agg(F.count("*").alias("n"))
    chunks = lambda n: F.ceil(n / config.group).cast("int")
    groups = parts.groupBy(F.col("grp").alias("__g")).agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
    groups = materialize(groups.select("__g", "main", chunks(F.col("all")).alias("g"), chunks(F.col("others")).alias("h")))
    members = materialize(members.join(groups, F.expr("grp = __g")).drop("__g"))
    sets = shingle_sets(members.select(F.col("cls").alias("__c")), classes, docs, config)
    prints = classes.select(F.col("cls").alias("__p"), "fp", "reach")
    held = materialize(members.join(sets, F.expr("cls = __c")).drop("__c").join(prints, F.expr("cls = __p")).drop("__p"))

    def placed(rows: DataFrame, role: int) -> DataFrame:
        own, other = ("g", "h") if role == 0 else ("h", "g")
        each = rows.withColumn("own", F.pmod(F.xxhash64("cls", F.lit(role)), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        first, second = ("own", "other") if role == 0 else ("other", "own")
        return each.select("grp", F.col(first).alias("c"), F.col(second).alias("d"), F.lit(role).alias("role"), "cls", "part", "reach", "fp", "hashes")

    def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to links that connect parts."""
        read = lambda b: [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)] + [matrix(b.column(7), config), [np.frombuffer(x, "<u8") for x in b.column(8).to_pylist()]]
        for cols, starts in runs_of(batches, 3, read):
            role, cls, part, reach, prints, sets = cols[3:]
            out = []
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                cut = a + int(np.searchsorted(role[a:z], 1))
                if cut in (a, z):
                    continue
                place = {c: i for i, c in reversed(list(enumerate(cls[a:z].tolist(), a)))}
                if (z - cut) * (cut - a) > config.small:
                    pairs = [(place[x], place[y]) for x, y in tile_links(prints[cut:z], cls[cut:z], prints[a:cut], cls[a:cut], (reach[cut:z], reach[a:cut]))]
                else:
                    q, x = np.repeat(np.arange(cut, z), cut - a), np.tile(np.arange(a, cut), z - cut)
                    near = near_pairs(prints[q], prints[x], np.maximum(reach[q], reach[x]))
                    pairs = list(zip(q[near].tolist(), x[near].tolist(), strict=True))
                root = {p: p for p in part[a:z].tolist()}

                def find(p: int, root: dict[int, int] = root) -> int:
                    while root[p] != p:
                        root[p] = p = root[root[p]]
                    return p

                for x, y in pairs:
                    p, q = find(int(part[x])), find(int(part[y]))
                    if p != q and is_similar(sets[x], sets[y], config.similarity):
                        root[p] = q
                        out.append((int(cls[x]), int(cls[y])))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

    rows = placed(held, 0).unionByName(placed(held.filter("part <> main"), 1))
    ordered = rows.repartition("grp", "c", "d").sortWithinPartitions("grp", "c", "d", "role")
    return materialize(map_arrow(ordered, in_groups, "a long, b long"))


def memberships(docs: DataFrame, config: WideConfig | None = None) -> DataFrame:
    """(doc_id, th, cls, component_id, root) of each document; component_id is the least doc_id that can be reached, root the component's key."""
    config = config or WideConfig()
    rows = materialize(sketches(docs, config))
    classes = materialize(rows.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min("th").alias("th"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("reach").alias("reach")))
    return memberships_of(rows.select("doc_id", "th", "cls"), classes.select("cls", "first_id"), links(classes, docs, config), "cls")


def keep_representatives(docs: DataFrame, config: WideConfig | None = None) -> DataFrame:
    """One row of each component, with all its columns: that with the least doc_id (nulls come last), of these that with the least key of its text.

    Rows that share a doc_id but not the text belong each to the component of its own text, so no
    component is left without a row. Which one of rows with equal doc_id and text stays is left open.
    """
    config = config or WideConfig()
    found = materialize(memberships(docs, config).select("doc_id", "th", "root"))
    rows = found.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "n")).alias("r"))
    stays = materialize(first.select(F.col("r.doc_id").alias("__es_id"), F.col("r.th").alias("__es_th"), F.col("r.n").alias("__es_n")))
    kept = docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(F.col("__es_id")) & (text_key(docs["text"]) == F.col("__es_th")))
    if not stays.filter("__es_n > 1").head(1):
        return kept.select(*docs.columns)
    kept = materialize(kept)
    return kept.filter("__es_n = 1").unionByName(kept.filter("__es_n > 1").dropDuplicates(["__es_id", "__es_th"])).select(*docs.columns)
