"""Near-duplicates by SimHash with bit-sliced comparison.

Fingerprints of 64 bits; two link when at most three bits differ. Equal fingerprints are one
class. Six blocks of bits, of which at least three agree in any linked pair, give twenty keys of
31 to 33 bits for each class; classes that share a key are compared. Comparison is bit-sliced:
blocks of 64 fingerprints are stored as 64 bit planes, one query meets a block by one exclusive-or
for each plane, carry-save counters hold all 64 distances at once, and a block is abandoned when
all of its distances exceed the radius. In a run of classes that is longer than a tile all meet the
one with the most rows first; those that aren't near it are cut into chunks by hash and compared with
all others chunk by chunk, so that no task holds the run. Of each run only a spanning set of links leaves the
task.

Edge cases: null text counts as empty; texts without a word have fingerprint zero and link like
any other; a bit set in just half the hashes is 0. Very long texts are hashed whole. Null doc_ids come
after all others. Repeated rows are one class. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import map_arrow, materialize, raw
from embedspace.llm.components import memberships_of

RADIUS = 3
SEED = 42
#: First bits of the six blocks, and the end.
BLOCKS = (0, 11, 22, 33, 44, 54, 64)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 3
    #: Classes in a chunk of a long run; a task compares two chunks at a time.
    tile: int = 1024


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of all shingles in order; fewer words than a shingle has are one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bits that are set in over half of the shingles' hashes; zero without a word."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_masks() -> list[int]:
    """Masks of the twenty keys: three blocks each."""
    block = [sum(1 << i for i in range(a, b)) for a, b in zip(BLOCKS, BLOCKS[1:], strict=False)]
    return [signed(sum(c)) for c in combinations(block, 3)]


def planes_of(fingerprints: np.ndarray) -> np.ndarray:
    """Vertical storage: row b of a block of 64 fingerprints holds their bits b, lane by lane."""
    n = -(-len(fingerprints) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fingerprints)] = fingerprints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # block, lane, bit
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0].copy()


def near_lanes(queries: np.ndarray, planes: np.ndarray, blocks: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For task t: the lanes of planes[blocks[t]] within the radius of queries[t], as bits. Radius 3 or less."""
    out = np.zeros(len(queries), np.uint64)
    live = np.arange(len(queries))
    c0, c1, dead = (np.zeros(len(queries), np.uint64) for _ in range(3))
    q, at = queries, blocks
    for b in range(64):
        differs = planes[at, b] ^ np.where((q >> np.uint64(b)) & np.uint64(1), FULL, np.uint64(0))
        carry = c0 & differs
        c0 = c0 ^ differs
        dead |= c1 & carry  # the count passes three
        c1 = c1 ^ carry
        if b % 8 == 7 and b < 63:
            stay = dead != FULL  # abandon blocks in which all have exceeded the radius
            if not stay.all():
                live, q, at, c0, c1, dead = live[stay], q[stay], at[stay], c0[stay], c1[stay], dead[stay]
    count = [~c1 & ~c0, ~c1 & c0, c1 & ~c0, c1 & c0]
    inside = np.zeros(len(live), np.uint64)
    for c in count[: radius + 1]:
        inside |= c
    out[live] = inside & ~dead
    return out


def spanning_links(fingerprints: np.ndarray, runs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Within each run (runs: first positions and the end) one link to a root for every class that is near another."""
    for a, b in long_and_short(runs):
        sizes = b - a
        # Blocks of 64 lanes do not cross runs, so that a task compares one member with one block of its own run.
        blocks_of = -(-sizes // 64)
        first = np.concatenate(([0], np.cumsum(blocks_of)))
        lanes = np.zeros(first[-1] * 64, np.uint64)
        filled = np.zeros(first[-1] * 64, bool)
        member = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)])
        run_of = np.repeat(np.arange(len(a)), sizes)
        place = first[run_of] * 64 + (member - a[run_of])
        lanes[place], filled[place] = fingerprints[member], True
        planes, full = planes_of(lanes), np.ascontiguousarray(np.packbits(filled.reshape(-1, 64), axis=1, bitorder="little")).view("<u8")[:, 0]
        reps = blocks_of[run_of]
        query = np.repeat(np.arange(len(member)), reps)
        block = np.arange(len(query)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[run_of], reps)
        hits = np.empty(len(query), np.uint64)
        for i in range(0, len(query), 1 << 15):
            part = slice(i, i + (1 << 15))
            hits[part] = near_lanes(fingerprints[member[query[part]]], planes, block[part]) & full[block[part]]
        own = np.uint64(1) << ((place[query] % 64).astype(np.uint64))
        other = np.where(block == place[query] // 64, hits & ~own, hits) != 0
        touched = np.unique(run_of[query[other]])
        begin = np.concatenate(([0], np.cumsum(sizes * blocks_of)))
        for r in touched.tolist():
            n, w = int(sizes[r]), int(blocks_of[r])
            rows = hits[begin[r] : begin[r + 1]].astype("<u8").tobytes()
            near = [int.from_bytes(rows[8 * w * i : 8 * w * (i + 1)], "little") for i in range(n)]
            left = (1 << n) - 1
            while left:
                root = (left & -left).bit_length() - 1
                left &= left - 1
                front = near[root] & left
                while front:
                    x = (front & -front).bit_length() - 1
                    left &= ~(1 << x)
                    front = (front | near[x]) & left
                    yield int(fingerprints[a[r] + x]), int(fingerprints[a[r] + root])


def long_and_short(runs: np.ndarray, lanes: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of two classes or more, in groups of bounded work."""
    a, b = runs[:-1], runs[1:]
    keep = b - a > 1
    a, b = a[keep], b[keep]
    work = np.cumsum((b - a) * -(-(b - a) // 64))
    cut, done = 0, 0
    while cut < len(a):
        end = max(cut + 1, int(np.searchsorted(work, done + lanes, "right")))
        yield a[cut:end], b[cut:end]
        done, cut = int(work[end - 1]), end


def link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (t, key, ta, tb, fp) to links (a, b). The last run of a batch waits for the next one."""
    names = ("t", "key", "ta", "tb", "fp")
    held: list[np.ndarray] | None = None

    def links(cols: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        found = list(spanning_links(cols[4].view(np.uint64), starts))
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        change = np.zeros(len(cols[0]), bool)
        change[0] = True
        for c in cols[:4]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        held = [c[starts[-1] :] for c in cols]
        if len(starts) > 1:
            yield links([c[: starts[-1]] for c in cols], starts)
    if held is not None:
        yield links(held, np.array([0, len(held[0])]))


def fingerprints(docs: DataFrame, config: SimHashConfig) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([signed(fingerprint(x, config.shingle)) for x in raw(b.column(1))], pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def links(classes: DataFrame, config: SimHashConfig) -> DataFrame:
    """Links (a, b) between distinct fingerprints classes(fp, n) that connect all that are near each other.

    The classes of a run longer than a tile meet its hub first, the class with the most rows. What is near the hub is
    connected through it, so only the others are dealt into chunks, each of which meets all chunks of the run.
    """
    keyed = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(key_masks()))))
    keys = classes.select("fp", "n", keyed.alias("k")).select("k.t", "k.key", "fp", "n")
    runs = keys.groupBy("t", "key").agg(F.count("*").alias("size"), F.max_by("fp", F.struct("n", "fp")).alias("hub")).filter(F.col("size") > config.tile)
    runs = materialize(runs.select(F.col("t").alias("lt"), F.col("key").alias("lk"), "hub", F.ceil(F.col("size") / config.tile).cast("int").alias("g")))
    on = F.expr("t = lt and key = lk")
    members = materialize(keys.select("t", "key", "fp").join(runs, on).select("t", "key", "fp", "hub", "g", (F.bit_count(F.expr("fp ^ hub")) <= RADIUS).alias("near")))
    stars = members.filter("near and fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    far = members.filter("not near")
    chunks = materialize(far.groupBy(F.col("t").alias("lt"), F.col("key").alias("lk")).agg(F.ceil(F.count("*") / config.tile).cast("int").alias("h")))
    spread = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = far.join(chunks, on).select("t", "key", spread("h", 1).alias("ta"), every("g").alias("tb"), "fp")
    lanes = members.join(chunks, on).select("t", "key", every("h").alias("ta"), spread("g", 2).alias("tb"), "fp")
    short = keys.join(runs.select("lt", "lk"), on, "left_anti").select("t", "key", F.lit(0).alias("ta"), F.lit(0).alias("tb"), "fp")
    ordered = short.unionByName(queries).unionByName(lanes).repartition("t", "key", "ta", "tb").sortWithinPartitions("t", "key", "ta", "tb")
    return map_arrow(ordered, link_runs, "a long, b long").filter("a <> b").unionByName(stars).distinct()


def memberships(docs: DataFrame, config: SimHashConfig | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each document; component_id is the least doc_id that can be reached."""
    config = config or SimHashConfig()
    rows = materialize(fingerprints(docs, config))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    return memberships_of(rows, classes, links(classes, config), "fp")


def near_duplicates(docs: DataFrame, config: SimHashConfig | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return memberships(docs, config).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
