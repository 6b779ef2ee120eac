"""Removal of repeated passages.

A window is 50 consecutive words of a document. A word goes when a window that covers it also
starts in a document with a smaller doc_id. Windows are told apart by Rabin-Karp hashes of every
position (polynomials over 64-bit word hashes, modulo 2^64, mixed at the end), of two factors: 64 bits of
one and 32 of the other.

To shuffle few of them, equal documents are one class first, and then windows are anchored: a
window's anchor is the least of the Rabin-Karp hashes of its ten-word parts. Equal windows have
equal anchors, and neighbouring windows mostly share theirs, so a document has one anchor for each
twenty or so words. Only windows whose anchor occurs in several documents can repeat; the hashes
of all of those are counted in Spark. Nothing is lost by this: it skips only windows that are
certain to be in one document alone. Repeated windows merge into maximal removal intervals.

Two distinct windows are taken for each other with a chance of one in 2^96: among 10^13 of them, of one
in a thousand that it happens at all.

Edge cases: null text counts as empty. A document with a null doc_id neither loses words nor makes
others lose any. Rows that share a doc_id do not make each other lose words. Repeated rows are
treated alike. Very long texts are hashed whole, with some tens of bytes a word in memory. An empty table gives an empty result. Other columns are ignored or passed on,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import map_arrow, materialize, raw, replace_texts, text_key

WINDOW = 50
ANCHOR = 10
#: Odd factors of the two hashes.
FACTOR, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
NOTHING = hashlib.sha256(b"").digest()
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class WordHashes(dict):
    """Hashes of words, remembered with a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=np.uint64)


def rolling(hashes: np.ndarray, length: int, factor: int = FACTOR) -> np.ndarray:
    """Rabin-Karp hash of every `length` values in a row: sums of h[i + j] * factor^j."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(factor, n), out=sums[1:])
    out = (sums[length:] - sums[:-length]) * powers(pow(factor, -1, 1 << 64), n - length + 1)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def anchors_of(hashes: np.ndarray) -> np.ndarray:
    """The anchor of every window."""
    return least_of(rolling(hashes, ANCHOR), WINDOW - ANCHOR + 1) if len(hashes) >= WINDOW else np.empty(0, np.uint64)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) to (doc_id, th, n_words, digest of the words, anchors)."""
    known = WordHashes()
    for b in batches:
        counts, digests, anchors = [], [], []
        for text in raw(b.column("text")):
            words = text.split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).digest())
            anchors.append(signed(np.unique(anchors_of(known.of(words)))) if len(words) >= WINDOW else np.empty(0, np.int64))
        yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists(anchors, pa.int64())], ["doc_id", "th", "n_words", "digest", "anchors"])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, anchors) to (doc_id, th, place, h, g) of the windows with one of these anchors; h and g are two hashes."""
    known = WordHashes()
    for b in batches:
        for doc_id, th, text, anchors in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), raw(b.column("text")), b.column("anchors"), strict=True):
            hashes = known.of(text.split())
            places = np.flatnonzero(np.isin(signed(anchors_of(hashes)), anchors.values.to_numpy(zero_copy_only=False)))
            n = len(places)
            yield pa.record_batch([pa.array(np.full(n, doc_id, np.int64)), pa.array(np.full(n, th, np.int64)), pa.array(places.astype(np.int32)), pa.array(signed(rolling(hashes, WINDOW))[places]), pa.array((rolling(hashes, WINDOW, SECOND)[places] >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["doc_id", "th", "place", "h", "g"])


def intervals(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal half-open intervals of words that windows starting at these sorted places cover."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > WINDOW)
    return list(zip(places[np.concatenate(([0], cut + 1))].tolist(), (places[np.concatenate((cut, [len(places) - 1]))] + WINDOW).tolist(), strict=True))


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, places) to (doc_id, th, gone, sha, new_text): what is left, word by word and as text."""
    for b in batches:
        gone, shas, texts = [], [], []
        for text, places in zip(raw(b.column("text")), b.column("places"), strict=True):
            spans = [m.span() for m in WORD.finditer(text)]
            found = intervals(places.values.to_numpy(zero_copy_only=False))
            gone.append(sum(y - x for x, y in found))
            edges = [0, *(e for pair in found for e in pair), len(spans)]
            kept = [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if x < y]
            shas.append(hashlib.sha256(b" ".join(text[s:e] for x, y in kept for s, e in spans[x:y])).digest())
            texts.append(b" ".join(text[spans[x][0] : spans[y - 1][1]] for x, y in kept).decode())
        yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(gone, pa.int64()), pa.array(shas, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "th", "gone", "sha", "new_text"])


def analyse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, th, n_words, digest, copied) and, for each (doc_id, th) that loses words and isn't copied whole, (doc_id, th, gone, sha, new_text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), "text")
    rows = materialize(map_arrow(own, survey, "doc_id long, th long, n_words long, digest binary, anchors array<long>"))
    firsts = materialize(rows.filter(F.col("n_words") >= WINDOW).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("__d"), "first_id"))
    rows = rows.join(firsts, rows["digest"] == firsts["__d"], "left").withColumn("copied", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("__d", "first_id")
    rows = materialize(rows)
    single = rows.filter("not copied and doc_id is not null and size(anchors) > 0").select("doc_id", "th", F.explode("anchors").alias("anchor"))
    shared = materialize(single.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select(F.col("anchor").alias("__a")))
    suspects = materialize(single.join(shared, single["anchor"] == shared["__a"]).groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("anchors")))
    suspects = suspects.select(F.col("doc_id").alias("__i"), F.col("th").alias("__t"), "anchors")
    texts = materialize(own.join(suspects, F.expr("doc_id = __i and th = __t")).select("doc_id", "th", "text", "anchors"))
    found = materialize(map_arrow(texts, windows, "doc_id long, th long, place int, h long, g int"))
    repeated = materialize(found.groupBy("h", "g").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").select(F.col("h").alias("__h"), F.col("g").alias("__g"), "first_id"))
    places = found.join(repeated, F.expr("h = __h and g = __g")).filter("doc_id > first_id").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("place")).alias("places"))
    places = places.select(F.col("doc_id").alias("__i"), F.col("th").alias("__t"), "places")
    lost = texts.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"]).join(places, F.expr("doc_id = __i and th = __t")).select("doc_id", "th", "text", "places")
    return rows.drop("anchors"), map_arrow(lost, cut_out, "doc_id long, th long, gone long, sha binary, new_text string")


def substring_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows, lost = analyse(docs)
    lost = lost.select(F.col("doc_id").alias("__i"), F.col("th").alias("__t"), "gone", "sha")
    out = rows.join(lost, F.expr("doc_id = __i and th = __t"), "left")
    removed = F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long")))
    sha = F.when(F.col("copied"), F.lit(NOTHING)).otherwise(F.coalesce("sha", "digest"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.lower(F.hex(sha)).alias("kept_sha256"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, with all their columns; what is kept of a text keeps its spaces within."""
    rows, lost = analyse(docs)
    whole = rows.filter("copied").select("doc_id", "th", F.lit("").alias("new_text")).distinct()
    return replace_texts(docs, whole.unionByName(lost.select("doc_id", "th", "new_text")))


ORACLE = r"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
win as (select rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) s from (select *, unnest(range(1, len(w) - 48)) i from d)),
low as (select s, min(doc_id) first_id from win group by s),
gone as (select distinct rid, unnest(range(i, i + 50)) p from win join low using (s) where doc_id > first_id),
g as (select rid, list(p) ps from gone group by rid)
select doc_id, len(w)::bigint n_words, coalesce(len(ps), 0)::bigint n_removed,
    sha256(case when ps is null then array_to_string(w, ' ') else array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(ps, i)), lambda i: w[i]), ' ') end) kept_sha256
from d left join g using (rid)"""
