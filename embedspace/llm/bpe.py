"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the encoder stores the last token of that prefix's encoding. It
is unique: a token t that ends the prefix is the right one exactly when t and the last token of
what comes before it form a valid pair, one that BPE itself would leave apart. So appending bytes
only adds entries, and an edit only redoes entries until the old ones hold again.

Text is cut by a pattern first and each match is encoded separately, as by the tiktoken library; a
match that is a token by itself stays whole. Matches are remembered, with a bound.

Edge cases: null text counts as empty and has no tokens. Special tokens do not exist: their
strings are ordinary text. Very long texts are encoded whole; a long match has a table of its own, one
entry a byte. Of equal ranks the leftmost pair merges first, as in the library. Repeated rows are encoded alike. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import map_arrow

#: Longer matches get a table of their own, as recursion over their prefixes would be deep.
SHORT = 64


class Vocabulary:
    """Ranks of byte strings, and for each token the pair it was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Tokens that merges make; others can only be whole matches.
        self.usable = {b: r for b, r in ranks.items() if len(b) == 1 or self.split(r) is not None}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, piece: bytes, below: int | None = None) -> list[int]:
        """Plain BPE, least rank first and leftmost, with ranks under `below` only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks, top = self.ranks, 1 << 60 if below is None else below
        while len(parts) > 1:
            best, at = top, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], top)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a byte, or for a token that merges never make."""
        if token not in self.halves:
            made = self.merged(self.bytes[token], below=token)
            self.halves[token] = (made[0], made[1]) if len(made) == 2 else None
        return self.halves[token]

    def valid_pair(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two; undoes merges at the seam from the latest on."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        """At every stage of the merges the tokens beside the seam must not merge before the next merge on either side happens.

        A stage lasts until rank `limit`; of equal ranks the leftmost merge happens first, so the seam loses
        a tie with the left side and wins one with the right side.
        """
        limit, wins_tie = 1 << 60, False
        while True:
            joint = self.ranks.get(self.bytes[left] + self.bytes[right])
            if joint is not None and (joint < limit or joint == limit and wins_tie):
                return False
            l, r = self.split(left), self.split(right)
            if l is None and r is None:
                return True
            # The later merge is undone first: the greater rank, on ties the right one.
            if r is None or l is not None and left > right:
                limit, wins_tie, left = left, False, l[1]
            else:
                limit, wins_tie, right = right, True, r[0]


class PrefixEncoding:
    """The encoding of a growing and editable byte string: last[i] is the last token of data[:i + 1]."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _entry(self, data: bytes, last: list[int], end: int) -> int:
        """The one usable token that ends data[:end] and forms a valid pair with the last token before it."""
        v = self.vocabulary
        find, pairs = v.usable.get, v.pairs
        for start in range(max(0, end - v.longest), end):
            t = find(data[start:end])
            if t is not None:
                if not start:
                    return t
                ok = pairs.get((last[start - 1], t))
                if v.valid_pair(last[start - 1], t) if ok is None else ok:
                    return t
        raise ValueError("a byte is missing from the vocabulary")

    def append(self, more: bytes) -> None:
        data, last, entry = self.data + more, self.last, self._entry
        for end in range(len(self.data) + 1, len(data) + 1):
            last.append(entry(data, last, end))
        self.data = data

    def replace(self, start: int, end: int, new: bytes) -> int:
        """data[start:end] = new. Returns how many entries were computed.

        Old entries hold again after as many equal ones in a row as the longest token has bytes.
        """
        data, shift = self.data[:start] + new + self.data[end:], len(new) - (end - start)
        last, equal, done = self.last[:start], 0, 0
        for at in range(start, len(data)):
            if equal >= self.vocabulary.longest:
                last += self.last[at - shift :]
                break
            last.append(self._entry(data, last, at + 1))
            done += 1
            equal = equal + 1 if at >= start + len(new) and last[-1] == self.last[at - shift] else 0
        self.data, self.last = data, last
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class StandIns(dict):
    """For str.translate: code points that Python's tables do not know yet become one of the kind that the tiktoken library takes them for.

    The two libraries' tables differ there: what is a letter to one may be none to the other.
    """

    #: A letter, a number and a symbol that no alternative of a pattern names.
    KINDS = ((r"\p{L}", "\u03b2"), (r"\p{N}", "\u0663"))
    OTHER = "\u00a4"

    def __init__(self) -> None:
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        self.probes = [(tiktoken.Encoding(f"probe {p}", pat_str=p, mergeable_ranks=single, special_tokens={}), c) for p, c in self.KINDS]
        unknown = (chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn")
        self.suspect = re.compile("[" + "".join(map(re.escape, unknown)) + "\U00010000-\U0010ffff]").search

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c) == "Cn":
            c = next((stand for probe, stand in self.probes if probe.encode_ordinary(c)), self.OTHER)
        self[code] = c
        return c


class Encoder:
    """Encodes whole texts, match by match of the pattern."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, memory: int = 600_000):
        self.vocabulary, self.cut, self.memory, self.stand_ins = vocabulary, regex.compile(pattern).findall, memory, StandIns()
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.lasts: dict[bytes, int] = {}

    def find(self, text: str) -> list[str]:
        """The pattern's matches, which must leave out no character."""
        if text.isascii() or not self.stand_ins.suspect(text):
            return self.cut(text)
        out, at = [], 0
        for m in self.cut(text.translate(self.stand_ins)):
            out.append(text[at : at + len(m)])
            at += len(m)
        return out

    def last_token(self, data: bytes) -> int:
        """The same entry as in PrefixEncoding, kept by prefix, as matches share many prefixes; only those are filled in that are asked for."""
        t = self.lasts.get(data)
        if t is None:
            v, n = self.vocabulary, len(data)
            find, pairs = v.usable.get, v.pairs
            for start in range(max(0, n - v.longest), n):
                t = find(data[start:])
                if t is not None:
                    if not start:
                        break
                    pair = self.last_token(data[:start]), t
                    ok = pairs.get(pair)
                    if v.valid_pair(*pair) if ok is None else ok:
                        break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            self.lasts[data] = t
        return t

    def piece(self, data: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > SHORT:
            return PrefixEncoding(self.vocabulary, data).tokens()
        if len(self.lasts) >= self.memory:
            self.lasts.clear()
        out = []
        while data:
            out.append(t := self.last_token(data))
            data = data[: -len(self.vocabulary.bytes[t])]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        return [t for m in self.find(text) for t in self.piece(m.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))

    def remember(self, match: str) -> tuple[int, bytes, bytes]:
        """Of one match: how many ids, the ids in decimal, and what they decode to."""
        if len(self.known) >= self.memory:
            self.known.clear()
        ids = self.piece(match.encode())
        out = self.known[match] = len(ids), ",".join(map(str, ids)).encode(), self.decode(ids)
        return out

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the bytes they decode to."""
        known, remember = self.known.get, self.remember
        found = [known(m) or remember(m) for m in self.find(text)]
        ids, back = hashlib.sha256(b",".join([x[1] for x in found])), hashlib.sha256(b"".join([x[2] for x in found]))
        return sum(x[0] for x in found), ids.hexdigest(), back.hexdigest()


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(Vocabulary.load(path), pattern)


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([e.encode(x or "") for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            found = [e.digests(x or "") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), *(pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
