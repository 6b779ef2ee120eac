"""URL rules by cascades of Bloom filters.

A rule `host/path` fits its host and all subdomains where the url's path starts with the rule's;
the longest rule wins. For each action one cascade answers exactly whether a key, a host and the
start of a path, is listed: level 1 encodes the listed keys, level 2 those unlisted keys of the
corpus that level 1 lets through, level 3 the listed keys that level 2 lets through, and so on
until no key errs. The keys of the corpus (its key universe) are enumerated in Spark, where a join
marks those that are listed; only unlisted ones that pass all levels so far are looked at again. So
nothing but a cascade is ever sent out, and urls are judged without a join.

A cascade's size depends on the list and only with the logarithm on the corpus. A list is dealt over
several cascades by hash, so that each stays below `max_bytes`, which is checked on every cascade
before it is sent out, while it is built too; each is applied by itself. What the driver encodes for a
level is the listed keys of a shard, or the unlisted ones that pass: the first level's rate makes
these no more than about the listed ones.

Edge cases: a null url, or one without ://, has an empty host and path and no rule. Of
fitting rules of one length that with the longer host wins; a rule listed for both actions blocks.
Repeated rows are judged alike. Very long urls have no more keys than others, as no rule is longer
than the longest. An empty table gives an empty result. Other columns are passed on; one whose name is
host, path, rule or verdict is passed on as host_in and so on, with as many _in as it takes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import ascii_lower, materialize

Rule = tuple[str, str]


@dataclass
class Bloom:
    bits: np.ndarray
    size: int
    hashes: int
    seed: int

    @classmethod
    def sized(cls, keys: int, rate: float, seed: int) -> Bloom:
        size = max(64, math.ceil(-keys * math.log(rate) / math.log(2) ** 2))
        return cls(np.zeros(size // 8 + 1, np.uint8), size, max(1, round(-math.log2(rate))), seed)

    def places(self, key: bytes) -> list[int]:
        h = xxhash.xxh128_intdigest(key, self.seed)
        a, b = h >> 64, (h & (1 << 64) - 1) | 1
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def add(self, key: bytes) -> None:
        for p in self.places(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key))


@dataclass
class Cascade:
    """Exact for the listed keys and for the keys of the corpus it was made from."""

    levels: list[Bloom] = field(default_factory=list)

    def passed(self, key: bytes) -> int:
        """Levels in a row, from the first, that hold the key."""
        for i, level in enumerate(self.levels):
            if key not in level:
                return i
        return len(self.levels)

    def __contains__(self, key: bytes) -> bool:
        """Odd levels encode listed keys: a key that stops short at an even level is listed."""
        return self.passed(key) % 2 == 1

    def nbytes(self) -> int:
        return sum(x.bits.nbytes for x in self.levels)


def build_cascade(listed: list[str], universe: DataFrame, spark_keys: int, max_bytes: int = 64 << 20, max_levels: int = 64) -> Cascade:
    """universe: distinct column `key`, spark_keys of them. listed: in order, without repeats."""
    spark = universe.sparkSession
    keys = [k.encode() for k in listed]
    out = Cascade()
    if not keys:
        return out
    rate = min(0.5, max(1e-9, len(keys) * math.sqrt(0.5) / max(1, spark_keys)))
    own = spark.createDataFrame([(k,) for k in listed], "__listed string")
    wrong_in, wrong_out = keys, universe.join(own, universe["key"] == own["__listed"], "left_anti")
    while len(out.levels) < max_levels:
        encode = wrong_in if len(out.levels) % 2 == 0 else [r["key"].encode() for r in wrong_out.toLocalIterator()]
        if not encode:
            break
        level = Bloom.sized(len(encode), rate if not out.levels else 0.5, len(out.levels))
        for k in encode:
            level.add(k)
        out.levels.append(level)
        if out.nbytes() > max_bytes:
            raise ValueError(f"a cascade takes {out.nbytes()} bytes; lower max_bytes or list fewer rules in a shard")
        if len(out.levels) % 2:  # unlisted keys that pass are encoded next; their number is about that of the listed ones
            sent = spark.sparkContext.broadcast(out)

            def through(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                cascade = sent.value
                for b in batches:
                    found = [k for k in b.column(0).to_pylist() if cascade.passed(k.encode()) == len(cascade.levels)]
                    yield pa.record_batch([pa.array(found, pa.string())], ["key"])

            wrong_out = materialize(wrong_out.mapInArrow(through, "key string"))
        else:
            wrong_in = [k for k in wrong_in if k in level]
    else:
        raise ValueError("a cascade did not end; keys and listed keys disagree on encoding")
    return out


OUTPUTS = ("host", "path", "rule", "verdict")


def kept_apart(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """df with columns that are named like an output renamed, and what `column` is called then."""
    names, taken = {}, {*df.columns, *OUTPUTS}
    for c in df.columns:
        if c.lower() in OUTPUTS:
            new = c + "_in"
            while new in taken:
                new += "_in"
            names[c] = new
            taken.add(new)
    return df.withColumnsRenamed(names), names.get(column, column)


def split_url(df: DataFrame, column: str) -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.instr(F.col(f"`{column}`"), "://") > 0, F.expr(f"substring(`{column}`, instr(`{column}`, '://') + 3)")).otherwise(F.lit(""))
    df = df.withColumn("__rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("host", ascii_lower(F.regexp_extract("__rest", "(?s)^[^/?#]*", 0)))
    return df.withColumn("path", F.regexp_extract("__rest", "(?s)^[^/?#]*([^?#]*)", 1)).drop("__rest")


def parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    if not host:
        raise ValueError(f"a rule needs a host: {rule!r}")
    return host.lower(), slash + path


class UrlRules:
    """Rules as (action, rule), with action allow or block; `default` is the verdict where none fits."""

    def __init__(self, rules: list[tuple[str, str]], default: str = "allow", max_bytes: int = 64 << 20):
        self.rules, self.default, self.max_bytes = list(dict.fromkeys(rules)), default, max_bytes
        if bad := {a for a, _ in rules} - {"allow", "block"}:
            raise ValueError(f"unknown actions {sorted(bad)}")
        split = [parts(r) for _, r in self.rules]
        self.paths = sorted({len(p) for _, p in split})
        self.dots = max((h.count(".") for h, _ in split), default=-1)
        self.host_bytes = max((len(h) for h, _ in split), default=0)

    def candidates(self, host: str, path: str) -> list[str]:
        """All keys that could be a rule for this url, longest first. No rule has more labels or letters than those tried."""
        labels, out = host.rsplit(".", self.dots + 1) if self.dots >= 0 else [], []
        for i in range(len(labels)):
            if i == 0 and len(labels) > self.dots + 1:
                continue
            suffix = ".".join(labels[i:])
            if suffix and len(suffix) <= self.host_bytes:
                out += [suffix + path[:n] for n in self.paths if n <= len(path)]
        return sorted(set(out), key=lambda k: (-len(k), k.find("/") < 0 and -len(k) or -k.find("/")))

    def shards(self) -> int:
        return max(1, math.ceil(len(self.rules) * 16 / self.max_bytes))  # a key takes at most about 60 bits; shards differ a little

    def fit(self, urls: DataFrame) -> list[dict[str, Cascade]]:
        """One cascade an action for each shard of the rules, exact for urls(host, path)."""
        enumerate_keys = self.candidates

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = {k for h, p in zip(*(c.to_pylist() for c in b.columns), strict=True) for k in enumerate_keys(h, p)}
                yield pa.record_batch([pa.array(sorted(found), pa.string())], ["key"])

        universe = materialize(urls.select("host", "path").distinct().mapInArrow(keys, "key string").distinct())
        n, out = universe.count(), []
        for s in range(self.shards()):
            mine = [(a, "".join(parts(r))) for a, r in self.rules if xxhash.xxh64_intdigest("".join(parts(r)), 1) % self.shards() == s]
            out.append({a: build_cascade(list(dict.fromkeys(k for b, k in mine if a == b)), universe, n, self.max_bytes) for a in ("block", "allow")})
        return out

    def judge(self, urls: DataFrame, column: str = "url") -> DataFrame:
        """urls with host, path, rule and verdict."""
        whole = split_url(*kept_apart(urls, column))
        shards = self.fit(whole)
        enumerate_keys, default = self.candidates, self.default
        for s, cascades in enumerate(shards):
            sent = whole.sparkSession.sparkContext.broadcast(cascades)
            count = len(shards)

            def find(batches: Iterator[pa.RecordBatch], sent=sent, s=s, count=count) -> Iterator[pa.RecordBatch]:
                cascades = sent.value
                memo: dict[tuple[str, str], tuple[str | None, str | None]] = {}
                for b in batches:
                    found = []
                    for h, p, had, verdict in zip(*(b.column(n).to_pylist() for n in ("host", "path", "rule", "verdict")), strict=True):
                        if (h, p) not in memo:
                            if len(memo) > 50_000:
                                memo.clear()
                            memo[h, p] = next(((k, a) for k in enumerate_keys(h, p) for a in ("block", "allow") if (e := k.encode()) in cascades[a] and xxhash.xxh64_intdigest(e, 1) % count == s), (None, None))
                        k, a = memo[h, p]
                        better = k is not None and (had is None or len(k) > len(had))
                        found.append((k, a) if better else (had, verdict))
                    b = b.set_column(b.schema.get_field_index("rule"), "rule", pa.array([x[0] for x in found], pa.string()))
                    yield b.set_column(b.schema.get_field_index("verdict"), "verdict", pa.array([x[1] for x in found], pa.string()))

            if s == 0:
                whole = whole.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
            whole = whole.mapInArrow(find, whole.schema)
        return whole.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: The rules that the query applies.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

ORACLE = r"""
with r(action, rhost, rpath) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
x as (select row_number() over () rid, page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
u as (select rid, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') path from x),
m as (select rid, arg_max(rhost || rpath, length(rhost || rpath)) rule, arg_max(action, length(rhost || rpath)) action from u join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by rid)
select page_id, host, path, rule, coalesce(action, 'allow') verdict from u left join m using (rid)"""
