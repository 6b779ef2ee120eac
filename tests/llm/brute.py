"""Plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """Rows (doc_id, text[, lang, source]); extra: with columns whose names the operators use themselves."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s0")), len(r[1] or "")) for r in rows]
    if not extra:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([(*r, 1, "x", 2, 3, [1]) for r in full], SCHEMA + ", n_words long, kept string, th long, fp long, places array<int>")


LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
SENTENCE = " ".join(f"Word{i}" for i in range(70))
MESSY = [
    (1, "Hello  world\nagain"), (2, "Hello world\nagain"), (3, None, None, None), (4, ""), (5, " \t\n "), (5, " \t\n "), (6, SENTENCE), (7, "intro " + SENTENCE + " outro"), (8, SENTENCE), (8, SENTENCE),
    (9, LONG), (10, LONG + " tail"), (None, SENTENCE), (11, "a b c"), (12, "A B C"), (13, "naïve café – déjà vu 日本語 🙂"), (13, "another text with the same id"), (14, "x " * 60), (15, "common line\nown text one"), (16, "common line\nown text two"),
]


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    w, t = words(text), text or ""
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def fingerprint(text: str | None, k: int = 3) -> int:
    w = words(lower(text or ""))
    if not w:
        return 0
    k = min(k, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows: list[tuple]) -> list[tuple]:
    fps = [fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], f"{f:016x}", least.get(find(i))) for i, (r, f) in enumerate(zip(rows, fps, strict=True))]


def substring(rows: list[tuple]) -> list[tuple]:
    first: dict[tuple, int] = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 49):
            if r[0] is not None:
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = {i + j for i in range(len(w) - 49) if r[0] is not None and first[tuple(w[i : i + 50])] < r[0] for j in range(50)}
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def lines(rows: list[tuple], min_sites: int) -> list[tuple]:
    """rows: (doc_id, text, lang, source)."""
    sites, first = defaultdict(set), {}
    for d, t, _, s in rows:
        for x in (t or "").split("\n"):
            if words(x):
                sites[x].add(s)
                first[x] = min((y for y in (first.get(x), d) if y is not None), default=None)
    out = []
    for d, t, _, _ in rows:
        ls = t.split("\n") if t is not None else []
        kept = [x for x in ls if not words(x) or len(sites[x]) < min_sites or first[x] == d]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def same(got: DataFrame, columns: list[str], expected: list[tuple]) -> None:
    order = lambda rows: sorted(map(str, rows))
    assert order(tuple(r) for r in got.select(*columns).collect()) == order(expected)


def shingles(text: str | None, k: int = 5) -> set[str]:
    w = words(lower(text or ""))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a: str | None, b: str | None) -> float:
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def by_similarity(rows: list[tuple], least: float = 0.8, roots: bool = False) -> list[tuple]:
    """Least doc_id of each row's component by brute force (or its number); equal sets of shingles are one class."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= least * len(a | sets[j]):
                parent[find(i)] = find(j)
    if roots:
        return [find(i) for i in range(len(rows))]
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    least_of = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(r[0], least_of[find(i)]) for i, r in enumerate(rows)]
