"""The pipeline against brute force on a small table."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import by_similarity, documents, lines, quality, substring, words

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from embedspace.llm.quality_rules import QualityConfig  # noqa: E402


def make(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(n // 4)) for _ in range(4))
    passage = " ".join(word() for _ in range(70))
    rows = [(i, text(rng.randint(60, 160)), "en", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(150)]
    rows = [(i, t + ("\nshared footer line" if i % 2 else "") + (f"\nlead{i} {passage} end{i}" if i % 10 == 0 else ""), lang, s) for i, t, lang, s in rows]
    rows += [(200 + k, rows[5][1], "en", f"s{k % 11}") for k in range(40)]  # copies
    rows += [(300 + k, rows[6][1] + f" more{k}", "en", "hot") for k in range(10)]  # near copies
    rows += [(400, None, "en", None), (401, "short", None, "s1"), (402, "### " * 30 + rows[0][1], "en", "s1"), (403, "junk " * 100, "en", "s2"), (404, "", "en", "s2")]
    return rows


def quintiles(values):
    """Buckets' floors, in 64ths, of the 1/5, 1/2 and 4/5 quantiles."""
    low = lambda b: b if b < 128 else (b - (b // 64 - 1) * 64) << (b // 64 - 1)
    bucket = lambda v: v if v < 64 else max(v.bit_length() - 7, 0) * 64 + (v >> max(v.bit_length() - 7, 0))
    ranked = sorted(low(bucket(v)) * 64 for v in values)
    return [ranked[-(-len(ranked) * a // b) - 1] for a, b in ((1, 5), (1, 2), (4, 5))]


def brute_quality(rows, config):
    measured = {}
    for r in rows:
        n, chars, symbols, dups, repeats, failed = quality(r[1])
        marks, shouts = sum(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in r[1] or ""), sum(c == "!" or "A" <= c <= "Z" for c in r[1] or "")
        per = lambda a, k, b: a * k // max(b, 1)
        measured[r[0]] = failed, {"word_length": per(chars, 100, n), "marks": per(marks, 1000, chars), "shouting": per(shouts, 1000, chars)}
    kept = []
    good = [x for x in rows if not measured[x[0]][0]]
    for r in rows:
        failed, m = measured[r[0]]
        odd = False
        for name, lower in config.metrics.items():
            at = None
            for group in (good, [x for x in good if x[2] == r[2]], [x for x in good if x[2:] == r[2:]]):
                if group:
                    own = quintiles([measured[x[0]][1][name] for x in group])
                    at = own if at is None else [(len(group) * x + config.weight * y) // (len(group) + config.weight) for x, y in zip(own, at, strict=True)]
            if at is not None:
                step = 64 + at[1] // 64
                odd |= m[name] * 64 > at[1] + config.reach * max(at[2] - at[1], step) or lower and m[name] * 64 < at[1] - config.reach * max(at[1] - at[0], step)
        if not failed and not odd:
            kept.append(r)
    return kept


def test_pipeline(spark, tmp_path):
    rows = make(random.Random(4))
    documents(spark, rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    expected = brute_quality(rows, QualityConfig())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns
        if name == "lines":
            seen = lines(expected, 6)
            sites, first = defaultdict(set), {}
            for d, t, _, s in expected:
                for x in t.split("\n"):
                    if words(x):
                        sites[x].add(s)
                        first[x] = min(first.get(x, d), d)
            expected = [(d, "\n".join(x for x in t.split("\n") if not words(x) or len(sites[x]) < 6 or first[x] == d), lang, s) for d, t, lang, s in expected]
            assert sum(x[2] for x in seen) > 0
        elif name == "near_duplicates":
            members = by_similarity(expected)
            expected = [r for r, m in zip(expected, members, strict=True) if m[1] == r[0]]
        elif name == "passages":
            digests = {r[0]: r[2:] for r in substring(expected)}
            got = {r[0]: r for r in substring([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])}
            assert {d: h for d, (_, h) in digests.items()} == {d: g[3] for d, g in got.items()} and any(n for n, _ in digests.values())
            expected = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name != "passages":
            assert {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} == {r[0]: r[1] for r in expected}
            assert docs.filter("n_chars <> length(text)").count() == 0
    assert len(expected) < len(rows) - 40
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.packing_config().tokenizer)
    pieces = Counter()
    for d, t in expected:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        pieces.update((d, s, zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole) == pieces


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
