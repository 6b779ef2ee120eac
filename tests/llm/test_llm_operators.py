"""Each operator against brute force, on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import LONG, MESSY, SENTENCE, by_similarity, documents, fingerprint, lines, lower, quality, same, simhash, similarity, substring, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from embedspace.llm import bpe, exact_dedup, line_dedup, lm_scoring, packing, quality_rules, queries, simhash as sh, simhash_wide as sw, substring_dedup, toxicity, url_filter

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(params=[False, True], ids=["plain", "clashing"])
def messy(request, spark):
    return documents(spark, MESSY, request.param)


@pytest.fixture
def empty(spark):
    return documents(spark, [])


def test_quality_base(messy, empty):
    got = quality_rules.quality_verdicts(messy)
    same(got, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], [(r[0], *quality(r[1])) for r in MESSY])
    assert quality_rules.quality_verdicts(empty).count() == 0


def test_quality_keeps_clean_and_drops_outliers(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(80)), "en", "hot" if i % 3 else f"s{i % 50}") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in words(rows[i][1])), "en", "hot") for i in range(5)] + [(2000, "THE!! " * 3 + " ".join(w.upper() + "!!" for w in words(rows[0][1])), "en", "new")]
    docs = documents(spark, rows, extra=True)
    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(docs).filter("kept").select("doc_id").collect()}
    assert kept == set(range(400))
    stage = quality_rules.quality_filter(docs)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.select("doc_id").collect()} == kept


def test_quality_fences_follow_their_group(spark):
    """Three sources: shouting in one is usual and in another it isn't; a new source leans on its language."""
    rng = random.Random(3)
    text = lambda share: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))).upper() if rng.random() < share else "quiet" + str(rng.random())[2:6] for _ in range(60))
    rows = [(i, text(0.02), "en", "quiet") for i in range(400)] + [(1000 + i, text(rng.uniform(0.2, 0.8)), "en", "loud") for i in range(400)] + [(2000, text(0.6), "en", "quiet"), (2001, text(0.6), "en", "loud"), (2002, text(0.02), "de", "new")]
    docs, config = documents(spark, rows), quality_rules.QualityConfig()
    scored = quality_rules.materialize(quality_rules.score(docs, [F.col("doc_id")]))
    found = {(r["lang"], r["source"]): r["highs"] for r in quality_rules.fences(quality_rules.sketches(scored, list(config.metrics)), config).collect()}
    assert 2 * found["en", "quiet"]["shouting"] < found["en", "loud"]["shouting"] and found["en", "quiet"]["word_length"] != found["en", "loud"]["word_length"]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(docs).collect()}
    assert not kept[2000] and kept[2001] and kept[2002] and sum(kept[i] for i in range(400)) > 390


def test_sketch_buckets(spark):
    values = [*range(300), 1000, 4095, 4096, 10**6, 2**40]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket_floor(quality_rules.bucket(F.col("v"))).alias("low")).collect()
    assert all(r["low"] <= r["v"] <= r["low"] + r["low"] // 64 for r in rows)


def brute_urls(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = lower(rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(r), r, a) for a, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("".join(r.partition("/")[1:]))]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else default


def test_url_rules(spark):
    urls = [None, "", "no scheme.net/", "http://net", "http://net/", "http://A.Example.NET/en/x?y#z", "https://example.net/EN/", "http://x.org/fr/", "http://x.org/frx", "http://notnet/", "http://com.example.com/de/a", "http://example.com/de", "http://a.b.c.d.e.f.net/q", "http://" + "a." * 5000 + "net/", "x://y://z.net/", "http:///net/", "http://net./", "http://net/", "http://é.net/\n#"]
    rows = list(enumerate(urls))
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.UrlRules(url_filter.RULES).judge(df)
    same(got, ["page_id", "host", "path", "rule", "verdict"], [(i, *brute_urls(u, url_filter.RULES)) for i, u in rows])
    assert url_filter.UrlRules(url_filter.RULES).judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.UrlRules([]).judge(df).collect()} == {"allow"}
    clashing = df.withColumns({"rule": F.lit(1), "host": F.lit(2), "host_in": F.lit(3), "key": F.array(F.lit(4)), "bucket": F.lit("x")})
    kept = url_filter.UrlRules(url_filter.RULES).judge(clashing)
    same(kept, ["page_id", "host", "path", "rule", "verdict"], [(i, *brute_urls(u, url_filter.RULES)) for i, u in rows])
    assert {(r["rule_in"], r["host_in_in"], r["host_in"], r["key"][0], r["bucket"]) for r in kept.collect()} == {(1, 2, 3, 4, "x")}
    by_path = url_filter.UrlRules(url_filter.RULES).judge(df.withColumnRenamed("url", "path"), "path")
    same(by_path, ["page_id", "host", "path", "rule", "verdict"], [(i, *brute_urls(u, url_filter.RULES)) for i, u in rows])


def test_url_rules_in_shards(spark):
    rng = random.Random(2)
    rules = [(rng.choice(["allow", "block"]), f"h{i}.example{rng.choice(['', '/', '/a/', '/a/b'])}") for i in range(300)]
    rows = [(i, f"http://{rng.choice(['', 'www.'])}h{rng.randint(0, 600)}.example/{rng.choice(['', 'a/', 'a/bc', 'b'])}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    sharded = url_filter.UrlRules(rules, max_bytes=1600)
    assert sharded.shards() == 3
    with pytest.raises(ValueError, match="bytes"):
        url_filter.build_cascade([r for _, r in rules], df.select(F.col("url").alias("key")).distinct(), 3000, 64)
    for judge in (sharded, url_filter.UrlRules(rules)):
        same(judge.judge(df), ["page_id", "host", "path", "rule", "verdict"], [(i, *brute_urls(u, rules)) for i, u in rows])


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = [f"k{i}" for i in range(0, 20_000, 37)]
    cascade = url_filter.build_cascade(listed, universe, 20_000)
    assert {f"k{i}" for i in range(20_000) if f"k{i}".encode() in cascade} == set(listed)
    assert len(cascade.levels) > 1 and cascade.nbytes() * 8 < 20 * len(listed)


def brute_exact(rows):
    import re

    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(i)
    out = []
    for t, g in groups.items():
        stays = min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
        out += [(rows[i][0], rows[stays][0], len(g), i == stays, hashlib.sha256(t.encode()).hexdigest()) for i in g]
    return out


def test_exact_dedup(messy, empty):
    same(exact_dedup.deduplicate_once(messy), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], brute_exact(MESSY))
    assert exact_dedup.deduplicate_once(empty).count() == 0


@pytest.mark.parametrize("path", [False, True])
def test_exact_dedup_appends(spark, tmp_path, path):
    """Batches against what earlier ones brought; compaction, buckets and a later session's view of the files."""
    index = exact_dedup.DigestIndex(spark, "digests_test", 4, f"file://{tmp_path}/index" if path else None)
    try:
        first = exact_dedup.deduplicate(documents(spark, [(5, "a"), (6, "b")]), index).collect()
        again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(documents(spark, [(1, "a"), (2, "c"), (3, "c")]), index).collect()}
        assert all(r["kept"] for r in first) and again == {1: (5, False), 2: (2, True), 3: (2, False)}
        assert index.read().count() == 3 and "SortMergeJoin" in index.fresh(index.read().limit(1))._jdf.queryExecution().toString()
        index.compact()
        assert index.version() == 2 and index.buckets == 8 and sorted(r["keep_id"] for r in index.read().collect()) == [2, 5, 6]
        for i in range(12):
            index.append(index.fresh(spark.range(i * 50, i * 50 + 50).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("keep_id"))))
        assert index.version() > 2 and index.read().count() == 603 and len(index.read().inputFiles()) <= 64
        if path:
            spark.sql(f"drop table {index.table()}")
            assert not index.exists()
            index.open()
            assert index.read().count() == 603 and [r["kept"] for r in exact_dedup.deduplicate(documents(spark, [(9, "a")]), index).collect()] == [False]
    finally:
        index.drop()


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_exact_dedup_in_batches(spark, batches):
    """The batches' bounds change nothing; groups reach over several of them."""
    rng = random.Random(batches)
    rows = [(rng.randrange(60), f"text {rng.randrange(25)}") for _ in range(150)] + [(None, "text 1"), (None, "own"), (7, None)]
    index = exact_dedup.DigestIndex(spark, "digests_batches", 4)
    try:
        same(exact_dedup.deduplicate_table(documents(spark, rows), index, batches), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], brute_exact(rows))
        assert index.read().count() == len({r[1] for r in rows})
    finally:
        index.drop()


CONFIG = packing.PackingConfig(tokenizers.path("word_bpe_49k.json"))


TOKENIZER = Tokenizer.from_file(CONFIG.tokenizer)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check_packed(rows, docs, full=None):
    """Each id lies in exactly one piece, with its checksum; sequences are gapless and within the capacity."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = defaultdict(list)
    for d, text, *_ in docs:
        expected[d].append(ids_of(text))
    assert set(pieces) == set(expected)
    for d, texts in expected.items():
        assert sum(p[1] for p in pieces[d]) == sum(map(len, texts))
        left = Counter(pieces[d])
        for ids in texts:
            at = 0
            while at < len(ids):
                fit = next(p for p in left if p[0] == at and p[3] == len(ids) and left[p] and p[2] == zlib.crc32(np.array(ids[at : at + p[1]], "<u4").tobytes()))
                left[fit] -= 1
                at += fit[1]
        assert not sum(left.values())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(sequences) == list(range(len(sequences)))
    if full:
        assert sum(r["length"] for r in rows) / (4096 * len(sequences)) >= full


def test_packing(messy, empty):
    check_packed(packing.pack(messy, CONFIG).collect(), MESSY)
    assert packing.pack(empty, CONFIG).count() == 0


def test_packing_cuts_rests_of_one_awkward_length(spark):
    """Texts of 700 tokens leave 596 places in every sequence; small salted parts; repeated rows among those that are cut."""
    docs = [(i, " ".join(["w"] * 698) + f" {i % 10}") for i in range(400)] + [(7, " ".join(["w"] * 698) + " 7"), (None, " ".join(["w"] * 698) + " 7")] * 2
    config = packing.PackingConfig(CONFIG.tokenizer, part=50)
    check_packed(packing.pack(documents(spark, docs, extra=True), config).collect(), docs, 0.98)  # 70 sequences, and 69 could not hold them


def shapes():
    rng = np.random.default_rng(0)
    lognormal = np.minimum(4096, rng.lognormal(6.3, 1, 100_000).astype(int) + 1)
    return {
        "uniform": rng.integers(1, 4097, 500_000), "lognormal": lognormal, "exponential": np.minimum(4096, rng.exponential(1000, 100_000).astype(int) + 1), "one": np.full(100_000, 700),
        "third": np.where(rng.random(100_000) < 0.33, 700, lognormal), "halves": rng.integers(1400, 2600, 100_000), "few": rng.integers(1, 4097, 2000), "billions": np.repeat(lognormal, 1),
    }


@pytest.mark.parametrize("shape", shapes())
def test_plan_holds_the_histogram_with_little_padding(spark, shape):
    lengths = shapes()[shape]
    scale = 100_000 if shape == "billions" else 1
    histogram = {k: n * scale for k, n in Counter(lengths.tolist()).items()}
    made = packing.planned(spark.createDataFrame(list(histogram.items()), "length long, n long"), CONFIG)[1]
    tokens = sum(k * n for k, n in histogram.items())
    assert tokens / (4096 * made.sequences) >= 0.99
    sizes = packing.classes_of(np.bincount(lengths[lengths < 4096], minlength=4097), CONFIG.classes)
    counts = np.bincount(np.searchsorted(sizes, lengths[lengths < 4096]), minlength=len(sizes)) * scale
    assert made.sequences <= histogram.get(4096, 0) + sum(k for _, k in packing.best_fit(sizes, counts, 4096))
    if scale > 1 or len(lengths) > 100_000:
        return
    loads, stream = np.zeros(made.sequences, np.int64), []
    own = np.searchsorted(made.sizes, lengths)
    for c in np.unique(own).tolist():
        mine = lengths[own == c]
        sequence, _, place = made.places(c, np.arange(len(mine)))
        np.add.at(loads, sequence[sequence >= 0], mine[sequence >= 0])
        stream += zip(place[sequence < 0].tolist(), mine[sequence < 0].tolist(), strict=True)
    for p, length in stream:
        parts = list(made.cuts(p, length))
        assert [x[0] for x in parts] == np.cumsum([0, *(x[1] for x in parts[:-1])]).tolist() and sum(x[1] for x in parts) == length
        for _, n, sequence, _ in parts:
            loads[sequence] += n
    assert loads.max() <= 4096 and loads.min() > 0 and loads.sum() == tokens


def test_column_generation_reaches_the_optimum():
    """Small programs, held against all ways to fill a sequence."""
    rng = np.random.default_rng(1)
    for _ in range(10):
        sizes = np.sort(rng.choice(np.arange(20, 90), 6, replace=False))
        counts = rng.integers(1, 10_000, 6)
        found = packing.column_generation(sizes, counts, 100, [p for p, _ in packing.best_fit(sizes, counts, 100)], 0.0)
        prices = np.linalg.solve(np.array([[p.get(i, 0) for i in range(6)] for p, _ in found], float), np.ones(6))

        def most(i, room):
            return 0.0 if i == 6 else max(k * prices[i] + most(i + 1, room - k * sizes[i]) for k in range(room // sizes[i] + 1))

        assert most(0, 100) <= 1 + 1e-6 or sum(t for _, t in found) - prices @ counts / most(0, 100) < 0.5
        assert all(sum(p.get(i, 0) * t for p, t in found) >= counts[i] - 1e-6 for i in range(6))


def test_another_tokenizer_is_encoded_whole():
    known = packing.part_ids(tokenizers.path("byte_bpe_50k.json"))
    import pyarrow as pa

    assert not known.known_cut and next(known.encode(pa.array(["Two  Words"]))).tolist() == known.whole("Two  Words").tolist()


ODD_CHARS = "aAbéÉßöΣσİ1½9.,!?' \u00a0\u2003\u200b\x1c\x85\x00\t\n日本ﬁ🙂<|endoftext|>_-"


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(ODD_CHARS) | st.characters(codec="utf-8"), max_size=30))
def test_tokenizer_parts(text):
    import pyarrow as pa

    known = packing.part_ids(CONFIG.tokenizer)
    assert next(known.encode(pa.array([text]))).tolist() == known.whole(text).tolist()


def test_simhash(messy, empty):
    same(sh.near_duplicates(messy), ["doc_id", "fingerprint", "component_id"], simhash(MESSY))
    assert sh.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [1024, 8])
def test_simhash_finds_every_link(spark, tile):
    """Chains of fingerprints three bits apart and a dense group, in small tiles too."""
    rng = np.random.default_rng(3)
    fps, chain = [], int(rng.integers(0, 2**63))
    for _ in range(40):
        fps.append(chain)
        for b in rng.choice(64, 3, replace=False):
            chain ^= 1 << int(b)
    centre = int(rng.integers(0, 2**63))
    fps += [centre ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for _ in range(150)] + [int(x) for x in rng.integers(0, 2**63, 200)]
    fps = sorted(set(fps))
    classes = spark.createDataFrame([(sh.signed(f), 1 + (f == centre)) for f in fps], "fp long, n long")
    from embedspace.llm.components import components

    got = {r["node"]: r["label"] for r in components(sh.links(classes, sh.SimHashConfig(tile=tile))).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for f in fps:
        groups[find(f)].add(sh.signed(f))
    found = defaultdict(set)
    for f in fps:
        found[got.get(sh.signed(f), sh.signed(f))].add(sh.signed(f))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def edited(rng, text, rate):
    return " ".join(f"new{rng.randrange(10**9)}" if rng.random() < rate else w for w in text.split())


def test_wide_simhash_representatives(messy, empty):
    kept = sw.keep_representatives(messy)
    assert kept.columns == messy.columns
    check_representatives(kept, MESSY)
    assert sw.keep_representatives(empty).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_wide_simhash_distances(n):
    """Bit-sliced distances against counted ones, around the radius."""
    rng = np.random.default_rng(n)
    a = rng.integers(0, 2**63, (n, 16)).astype(np.uint64)
    b = a.copy()
    for i in range(n):
        for x in rng.choice(1024, int(rng.integers(170, 186)), replace=False):
            b[i, x // 64] ^= np.uint64(1) << np.uint64(x % 64)
    distance = np.bitwise_count(a ^ b).sum(axis=1)
    radius = sw.WideConfig().radius
    assert sw.near_pairs(a, b, radius).tolist() == (distance <= radius).tolist()
    links = set(sw.tile_links(a[:20], np.arange(20), b, np.arange(1000, 1000 + n), radius))
    all_near = {(i, 1000 + j) for i in range(min(20, n)) for j in range(n) if int(np.bitwise_count(a[i] ^ b[j]).sum()) <= radius}
    assert links <= all_near and {i for i, _ in links} == {i for i, _ in all_near} and {j for _, j in links} == {j for _, j in all_near}


@pytest.mark.parametrize(("tile", "small"), [(1024, 1 << 12), (4, 1 << 12), (8, 2)])
def test_wide_simhash_finds_near_copies(spark, tile, small):
    """Copies from 0.83 are found, chains and a large group too; texts below 0.6 stay apart; small tiles change nothing."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(80, 300))) for _ in range(40)]
    chain = [" ".join(word() for _ in range(300))]
    for _ in range(6):
        chain.append(edited(rng, chain[-1], 0.012))
    rows = [*texts, *chain, *(edited(rng, texts[0], 0.01) for _ in range(60)), *(edited(rng, t, rng.choice([0.005, 0.015, 0.2])) for t in texts[1:])]
    rows = [r for k, r in enumerate(rows) if all(not 0.6 < similarity(r, x) < 0.83 for x in rows[:k])]
    rows += rows[:5]
    docs = documents(spark, [(i, t) for i, t in enumerate(rows)])
    got = {r["doc_id"]: r["component_id"] for r in sw.memberships(docs, sw.WideConfig(tile=tile, small=small)).collect()}
    assert got == dict(by_similarity([(i, t) for i, t in enumerate(rows)])) and len(set(got.values())) < len(rows) - 5


@pytest.mark.parametrize(("tile", "small"), [(1024, 1 << 12), (4, 2)])
def test_wide_simhash_holds_the_similarity(spark, tile, small):
    """Pairs a little below 0.8 stay apart and those at or above it link, also by chains."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(204)]
        rows.append(" ".join(base))
        for swapped in (3, 4, 5, 6, 8):  # each swapped word changes five shingles of 200: 0.86, 0.82, 0.78, 0.74, 0.67
            at = set(range(10, 10 + 20 * swapped, 20))
            rows.append(" ".join(word() + "z" if i in at else w for i, w in enumerate(base)))
    near = [similarity(rows[i], rows[i + k]) for i in range(0, len(rows), 6) for k in range(1, 6)]
    assert sum(0.65 < s < 0.8 for s in near) == 75 and sum(s >= 0.8 for s in near) == 50
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["component_id"] for r in sw.memberships(documents(spark, rows), sw.WideConfig(tile=tile, small=small)).collect()}
    assert got == dict(by_similarity(rows))


@pytest.mark.parametrize(("tile", "small"), [(1024, 1 << 12), (4, 2)])
def test_wide_simhash_links_short_texts(spark, tile, small):
    """Texts that are the start of another of few shingles, at 0.8 or a little more; and pairs below it."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(4, 9)))
    rows = []
    for short, long in [(4, 5), (6, 7), (12, 15), (20, 25), (9, 12), (40, 50)] * 60:
        base = [word() for _ in range(long + 4)]
        rows += [" ".join(base), " ".join(base[: short + 4])]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["component_id"] for r in sw.memberships(documents(spark, rows), sw.WideConfig(tile=tile, small=small)).collect()}
    assert got == {i: i if i % 12 == 9 else i - i % 2 for i, _ in rows}


def brute_representatives(rows):
    """Of each component the row with the least doc_id, nulls last; ties are left open, so only how many rows of (doc_id, text) stay at most."""
    members = by_similarity(rows, roots=True)
    groups = defaultdict(list)
    for r, root in zip(rows, members, strict=True):
        groups[root].append(r)
    return [{(r[0], r[1]) for r in g if r[0] == min((x[0] for x in g if x[0] is not None), default=None)} for g in groups.values()]


def check_representatives(kept, rows):
    """One row of each component and no other; by rows, not by ids."""
    wanted, got = brute_representatives(rows), [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    assert len(got) == len(wanted) and all(sum(r in w for r in got) >= 1 for w in wanted) and all(any(r in w for w in wanted) for r in got)


def test_wide_simhash_repeated_ids(spark):
    """Rows that share a doc_id but not the text, some of them copies of others: no text without a near copy is lost."""
    other, third = " ".join(f"own{i}" for i in range(40)), " ".join(f"third{i}" for i in range(40))
    rows = [(1, SENTENCE), (2, SENTENCE + " more"), (2, other), (3, other), (2, third), (2, third), (4, "x y z"), (4, "one two three"), (None, SENTENCE), (None, "alone without an id"), (None, "alone without an id"), (None, None), (None, "second alone")]
    kept = sw.keep_representatives(documents(spark, rows, extra=True))
    check_representatives(kept, rows)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(1, SENTENCE), (2, other), (2, third), (4, "x y z"), (4, "one two three"), (None, "alone without an id"), (None, None), (None, "second alone")]))


@pytest.mark.parametrize("group", [256, 8])
def test_wide_simhash_gives_no_pairs_of_a_group(spark, group, monkeypatch):
    """Many copies with edits of their own, similar to few others: all hang together, links are exact and no more than connect."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    base = " ".join(word() for _ in range(200))
    rows = [(i, edited(rng, base, rng.choice([0.01, 0.02, 0.03]))) for i in range(150)] + [(500 + i, " ".join(word() for _ in range(60))) for i in range(10)]
    docs, config = documents(spark, rows), sw.WideConfig(tile=32, small=64, group=group)
    seen = []
    inner = sw.links_in_groups
    monkeypatch.setattr(sw, "links_in_groups", lambda near, *rest: seen.append((near.count(), (out := inner(near, *rest)).count())) or out)
    got = {r["doc_id"]: r["component_id"] for r in sw.memberships(docs, config).collect()}
    assert got == dict(by_similarity(rows)) and 1 < len(set(got.values())) < 160
    assert seen[0][0] < 3000 and seen[0][1] < 3000  # of 11175 pairs


def test_hanging_together():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 400, (250, 2))
    found = dict(sw.hanging_together(pairs).tolist())
    label = {int(x): int(x) for x in pairs.reshape(-1)}
    for _ in range(400):
        for a, b in pairs.tolist():
            label[a] = label[b] = min(label[a], label[b])
    assert {n: found.get(n, n) for n in label} == label and all(a != b for a, b in found.items())
    assert sw.hanging_together(np.zeros((0, 2), np.int64)).shape == (0, 2)


def test_wide_simhash_radii():
    """Radii of lanes differ; the chance that bits differ, by drawn bits."""
    config, rng = sw.WideConfig(), np.random.default_rng(5)
    radii = sw.radii(config)
    assert (np.diff(radii) <= 0).all() and radii[-1] == config.radius
    for n, m in [(4, 5), (12, 15), (20, 25), (80, 100)]:
        ones = rng.integers(0, 2, (200_000, m))
        share = ((2 * ones[:, :n].sum(axis=1) > n) != (2 * ones.sum(axis=1) > m)).mean()
        assert config.bits * share + 4.5 * np.sqrt(config.bits * share * (1 - share)) < radii[n]
    a = rng.integers(0, 2**63, (200, 16)).astype(np.uint64)
    b, reach = a.copy(), rng.integers(200, 400, 200)
    for i in range(200):
        for x in rng.choice(1024, int(reach[i] + rng.integers(-1, 3)), replace=False):
            b[i, x // 64] ^= np.uint64(1) << np.uint64(x % 64)
    near = np.bitwise_count(a ^ b).sum(axis=1) <= reach
    assert sw.near_pairs(a, b, reach).tolist() == near.tolist() and 0 < near.sum() < 200
    for i in (0, 7, 199):
        assert bool(list(sw.tile_links(a[i : i + 1], np.array([1]), b[i : i + 1], np.array([2]), (reach[i : i + 1], reach[i : i + 1] - 50)))) == near[i]


def test_substring_dedup(messy, empty):
    same(substring_dedup.substring_digests(messy), ["doc_id", "n_words", "n_removed", "kept_sha256"], substring(MESSY))
    assert substring_dedup.substring_digests(empty).count() == 0


def test_substring_dedup_of_shared_passages(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    shared = [[word() for _ in range(rng.choice([49, 50, 51, 80, 130]))] for _ in range(6)]
    rows = [(i, " ".join(x for _ in range(4) for x in (rng.choice(shared) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 60))]))) for i in range(120)]
    docs = documents(spark, rows, extra=True)
    same(substring_dedup.substring_digests(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"], expected := substring(rows))
    stage = substring_dedup.substring_dedup(docs)
    assert stage.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in stage.select("doc_id", "text").collect()}
    assert all(hashlib.sha256(" ".join(words(kept[d])).encode()).hexdigest() == h for d, _, _, h in expected)


def test_lm_scoring(messy, empty):
    config = lm_scoring.LmConfig(least_words=8, groups=4, dims=4, batch=64)
    rows = lm_scoring.lm_scores(messy, config).collect()
    assert lm_scoring.lm_scores(empty, config).count() == 0
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(t for r in MESSY if not held(r[0]) for t in [*words(lower(r[1] or "")), ""])
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(r[0]), held(r[0]), len(t), sum(counts[x] > 0 for x in t), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in t), 4)) for r in MESSY for t in [[*words(lower(r[1] or "")), ""]])
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == expected
    assert all(r["score"] < 0 for r in rows)


def test_lm_rare_words_join(spark):
    rows = [(i, " ".join([*(f"common{j}" for j in range(9)), *(f"v{j}" for j in range(i % 9, 60, 3))])) for i in range(40)]
    docs = documents(spark, rows)
    few, many = (lm_scoring.lm_scores(docs, lm_scoring.LmConfig(dictionary=d, least_words=8, most_words=8, groups=4, dims=4, batch=64)).orderBy("doc_id").collect() for d in (50, 10**6))
    assert [(r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in few] == [(r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in many]


def test_lm_forward_pass_by_brute_force():
    """Two softmaxes, term by term; after any context the classes' probabilities add up to one."""
    rng, config = np.random.default_rng(0), lm_scoring.LmConfig(dims=5)
    model = lm_scoring.LogBilinear.start(np.sort(rng.integers(1, 500, 30))[::-1].astype(float), config)
    model.parts = {n: (p + rng.normal(0, 0.5, p.shape)).astype(np.float32) for n, p in model.parts.items()}
    p, bounds = {n: x.astype(float) for n, x in model.parts.items()}, model.bounds.tolist()
    assert len(bounds) > 3

    def brute(before, after):
        h = sum(p["r"][before[i]] @ p["c"][i] for i in range(3))
        c = next(c for c in range(len(bounds) - 1) if bounds[c] <= after < bounds[c + 1])
        clusters = [h @ p["u"][k] + p["a"][k] for k in range(len(bounds) - 1)]
        classes = {k: h @ p["q"][k] + p["b"][k] for k in range(bounds[c], bounds[c + 1])}
        return clusters[c] - np.log(np.exp(clusters).sum()) + classes[after] - np.log(np.exp(list(classes.values())).sum())

    for before in rng.integers(0, 30, (20, 3)):
        got = model.log_probabilities(np.tile(before, (30, 1)), np.arange(30), 7)
        assert np.allclose(got, [brute(before, k) for k in range(30)], atol=1e-4) and abs(np.exp(got).sum() - 1) < 1e-5
    two = lm_scoring.contexts(np.array([7, 8, 9, 5, 4, 6, 3]), np.array([0, 4]), 0).tolist()
    assert two == [[0, 0, 0], [7, 0, 0], [8, 7, 0], [9, 8, 7], [0, 0, 0], [4, 0, 0], [6, 4, 0]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB \t\n\x0b\x0c\r\x1cÉ\u00a0", max_size=12) | st.none(), max_size=6), st.integers(1, 20))
def test_lm_tokens(texts, size):
    """Words and ends of every text, in order, whatever the slices."""
    import pyarrow as pa

    got, old = [], lm_scoring.SLICE
    try:
        lm_scoring.SLICE = size
        for distinct, place, cuts in lm_scoring.token_slices(pa.array(texts, pa.string())):
            got += [[distinct[i].decode() for i in place[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    finally:
        lm_scoring.SLICE = old
    assert got == [[*words(lower(t or "")), ""] for t in texts]


def test_lm_training_learns_from_three_classes_back():
    """A token that repeats the one three places before it, in a fifth of cases anything: contexts must tell it."""
    rng, config = np.random.default_rng(0), lm_scoring.LmConfig(dims=16, batch=512, noise=24)
    text = rng.integers(1, 20, 60_000)
    for i in range(3, len(text)):
        if rng.random() < 0.8:
            text[i] = text[i - 3]
    rank = np.argsort(-np.bincount(text, minlength=20), kind="stable")
    text = np.argsort(rank)[text].astype(np.int16)
    model = lm_scoring.LogBilinear.start(np.bincount(text, minlength=20).astype(float), config)
    trainer, before = lm_scoring.Trainer(model, config, [1]), lm_scoring.contexts(text, np.array([0]), 0)
    start = -model.log_probabilities(before[-5000:], text[-5000:]).mean()
    for i in range(0, 55_000, 512):
        trainer.step(before[i : i + 512], text[i : i + 512])
    model.parts = trainer.parts
    loss = -model.log_probabilities(before[-5000:], text[-5000:]).mean()
    assert start > 2.5 and loss < 1.6, (start, loss)  # 2.94 by frequency alone, 1.2 at best


def test_lm_scores_of_the_whole_model(spark):
    """Each text's score from the operator's parts: its classes' probabilities and the words' shares in shared classes."""
    rng = random.Random(5)
    rows = [(i, " ".join(x for _ in range(12) for x in rng.choice(["the cat sat", "a dog ran", "some bird sang", f"odd{rng.randint(0, 30)}"]).split())) for i in range(300)]
    config = lm_scoring.LmConfig(least_words=6, most_words=6, groups=3, dims=8, batch=128)
    got = lm_scoring.lm_scores(documents(spark, rows), config).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = lm_scoring.lm_scores(documents(spark, rows), config).collect()
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in got) == sorted((r["doc_id"], round(r["score"], 6)) for r in again)


def test_bpe(messy, empty):
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.encoder(path, tokenizers.PATTERN).vocabulary.ranks
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in MESSY:
        ids = library.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same(bpe.encode_digests(messy, path, tokenizers.PATTERN), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], expected)
    assert bpe.encode_digests(empty, path, tokenizers.PATTERN).count() == 0
    assert {len(r["ids"]) for r in bpe.encode_ids(messy.filter("doc_id = 11"), path, tokenizers.PATTERN).collect()} == {len(library.encode_ordinary("a b c"))}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text("aeinrstl' ", max_size=120) | st.text("a 1\u0558\u088f\u209d\U0003d8db\U000323b0\U00011de0\U0001f642\U00020000", max_size=8))
def test_bpe_round_trip(text):
    import tiktoken

    e = bpe.encoder(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=e.vocabulary.ranks, special_tokens={})
    ids = e.encode(text)
    assert ids == library.encode_ordinary(text) and e.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text("aeinrst", max_size=120), st.integers(0, 120), st.integers(0, 5), st.text("aeinrst", max_size=5))
def test_bpe_edits(text, start, length, new):
    v = bpe.encoder(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).vocabulary
    data, start = text.encode(), min(start, len(text))
    e = bpe.PrefixEncoding(v, data)
    e.replace(start, min(len(data), start + length), new.encode())
    e.append(b"ing")
    whole = data[:start] + new.encode() + data[min(len(data), start + length) :] + b"ing"
    assert e.last == bpe.PrefixEncoding(v, whole).last and e.tokens() == v.merged(whole)


def test_line_dedup(spark, empty):
    rows = [(i, f"common line\nown {i}\n\nrare {i % 3}", "en", f"s{i % 9}") for i in range(30)] + [(31, None, None, None), (32, "", "en", None), (None, "common line\n x", "en", "s1"), (33, "common line", "en", "s1"), (33, "common line", "en", "s1"), (34, "twice\ntwice", "en", "s2")]
    for extra in (False, True):
        docs = documents(spark, rows, extra)
        got = line_dedup.line_changes(docs).withColumn("h", F.sha2(F.coalesce("new_text", F.lit("")), 256))
        same(got, ["doc_id", "n_lines", "n_removed", "h"], lines(rows, 6))
        stage = line_dedup.line_dedup(docs)
        assert stage.columns == docs.columns and stage.count() == len(rows)
    assert line_dedup.line_changes(empty).count() == 0


def test_line_sites_near_and_far_from_the_threshold(spark):
    rows = [(i * 100 + s, f"line {i}\nown {i} {s}", "en", f"site{s}") for i in (99, 100, 101, 130, 60) for s in range(i)]
    got = line_dedup.line_changes(documents(spark, rows), line_dedup.LineConfig(min_sites=100)).filter("n_removed > 0").count()
    assert got == 99 + 100 + 129


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(1200):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        if i % 6 == 0:
            at = rng.randrange(len(text))
            text[at:at] = rng.sample(["scum", "vile!", "Idiot", "rotten"], 2)
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            marks.append((i, 1, int(i % 6 == 0)))
    rows += [(5000, None), (5001, ""), (5001, ""), (5002, LONG), (None, "scum")]
    marks += [(9999, 1, 1), (0, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 0)]
    for extra in (False, True):
        got = toxicity.toxicity_scores(documents(spark, rows, extra), labels(spark, marks)).collect()
        by = {r["doc_id"]: r for r in got}
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(1200))
        held = [i for i in range(1200) if by[i]["held_out"]]
        assert np.mean([by[i]["predicted"] == int(i % 6 == 0) for i in held]) > 0.98
        assert not by[5000]["predicted"] and not by[5002]["predicted"]
    assert toxicity.toxicity_scores(empty, labels(spark, marks)).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(documents(spark, rows[:5]), labels(spark, [])).collect()} == {0.0}


def test_toxicity_of_one_word(spark):
    """All labelled texts are one and the same word: nothing tells them apart."""
    rows = [(i, "same same") for i in range(40)]
    got = toxicity.toxicity_scores(documents(spark, rows), labels(spark, [(i, 1, i % 2) for i in range(40)])).collect()
    assert len(got) == 40 and len({r["score"] for r in got}) == 1 and 0 <= got[0]["score"] <= 1


def test_toxicity_passages(spark):
    model = toxicity.ToxicityModel({b"scum": 3.0, b"vile": 2.0}, 0.5, 1.0, 0.5)
    got = toxicity.passages(documents(spark, [(1, "a b Scum! and vile c d e f g h i scum"), (2, None)]), model).orderBy("first_word").collect()
    assert [(r["first_word"], r["n_words"], r["segment_score"]) for r in got] == [(2, 3, 4.5), (12, 1, 3.0)]


def brute_segments(v):
    """Ruzzo and Tompa's definition: the best segment (shortest of ties, first), then left and right of it."""
    best = max(((round(sum(v[a:b]), 9), a - b, -a, a, b) for a in range(len(v)) for b in range(a + 1, len(v) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    a, b = best[3], best[4]
    return brute_segments(v[:a]) + [(a, b)] + [(b + x, b + y) for x, y in brute_segments(v[b:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-50, 50).map(lambda x: x + 0.5), max_size=25))
def test_maximal_segments(values):
    got = [(a, b) for a, b, _ in toxicity.segments(np.array(values))]
    total = lambda s: round(sum(sum(values[a:b]) for a, b in s), 6)
    expected = brute_segments(values)
    assert total(got) == total(expected) and len(got) == len(expected)


def test_fingerprints_of_many_texts():
    rng = random.Random(11)
    for _ in range(50):
        text = " ".join(rng.choice(["a", "B", "Ça", "de", "\t", "x\ny"]) for _ in range(rng.randint(0, 40)))
        assert sh.fingerprint(text.encode()) == fingerprint(text)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    """The registered queries on whole tables against their SQL."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    expected = con.execute(queries.ORACLES[name])
    names = [d[0] for d in expected.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(names)
    same(got, names, expected.fetchall())


def test_stages_on_messy_rows(spark, empty):
    """The texts that the stages of lines and passages return, row by row, on nulls, empty and long texts and repeated rows."""
    rows = [*MESSY, *((100 + i, f"footer line\nown {i}", "en", f"s{i}") for i in range(8))]
    rows = [(*r, "en", "s0")[:4] if len(r) == 2 else r for r in rows]
    docs = documents(spark, rows, extra=True)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    cut = line_dedup.line_dedup(docs)
    assert cut.columns == docs.columns
    assert Counter((r["doc_id"], digest(r["text"])) for r in cut.collect()) == Counter((d, h) for d, _, _, h in lines(rows, 6))
    kept = substring_dedup.substring_dedup(docs)
    assert kept.columns == docs.columns and kept.filter("n_chars <> length(text)").count() == 0
    assert Counter((r["doc_id"], digest(" ".join(words(r["text"])))) for r in kept.collect()) == Counter((d, h) for d, _, _, h in substring(rows))
    assert kept.filter("text is null").count() == 1 and cut.filter("text is null").count() == 1
    for stage in (quality_rules.quality_filter, line_dedup.line_dedup, sw.keep_representatives, substring_dedup.substring_dedup):
        assert stage(empty).count() == 0 and stage(empty).columns == empty.columns


def test_cut_lines_of_a_long_text(spark):
    """A hundred thousand lines of which half go: linear, not one search for each line."""
    n = 100_000
    got = spark.range(1).select(line_dedup.cut_lines(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("string")), "\n"), F.sequence(F.lit(0), F.lit(n - 1), F.lit(2))).alias("t")).first()["t"]
    assert got.split("\n") == [str(i) for i in range(1, n, 2)]


def test_toxicity_cross_validation(spark):
    """Folds of training rows alone: labels of held-out rows change nothing."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(40)]) for _ in range(30)) + (" vile scum" if i % 4 == 0 else "")) for i in range(400)]
    marks = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    held = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in marks]
    configs = [toxicity.ToxicityConfig(), toxicity.ToxicityConfig(least_z=50.0)]
    good, bad = toxicity.cross_validate(documents(spark, rows), labels(spark, marks), configs, 2)
    assert good["recall"] > 0.95 and good["precision"] > 0.95 and good["loss"] < bad["loss"]
    assert toxicity.cross_validate(documents(spark, rows), labels(spark, held), configs[:1], 2) == [good]


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] and set(queries.ORACLES) <= set(queries.QUERIES)
    assert SENTENCE
