import datetime
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedspace.functions import paths, vectors
from embedspace.operators import clustering, images, layout, models, similarity
from embedspace.schema import VECTORS, VectorError, check_vectors
from embedspace.sources import files
from embedspace.sources.store import VectorStore
from embedspace.streaming.ingest import append_rows, ingest_folder, ingest_stream, refresh_layout, retry_failed, scan_progress, ticks


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, vector array<float>")


def loop(rows, t):
    """Leader clustering, one vector after another."""
    rows, seeds, out = [np.array(r, dtype=np.float32).astype(float) for r in rows], [], []
    for r in rows:
        for k, s in enumerate(seeds):
            n = np.linalg.norm(r) * np.linalg.norm(s)
            if n and r @ s / n >= t:
                out.append(k)
                break
        else:
            out.append(len(seeds))
            seeds.append(r)
    return out


def test_cosine_values(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got[:3], [1, 0, -1]) and math.isnan(got[3])
    assert [r[0] for r in df.select(vectors.at_least(vectors.cosine(F.col("a"), F.col("b")), 0.5)).collect()] == [True, False, False, False]
    assert df.select(vectors.sparse_cosine(vectors.sparsify(F.col("a")), vectors.sparsify(F.col("b")))).collect()[3][0] == 0


def test_sparsify_ties_signs_and_short_vectors(spark):
    df = frame(spark, [[1, 3, 3, -5, 2], [-1, -2, -3, -4, -5], [7]])
    got = [r["s"] for r in df.orderBy("vec_id").select(vectors.sparsify(F.col("vector"), 2).alias("s")).collect()]
    assert got == [{1: 3.0, 2: 3.0}, {0: -1.0, 1: -2.0}, {0: 7.0}]


def test_validation(spark):
    assert check_vectors(frame(spark, [[1, 2], [3, 4]])) == (2, 2) and check_vectors(frame(spark, [])) == (0, 0)
    for bad in ([[1, 2], [3]], [[1, float("nan")]]):
        with pytest.raises(VectorError):
            check_vectors(frame(spark, bad))
    with pytest.raises(VectorError):
        check_vectors(frame(spark, [[1], [2]]).withColumn("k", F.lit(1)), key="k")


@pytest.mark.parametrize("bad", [[[1, 2], [3, 4, 5, 6]], [[1, 2], [float("nan"), 1]], [[1, 2, 3], [4, 5]]], ids=["longer", "nan", "shorter"])
def test_vectors_that_cannot_be_compared(spark, bad):
    df = frame(spark, bad)
    for act in (lambda: clustering.leader_clusters(df, 0.5), lambda: similarity.similar_pairs(df, 0.5)):
        with pytest.raises(VectorError):
            act()
    for act in (lambda: similarity.similarity_to(df, 0).count(), lambda: similarity.sparse_similarity_to(df, 0).count(), lambda: layout.pca_scores(df).count()):
        with pytest.raises(Exception, match="VectorError"):
            act()


def test_leader_clusters_of_hashed_ids(spark):
    """Ids of both signs and great distance, in batches that cut points must find."""
    rows = np.random.default_rng(4).normal(size=(300, 4)).tolist()
    ids = sorted(np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 298, dtype=np.int64).tolist() + [-(2**63), 2**63 - 1])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, rows, strict=True)], "vec_id long, vector array<float>")
    for batch in (7, 64):
        got = clustering.leader_clusters(df, 0.7, batch).orderBy("vec_id").collect()
        assert [r["cluster_id"] for r in got] == loop(rows, 0.7)


def test_search_against_expressions(spark):
    rows = np.random.default_rng(6).integers(-3, 4, size=(80, 12)).tolist() + [[0] * 12]
    df = frame(spark, rows)
    anchor = F.array(*(F.lit(float(x)) for x in rows[0]))
    dense = {r["vec_id"]: r["s"] for r in df.filter("vec_id > 0").select("vec_id", vectors.cosine(anchor, F.col("vector")).alias("s")).collect()}
    got = {r["vec_id"]: r["similarity"] for r in similarity.similarity_to(df, 0).collect()}
    assert got.keys() == dense.keys() and all(math.isclose(got[k], dense[k], abs_tol=1e-12) or math.isnan(got[k]) and math.isnan(dense[k]) for k in got)
    sparse = {r["vec_id"]: r["s"] for r in df.filter("vec_id > 0").select("vec_id", vectors.sparse_cosine(vectors.sparsify(anchor, 4), vectors.sparsify(F.col("vector"), 4)).alias("s")).collect()}
    got = {r["vec_id"]: r["similarity"] for r in similarity.sparse_similarity_to(df, 0, 4).collect()}
    assert got.keys() == sparse.keys() and all(math.isclose(got[k], sparse[k], abs_tol=1e-12) for k in got)
    entries = sorted((r["vec_id"], r["dim"], r["val"]) for r in similarity.sparse_entries(df, 4).collect())
    assert entries == sorted((r["vec_id"], d, v) for r in similarity.sparse_vectors(df, 4).collect() for d, v in r["sparse"].items())
    assert similarity.similarity_to(df, 999).count() == similarity.sparse_similarity_to(df, 999).count() == 0


@pytest.mark.parametrize("batch", [1, 3, 2048])
@pytest.mark.parametrize("rows", [
    [], [[1, 0]], [[0, 0], [1, 0], [0, 0], [2, 0.1]], [[1, 0], [0.8, 0.6], [0.28, 0.96]],
    np.random.default_rng(1).normal(size=(60, 3)).tolist(),
], ids=["none", "one", "zeros", "chain", "random"])
def test_leader_clusters(spark, rows, batch):
    got = clustering.leader_clusters(frame(spark, rows), 0.7, batch).orderBy("vec_id").collect()
    expected = loop(rows, 0.7)
    assert [r["cluster_id"] for r in got] == expected
    assert [r["is_seed"] for r in got] == [c not in expected[:i] for i, c in enumerate(expected)]


def test_order_matters_and_duplicate_keys(spark):
    chain = [[1, 0], [0.8, 0.6], [0.28, 0.96]]
    assert loop(chain, 0.7) == [0, 0, 1] and loop(chain[1:] + chain[:1], 0.7) == [0, 0, 0]
    df = frame(spark, [[1], [2], [3]]).withColumn("file_path", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.col("vec_id").cast("int") + 1))
    assert [r["vec_id"] for r in clustering.first_by_key(df, "file_path").orderBy("vec_id").collect()] == [0, 1]
    nested = clustering.nested_clusters(frame(spark, chain), clustering.leader_clusters(frame(spark, chain), 0.7)).orderBy("cluster_id").collect()
    assert [r["images"] for r in nested] == [[0, 1], [2]] and np.allclose(nested[0]["centroid"], [0.9, 0.3])


def test_similar_pairs_in_tiles(spark):
    rows = np.random.default_rng(2).normal(size=(90, 4)).tolist() + [[0, 0, 0, 0]]
    whole, tiled = (sorted((r["a"], r["b"]) for r in similarity.similar_pairs(frame(spark, rows), 0.6, **k).collect()) for k in ({}, {"broadcast_bytes": 0, "tile_rows": 20}))
    u = similarity.unit_rows(np.array(rows, dtype=np.float32).astype(float))
    assert whole == tiled == [(i, j) for i in range(91) for j in range(i + 1, 91) if u[i] @ u[j] >= 0.6]
    assert similarity.similar_pairs(frame(spark, []), 0.5).count() == 0


def test_pca_goldens(spark):
    one = layout.pca_scores(frame(spark, [[1, 2], [2, 3], [3, 4], [4, 5]]), ("x",)).orderBy("vec_id").collect()
    assert np.allclose(np.abs([r["x"] for r in one]), [2.12132, 0.707107, 0.707107, 2.12132], atol=1e-5)
    two = [r["x"] for r in layout.pca_scores(frame(spark, [[2, 2], [2, 2.2], [2, 3], [4, -5]]), ("x",)).orderBy("vec_id").collect()]
    assert np.allclose(np.array(two) * np.sign(two[-1]), [-1.529893, -1.72313, -2.496078, 5.749102], atol=1e-5)


def test_layout_edges(spark):
    assert layout.positions(frame(spark, [])).count() == 0
    for rows in ([[1, 2, 3]], [[1, 2, 3]] * 3):
        assert {(r["x"], r["y"]) for r in layout.positions(frame(spark, rows)).collect()} == {(500.0, 500.0)}
    tight = spark.createDataFrame([(0.0, 0.0), (5e-5, 1.0)], "x double, y double")
    plain, cached = (layout.to_canvas(tight, 100, 100, cached=c).orderBy("y").collect()[1] for c in (False, True))
    assert math.isclose(plain["x"], 5 + 5e-5 * 90) and math.isclose(cached["x"], 5 + 0.5 * 90) and plain["y"] == 95
    df = frame(spark, np.random.default_rng(0).normal(size=(30, 5)).tolist())
    placed = layout.positions(df, clustering.leader_clusters(df, 0.5))
    summary = layout.scatter_summary(placed)
    assert summary.agg(F.sum("image_count")).first()[0] == 30 and placed.filter("vec_id is null").count() == summary.count()
    assert placed.filter("x < 499.99 or x > 9500.01 or y < 499.99 or y > 9500.01").count() == 0


def test_paths(spark):
    cases = {"c.JPG": True, "y.tar.gif": True, "/d.jpg/noext": False, "trailing.": False, "a\\b.bmp": True, "x": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", paths.is_image(F.col("p"))).collect()} == cases
    assert df.select(paths.path_key(F.lit("C:\\Photos\\Cat.JPG"))).first()[0] == "264d2d9d55814ee36ef8b83253196f37"
    sizes = {None: "0 KB", 0: "0 KB", 1_047_552: "1023 KB", 1_048_575: "1024 KB", 1_048_576: "1.0 MB", 1_310_720: "1.3 MB", 512: "1 KB"}
    got = spark.createDataFrame([(k,) for k in sizes], "n long").select("n", paths.size_text(F.col("n"))).collect()
    assert {r[0]: r[1] for r in got} == sizes
    assert [r[0] for r in spark.createDataFrame([(None,), (" \t",), ("a",)], "t string").select(paths.is_blank(F.col("t"))).collect()] == [True, True, False]


def test_progress(spark):
    steps = spark.createDataFrame([(1, "a", False, False), (2, "b", True, False), (3, "c", False, True), (4, "d", False, False)], "seq long, current_file string, skipped boolean, failed boolean")
    got = [(r["seq"], r["processed_count"], r["total_count"], r["pct"]) for r in scan_progress(steps, block=2).orderBy("seq").collect()]
    assert got == [(1, 1, 4, 25.0), (4, 3, 4, 75.0)]
    many = spark.range(1000).select(F.col("id").alias("seq"), F.lit("f").alias("current_file"), (F.col("id") % 3 == 0).alias("skipped"), (F.col("id") % 7 == 0).alias("failed"))
    whole = [(r["seq"], r["processed_count"]) for r in scan_progress(many).orderBy("seq").collect()]
    assert whole == [(r["seq"], r["processed_count"]) for r in scan_progress(many, block=4).orderBy("seq").collect()]
    assert ticks(spark).isStreaming


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "images"
    (root / "sub").mkdir(parents=True)
    rng = np.random.default_rng(0)
    for name in ("a.png", "D.PNG", "sub/f.png", "_b.png", ".c.png"):
        (root / name).write_bytes(images.png(rng.integers(0, 255, (20, 30, 3))))
    (root / "e.txt").write_text("text")
    (root / "bad.jpg").write_bytes(b"not an image")
    return root


def test_listing_and_pixels(spark, folder):
    base = lambda df: sorted(r[0] for r in df.select(paths.base_name(F.col("file_path"))).collect())
    assert base(files.list_images(spark, str(folder))) == ["D.PNG", "a.png", "bad.jpg", "f.png"]
    assert base(files.list_files(spark, str(folder), "*.png")) == ["a.png", "f.png"]
    assert files.list_files(spark, str(folder / "none")).count() == 0 and files.listed(spark, ["x", "y"]).count() == 2
    whole = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    flat = images.tensor(whole.tobytes(), 2, 2, 3, side=2)
    assert np.allclose(flat[0] * 0.229 + 0.485, whole[:, :, 2] / 255, atol=1e-6) and images.resize(np.ones((4, 9, 3)), 3, crop=False).shape == (3, 3, 3)
    assert images.output_node(["q", "z"], "logit") == "z" and images.output_node(["q", images.EMBEDDING_NODE], "embedding") == images.EMBEDDING_NODE
    with pytest.raises(FileNotFoundError):
        images.onnx_vectorizer("/no/such/model.onnx")()
    thumbs = images.thumbnails(files.decode_images(spark, str(folder)))
    assert thumbs.count() == 3 and images.thumbnails(files.decode_images(spark, str(folder)), thumbs).count() == 0


def tiny_model():
    """data [n, 3, 224, 224] to means by channel (the embedding's node) to a flat list (the logits' node), written field by field."""
    f = models.field
    shape = lambda *dims: b"".join(f(1, f(2, d) if isinstance(d, str) else f(1, d)) for d in dims)
    value = lambda name, *dims: f(1, name) + f(2, f(1, f(1, 1) + f(2, shape(*dims))))
    node = lambda source, to, kind: f(1, f(1, source) + f(2, to) + f(4, kind))
    graph = node(images.INPUT_NODE, images.EMBEDDING_NODE, "GlobalAveragePool") + node(images.EMBEDDING_NODE, "flat", "Flatten") + node("flat", images.LOGIT_NODE, "Neg")
    graph += f(2, "tiny") + f(11, value(images.INPUT_NODE, "n", 3, 224, 224)) + f(12, value(images.LOGIT_NODE, "n", 3))
    return f(1, 8) + f(8, f(1, "") + f(2, 13)) + f(7, graph)


def test_models_and_cut_models(spark, folder, tmp_path):
    """A whole run of the model's own maker: logits of the model as it is, embeddings after it is cut."""
    pytest.importorskip("onnxruntime")
    (tmp_path / "whole.onnx").write_bytes(tiny_model())
    (tmp_path / "cut.onnx").write_bytes(models.cut_model(tiny_model()))
    pictures = files.decode_images(spark, str(folder)).filter("height > 0")
    logits, embeddings = ({r["file_path"]: r["vector"] for r in images.vectorize(pictures, images.onnx_vectorizer(f"{tmp_path}/{n}.onnx", k)).collect()} for n, k in (("whole", "logit"), ("cut", "embedding")))
    expected = {r["file_path"]: images.tensor(r["bgr"], r["height"], r["width"], r["channels"]).mean(axis=(1, 2)) for r in pictures.collect()}
    assert len(expected) == 3 and logits.keys() == embeddings.keys() == expected.keys()
    assert all(np.allclose(embeddings[k], v, atol=1e-5) and np.allclose(logits[k], -v, atol=1e-5) for k, v in expected.items())
    with pytest.raises(ValueError, match="no node"):
        models.cut_model(tiny_model(), "nothing")
    with pytest.raises(ValueError):
        models.cut_model(tiny_model()[:-5])


def test_ingest_and_store(spark, folder, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0 and store.complete()
    first = {r["error"] is None for r in ingest_folder(spark, str(folder), store, images.pooled_vectorizer(), files_per_batch=2).collect()}
    assert first == {True, False} and store.read().filter("file_size > 0").count() == 3 and check_vectors(store.read(), key="file_path") == (3, 48)
    assert sorted(r[0] for r in store.read().select("vec_id").collect()) == [0, 1, 2]
    shown = store.read().join(store.thumbnails(), F.col("thumbnail_path").contains(F.col("key")))
    assert shown.count() == 3 and all(r["content"][1:4] == b"PNG" for r in shown.collect())
    assert [r["error"] for r in store.failures().collect()] == ["the image can't be decoded"]
    again = ingest_folder(spark, str(folder), store, images.pooled_vectorizer(), layout=True)
    assert again.count() == 1  # only the one that failed
    assert store.complete() and not refresh_layout(store)
    rows = store.read()
    path = rows.first()["file_path"]
    assert store.exists(path) and not store.exists("nothing") and store.fetch(path).count() == 1
    store.save(rows.limit(1).withColumns({"file_size": F.lit(5).cast("long"), "file_path": F.lit(path)}))
    assert store.read().count() == 3 and store.fetch(path).first()["file_size"] == 5
    (folder / "bad.jpg").write_bytes(images.png(np.full((8, 8, 3), 7)))
    assert [r["error"] for r in retry_failed(store, images.pooled_vectorizer()).collect()] == [None]
    assert store.failures().count() == 0 and store.read().count() == 4 and store.read().agg(F.max("vec_id")).first()[0] == 3 and not store.complete()
    (tmp_path / "store" / "other.txt").write_text("stays")
    store.clear()
    assert store.read().count() == store.thumbnails().count() == store.failures().count() == 0 and (folder / "a.png").exists()
    assert [p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")] == ["other.txt"]


def test_store_commits(spark, tmp_path):
    """Saves write only what they bring; the later commit wins; compaction leaves the same rows and fewer folders."""
    store = VectorStore(spark, f"file://{tmp_path}/store")
    row = lambda i, size: (i, f"p{i}", [1.0, float(i)], "embedding", datetime.datetime(2024, 1, 1), size, None, None, None)
    expected, store.MOST_DELTAS = {}, 4
    rng = np.random.default_rng(0)
    for k in range(11):
        some = {int(i): k for i in rng.choice(30, 6, replace=False)}
        expected |= some
        store.save(spark.createDataFrame([row(i, s) for i, s in some.items()], VECTORS))
        assert {r["vec_id"]: r["file_size"] for r in store.read().collect()} == expected
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("v")]) <= 10
    kept = store.read()
    store.compact()
    assert {r["vec_id"]: r["file_size"] for r in kept.collect()} == expected  # who reads the last commits still can
    assert store.next_id() == max(expected) + 1


def test_ingest_stream(spark, folder, tmp_path):
    store, seen = VectorStore(spark, f"file://{tmp_path}/store"), []
    for _ in range(2):
        query = ingest_stream(spark, str(folder), store, images.pooled_vectorizer(), f"{tmp_path}/checkpoint", files_per_batch=2, on_progress=lambda *x: seen.append(x))
        query.awaitTermination(120)
    assert store.read().count() == 3 and sum(s[1] for s in seen) == 3 and sum(s[2] for s in seen) == 1
    assert store.failures().count() == 1 and store.thumbnails().count() == 3


def test_ingest_stream_stops_and_goes_on(spark, folder, tmp_path):
    """Cancelled after a batch: what was saved stays, and a restart does the rest without doing any file twice."""
    store, first, seen = VectorStore(spark, f"file://{tmp_path}/store"), threading.Event(), []

    def note(number, saved, failed):
        seen.append(saved + failed)
        first.set()

    run = lambda: ingest_stream(spark, str(folder), store, images.pooled_vectorizer(), f"{tmp_path}/checkpoint", files_per_batch=1, on_progress=note)
    query = run()
    assert first.wait(60)
    query.stop()
    assert 1 <= sum(seen) and store.read().count() + store.failures().count() >= 1
    run().awaitTermination(120)
    assert store.read().count() == 3 and store.failures().count() == 1


def test_crop_and_stretch():
    """The middle square of a wide picture, pixel by pixel; stretching takes all of it."""
    wide = np.arange(4 * 10 * 3, dtype=np.uint8).reshape(4, 10, 3)
    assert np.array_equal(images.resize(wide, 4), wide[:, 3:7].astype(float))
    stretched = images.resize(wide, 2, crop=False)
    assert stretched.shape == (2, 2, 3) and np.allclose(stretched[0, 0], wide[:2, 2].mean(axis=0)) and np.allclose(stretched[1, 1], wide[2:, 7].mean(axis=0))


def test_timer_appends_rows(spark, tmp_path):
    query = append_rows(spark, f"{tmp_path}/rows", f"{tmp_path}/checkpoint", 5, 0.5)
    try:
        query.awaitTermination(4)
    finally:
        query.stop()
    assert spark.read.schema("timestamp timestamp, value long").parquet(f"{tmp_path}/rows").count() > 0
