"""Named queries over the driver's tables; each has its SQL in oracles.py unless SQL can't express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedspace.functions import paths, vectors
from embedspace.operators import clustering, images, layout, similarity
from embedspace.schema import fresh_path
from embedspace.sources import files, store
from embedspace.streaming.ingest import scan_progress

DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")


def rounded(c: Column | str) -> Column:
    return F.round(c, DIGITS)


def round_all(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(n) for n in names})


@query
def leader_clusters_t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(clustering.leader_clusters(embeddings(spark, sf_dir), 0.3), "similarity")


@query
def leader_clusters_t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(clustering.leader_clusters(embeddings(spark, sf_dir), clustering.PRESET), "similarity")


@query
def similarity_to_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    return round_all(similarity.similarity_to(df, similarity.first_vector(df)), "similarity")


@query
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", rounded(vectors.norm(F.col("vector"))).alias("norm"), rounded(vectors.dot(F.col("vector"), F.reverse("vector"))).alias("dot_reversed"))


@query
def similar_pairs_t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(similarity.similar_pairs(embeddings(spark, sf_dir), 0.3), "similarity")


@query
def topk_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.sparse_entries(embeddings(spark, sf_dir)).withColumn("val", rounded(F.col("val").cast("double")))


@query
def sparse_similarity_to_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    return round_all(similarity.sparse_similarity_to(df, similarity.first_vector(df)), "similarity")


@query
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_sizes(clustering.leader_clusters(embeddings(spark, sf_dir), 0.3))


@query
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    return round_all(clustering.centroid_entries(clustering.members(df, clustering.leader_clusters(df, 0.3)), "cluster_id"), "value")


@query
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(clustering.centroid_entries(embeddings(spark, sf_dir), "label"), "value")


@query
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(layout.column_means(embeddings(spark, sf_dir)), "mean")


@query
def centered_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of squares by dimension after centering."""
    x = layout.centered(embeddings(spark, sf_dir)).select(F.posexplode("vector").alias("dim", "x"))
    return x.groupBy("dim").agg(rounded(F.sum(F.col("x") * F.col("x"))).alias("moment"))


@query
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(layout.pca_scores(embeddings(spark, sf_dir).select("vec_id", "vector")), "x", "y")


@query
def pca_scores_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(layout.pca_scores(embeddings(spark, sf_dir).select("vec_id", "vector"), ("x",)), "x")


@query
def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two greatest ones of the centered vectors."""
    return round_all(layout.singular_values(embeddings(spark, sf_dir)), "singular_value")


@query
def cluster_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clusters at 0.3 on one map with their centroids, which take part in means and axes; a centroid's vec_id is -1 less its cluster's."""
    df = embeddings(spark, sf_dir)
    placed = layout.positions(df, clustering.leader_clusters(df, 0.3), width=layout.PRESET_CANVAS, height=layout.PRESET_CANVAS)
    return placed.select(F.coalesce("vec_id", -1 - F.col("cluster_id").cast("long")).alias("vec_id"), "cluster_id", "is_centroid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query
def cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each leader cluster at 0.3, at its centroid's place."""
    df = embeddings(spark, sf_dir)
    placed = layout.positions(df, clustering.leader_clusters(df, 0.3), width=layout.PRESET_CANVAS, height=layout.PRESET_CANVAS)
    return layout.scatter_summary(placed).select("cluster_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "image_count")


def hashed_ids(df: DataFrame) -> DataFrame:
    """vec_id spread over all longs, of both signs, in an order of its own: mixed by an odd factor modulo 2^64."""
    x = (F.col("vec_id").cast("decimal(38,0)") * F.lit("11400714819323198485").cast("decimal(20,0)")) % F.lit("18446744073709551616").cast("decimal(20,0)")
    return df.withColumn("vec_id", (x - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long"))


@query
def leader_clusters_hashed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of both signs, as hashes are, in small batches."""
    return round_all(clustering.leader_clusters(hashed_ids(embeddings(spark, sf_dir)), 0.3, 64), "similarity")


@query
def pca_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.positions(embeddings(spark, sf_dir), width=layout.PRESET_CANVAS, height=layout.PRESET_CANVAS)
    return placed.select("vec_id", "cluster_id", rounded("x").alias("x"), rounded("y").alias("y"))


@query
def pca_layout_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map on 80 by 20 cells."""
    placed = layout.on_grid(layout.positions(embeddings(spark, sf_dir), width=80, height=20))
    return placed.groupBy("x", "y").agg(F.count("*").alias("n"))


def first_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two entries as coordinates, as if cached."""
    return embeddings(spark, sf_dir).select("vec_id", F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y"))


@query
def cached_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(layout.to_canvas(first_two(spark, sf_dir), layout.PRESET_CANVAS, layout.PRESET_CANVAS, cached=True), "x", "y")


@query
def position_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layout.bounds(first_two(spark, sf_dir))
    return round_all(b, *b.columns)


@query
def cluster_scatter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as clusters; places by the first two entries, centroids as further rows."""
    df = embeddings(spark, sf_dir).withColumnRenamed("label", "cluster_id")
    rows = df.select("vec_id", "cluster_id", F.lit(False).alias("is_centroid"), F.col("vector").cast("array<double>").alias("vector"))
    middle = clustering.centroids(df, "cluster_id").select(F.lit(None).cast("long").alias("vec_id"), "cluster_id", F.lit(True).alias("is_centroid"), F.col("centroid").alias("vector"))
    flat = rows.unionByName(middle).select("vec_id", "cluster_id", "is_centroid", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))
    return round_all(layout.scatter_summary(layout.to_canvas(flat)), "x", "y")


@query
def images_of_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions without centroids, and what is shown for each."""
    df = first_two(spark, sf_dir).withColumn("is_centroid", F.col("vec_id") % 10 == 0)
    thumb = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("t"), F.col("vec_id").cast("string")))
    return layout.images_only(df).select("vec_id", paths.display_path(thumb, F.concat(F.lit("f"), F.col("vec_id").cast("string"))).alias("shown"))


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up file paths from part names; the extension goes round with the size."""
    ends = F.array(*(F.lit(x) for x in (".JPG", ".jpeg", ".gif", ".png", ".bmp", ".txt", "", ".tar.gz")))
    name = F.concat(F.lit("C:\\Photos\\"), F.col("p_type"), F.lit("/"), F.col("p_name"), ends[F.col("p_size") % 8])
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("file_path"), F.col("p_size").alias("p_size"))


@query
def image_file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_path")
    return part_paths(spark, sf_dir).filter(paths.is_image(p)).select("p_partkey", paths.extension(p).alias("extension"))


@query
def file_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_paths(spark, sf_dir).select("p_partkey", paths.base_name(F.col("file_path")).alias("name"), paths.is_blank(F.col("file_path")).alias("blank"))


@query
def thumb_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_paths(spark, sf_dir).select("p_partkey", paths.path_key(F.col("file_path")).alias("key"), paths.thumbnail_path("/thumbs", F.col("file_path")).alias("thumbnail_path"))


@query
def size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", paths.size_text(F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") * 997)).alias("size_text"))


@query
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are not yet known, where the known ones are those of the benchmark's ids."""
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"))
    return files.unseen(table(spark, sf_dir, "pages").select("page_id", "url"), known, ("page_id",))


@query
def already_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"))
    return files.seen(table(spark, sf_dir, "pages").select("page_id", "url"), known, ("page_id",))


@query
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of nations, put in over each other by nation and segment: the last one wins."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name")
    old, new = rows.filter("c_nationkey < 15"), rows.filter("c_nationkey >= 10")
    keys = ["c_nationkey", "c_mktsegment"]
    return store.upsert(store.last_by_key(old, keys, "c_custkey"), new, keys, "c_custkey")


@query
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is saved, saved again in part, given places in part, and read back."""
    df = embeddings(spark, sf_dir)
    null = lambda kind: F.lit(None).cast(kind)
    rows = df.select("vec_id", F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("file_path"), "vector", F.lit("embedding").alias("vector_type"), F.current_timestamp().alias("processed_at"), F.lit(0).cast("long").alias("file_size"), null("string").alias("thumbnail_path"), null("float").alias("pca_x"), null("float").alias("pca_y"))
    kept = store.VectorStore(spark, fresh_path(spark))
    kept.save(rows)
    kept.save(rows.filter("vec_id % 3 = 0").withColumn("file_size", F.col("vec_id")))
    kept.save_layout(first_two(spark, sf_dir).filter("vec_id % 2 = 0").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("file_path"), "x", "y"))
    kept.save(rows.filter("vec_id % 7 = 0").withColumn("file_size", F.lit(-1).cast("long")))
    return kept.read().select("vec_id", "file_path", "file_size", F.size("vector").alias("dims"), F.round(F.coalesce(F.col("pca_x").cast("double"), F.lit(9.0)), DIGITS).alias("pca_x"), F.col("pca_y").isNull().alias("unplaced"))


@query
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that have several of the events whose number five divides."""
    return store.violations(table(spark, sf_dir, "events").filter("event_id % 5 = 0"), "user_id")


@query
def pca_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates for two of three vectors; the others keep theirs."""
    old = embeddings(spark, sf_dir).select("vec_id", F.col("label").cast("float").alias("pca_x"), F.lit(None).cast("float").alias("pca_y"))
    new = first_two(spark, sf_dir).filter("vec_id % 3 <> 0")
    out = store.with_layout(old, new, "vec_id")
    return out.select("vec_id", rounded(F.col("pca_x").cast("double")).alias("pca_x"), rounded(F.col("pca_y").cast("double")).alias("pca_y"))


@query
def pca_cache_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = first_two(spark, sf_dir).withColumnsRenamed({"x": "pca_x", "y": "pca_y"})
    half = df.withColumn("pca_y", F.when(F.col("vec_id") % 2 == 0, F.col("pca_y")))
    return store.layout_complete(df).withColumn("rows", F.lit("all")).unionByName(store.layout_complete(half).withColumn("rows", F.lit("half"))).unionByName(store.layout_complete(df.filter("vec_id < 0")).withColumn("rows", F.lit("none")))


@query
def point_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fetch_key(embeddings(spark, sf_dir), "vec_id", 7).select("vec_id", "label")


@query
def scan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files: views are skipped, every eleventh fails."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("current_file"), (F.col("user_id") % 4 == 0).alias("skipped"), (F.col("event_id") % 11 == 0).alias("failed"))
    return round_all(scan_progress(e), "pct")


@query
def softmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vector")
    return embeddings(spark, sf_dir).select("vec_id", vectors.arg_max(v).alias("label_index"), rounded(F.array_max(vectors.softmax(v))).alias("probability"))


@query
def normalized_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5 % 256).cast("double").alias("p"))
    return p.select("p_partkey", *(rounded(images.normalize_channel(F.col("p"), i)).alias(n) for i, n in enumerate(("red", "green", "blue"))))


@query
def vector_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as text; numbers in thousandths, as engines differ in how they write other ones."""
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * 1000).cast("long"))
    return embeddings(spark, sf_dir).select("vec_id", vectors.dump(whole).alias("line"))


@query
def first_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one key only the first takes part in clustering."""
    return clustering.first_by_key(embeddings(spark, sf_dir).withColumn("file_path", F.floor(F.col("vec_id") / 3)), "file_path").select("vec_id", "file_path")
