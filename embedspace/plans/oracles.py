"""SQL for the queries, in DuckDB's dialect."""

from __future__ import annotations

E = "e as (select vec_id, label, embedding::double[] v from embeddings)"
SIM = "list_cosine_similarity({a}, {b})"


#: The same rows as E, with ids that are mixed over all longs.
HASHED = "e as (select ((vec_id::hugeint * 11400714819323198485) % 18446744073709551616 - 9223372036854775808)::bigint vec_id, label, embedding::double[] v from embeddings)"


def clusters(threshold: float, e: str = E) -> str:
    """CTEs up to assigned(vec_id, cluster_id, is_seed, similarity): seeds one after another, in a recursive state row."""
    return f"""
{e}, o as (select row_number() over (order by vec_id) i, vec_id, v from e),
near as materialized (select b.i, list(a.i order by a.i) before from o a join o b on a.i < b.i and {SIM.format(a="a.v", b="b.v")} >= {threshold} group by b.i),
walk as (select 0::bigint i, []::bigint[] seeds union all
    select walk.i + 1, case when list_has_any(walk.seeds, coalesce((select before from near where near.i = walk.i + 1), []::bigint[])) then walk.seeds else list_append(walk.seeds, walk.i + 1) end
    from walk where walk.i < (select count(*) from o)),
seeds as (select unnest(seeds) seed, unnest(range(len(seeds))) cluster_id from walk where i = (select count(*) from o)),
pick as (select o.i, min(s.seed) seed from o join seeds s on s.seed = o.i or list_contains((select before from near where near.i = o.i), s.seed) group by o.i),
best as (select o.i, coalesce(own.seed, pick.seed) seed from o left join seeds own on own.seed = o.i join pick on pick.i = o.i),
assigned as (select o.vec_id, s.cluster_id::int cluster_id, best.i = best.seed is_seed, case when best.i = best.seed then 1.0 else {SIM.format(a="o.v", b="x.v")} end similarity
    from best join o on o.i = best.i join o x on x.i = best.seed join seeds s on s.seed = best.seed)"""


def axes(steps: int = 14, rows: str = "e") -> str:
    """CTEs up to scores(vec_id, x, y) of rows(vec_id, v): principal axes by repeated squaring of the scatter matrix, then of what is left of it."""
    norm = lambda m: f"(select sqrt(sum(v * v)) from {m})"
    out = f"""{E + ', ' if rows == 'e' else ''}u as (select vec_id, unnest(range(64)) i, unnest(v) v from {rows}), mu as (select i, avg(v) m from u group by i),
c as materialized (select vec_id, u.i, v - m v from u join mu using (i)), s0 as materialized (select a.i, b.i j, sum(a.v * b.v) v from c a join c b using (vec_id) group by all)"""
    for k, letter in ((1, "p"), (2, "q")):
        out += f", {letter}0 as materialized (select i, j, v / {norm(f's{k - 1}')} v from s{k - 1})"
        for t in range(1, steps + 1):
            m = f"{letter}{t - 1}"
            out += f", {letter}r{t} as materialized (select a.i, b.j, sum(a.v * b.v) v from {m} a join {m} b on a.j = b.i group by all), {letter}{t} as materialized (select i, j, v / {norm(f'{letter}r{t}')} v from {letter}r{t})"
        m = f"{letter}{steps}"
        out += f""", w{k} as materialized (select i, v / (select sqrt(sum(v * v)) from {m} where j = d) v from {m}, (select i d from {m} where i = j order by v desc limit 1) where j = d),
v{k} as materialized (select i, v * (select sign(arg_max(v, abs(v))) from w{k}) v from w{k}), l{k} as (select sum(s.v * a.v * b.v) l from s{k - 1} s join v{k} a on s.i = a.i join v{k} b on s.j = b.i),
s{k} as materialized (select s.i, s.j, s.v - l * a.v * b.v v from s{k - 1} s join v{k} a on s.i = a.i join v{k} b on s.j = b.i, l{k})"""
    return out + ", scores as materialized (select vec_id, sum(c.v * v1.v) x, sum(c.v * v2.v) y from c join v1 using (i) join v2 using (i) group by vec_id)"


def canvas(source: str, width: float, height: float, cached: bool = False) -> str:
    """Coordinates of source(x, y) on a canvas as columns px, py, with all columns of source."""
    span = (lambda c: f"greatest(max({c}) over () - min({c}) over (), 1e-4)") if cached else (lambda c: f"case when max({c}) over () - min({c}) over () < 1e-4 then 1.0 else max({c}) over () - min({c}) over () end")
    return ", ".join(["*", *(f"({c} - min({c}) over ()) / ({span(c)}) * {size * 0.9} + {size * 0.05} p{c}" for c, size in (("x", width), ("y", height)))]).join(("(select ", f" from {source})"))


TWO = "(select vec_id, label, embedding[1]::double x, embedding[2]::double y from embeddings)"
#: Vectors and centroids of the clusters at 0.3 as rows(vec_id, v): row numbers, of centroids negative ones, and where they are on one map.
CLUSTER_ROWS = f"""{clusters(0.3)}, w as (select cluster_id, unnest(range(len(v))) dim, unnest(v) x from assigned join e using (vec_id)), m as (select cluster_id, dim, avg(x) x from w group by all),
rows_ as (select vec_id, v from e union all select -1 - cluster_id, list(x order by dim) from m group by cluster_id), {axes(rows="rows_")},
placed as (select s.vec_id::bigint vec_id, coalesce(assigned.cluster_id, -1 - s.vec_id)::int cluster_id, s.vec_id < 0 is_centroid, round(px, 4) x, round(py, 4) y
    from {canvas("scores", 1000, 1000)} s left join assigned using (vec_id))"""
PATHS = r"p as (select p_partkey, 'C:\Photos\' || p_type || '/' || p_name || ['.JPG', '.jpeg', '.gif', '.png', '.bmp', '.txt', '', '.tar.gz'][p_size % 8 + 1] f from part)"

ORACLES: dict[str, str] = {
    "leader_clusters_t03": f"with recursive {clusters(0.3)} select vec_id, cluster_id, is_seed, round(similarity, 6) similarity from assigned",
    "leader_clusters_t05": f"with recursive {clusters(0.5)} select vec_id, cluster_id, is_seed, round(similarity, 6) similarity from assigned",
    "similarity_to_anchor": f"with {E}, a as (select v w from e order by vec_id limit 1) select vec_id, round({SIM.format(a='w', b='v')}, 6) similarity from e, a where vec_id <> (select min(vec_id) from e)",
    "vector_norms": f"with {E} select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) norm, round(list_dot_product(v, list_reverse(v)), 6) dot_reversed from e",
    "similar_pairs_t03": f"with {E}, s as (select a.vec_id a, b.vec_id b, {SIM.format(a='a.v', b='b.v')} similarity from e a join e b on a.vec_id < b.vec_id) select a, b, round(similarity, 6) similarity from s where similarity >= 0.3",
    "topk_sparse": f"with {E}, u as (select vec_id, unnest(range(len(v)))::int dim, unnest(v) val from e), r as (select *, row_number() over (partition by vec_id order by val desc, dim) k from u) select vec_id, dim, round(val, 6) val from r where k <= 10",
    "sparse_similarity_to_anchor": f"with {E}, u as (select vec_id, unnest(range(len(v)))::int dim, unnest(v) val from e), r as (select *, row_number() over (partition by vec_id order by val desc, dim) k from u), t as (select * from r where k <= 10), a as (select * from t where vec_id = (select min(vec_id) from e)) select t.vec_id, round(coalesce(sum(t.val * a.val), 0) / (sqrt(sum(t.val * t.val)) * (select sqrt(sum(val * val)) from a)), 6) similarity from t left join a using (dim) where t.vec_id <> (select min(vec_id) from e) group by t.vec_id",
    "cluster_sizes": f"with recursive {clusters(0.3)} select cluster_id, count(*) image_count from assigned group by cluster_id",
    "cluster_centroids": f"with recursive {clusters(0.3)}, u as (select cluster_id, unnest(range(len(v)))::int dim, unnest(v) x from assigned join e using (vec_id)) select cluster_id, dim, round(avg(x), 6) \"value\" from u group by all",
    "label_centroids": f"with {E}, u as (select label, unnest(range(len(v)))::int dim, unnest(v) x from e) select label, dim, round(avg(x), 6) \"value\" from u group by all",
    "column_means": f"with {E}, u as (select unnest(range(len(v)))::int dim, unnest(v) x from e) select dim, round(avg(x), 6) mean from u group by dim",
    "centered_moments": f"with {E}, u as (select unnest(range(len(v)))::int dim, unnest(v) x from e), m as (select dim, avg(x) m from u group by dim) select dim, round(sum((x - m) * (x - m)), 6) moment from u join m using (dim) group by dim",
    "pca_scores": f"with {axes()} select vec_id, round(x, 6) x, round(y, 6) y from scores",
    "pca_scores_1d": f"with {axes()} select vec_id, round(x, 6) x from scores",
    "singular_values": f"with {axes()} select 0::int axis, round(sqrt(l), 6) singular_value from l1 union all select 1::int, round(sqrt(l), 6) from l2",
    "cluster_positions": f"with recursive {CLUSTER_ROWS} select * from placed",
    "cluster_map": f"with recursive {CLUSTER_ROWS} select cluster_id, max(x) filter (is_centroid) x, max(y) filter (is_centroid) y, count(*) filter (not is_centroid) image_count from placed group by cluster_id",
    "leader_clusters_hashed_ids": f"with recursive {clusters(0.3, HASHED)} select vec_id, cluster_id, is_seed, round(similarity, 6) similarity from assigned",
    "vector_dump": "select vec_id, array_to_string(list_transform(embedding, lambda x: floor(x::double * 1000)::bigint), ' ') line from embeddings",
    "pca_layout": f"with {axes()} select vec_id, 0::int cluster_id, round(px, 6) x, round(py, 6) y from {canvas('scores', 1000, 1000)}",
    "pca_layout_grid": f"with {axes()} select trunc(px)::int x, trunc(py)::int y, count(*) n from {canvas('scores', 80, 20)} group by all",
    "cached_layout": f"select vec_id, round(px, 6) x, round(py, 6) y from {canvas(TWO, 1000, 1000, True)}",
    "position_bounds": f"select round(min(x), 6) min_x, round(max(x), 6) max_x, round(min(y), 6) min_y, round(max(y), 6) max_y from {TWO}",
    "cluster_scatter_summary": f"with t as (select vec_id, label, x, y, false c from {TWO}), m as (select null vec_id, label, avg(x) x, avg(y) y, true c from t group by label), u as (select * from t union all select * from m) select label cluster_id, round(max(px) filter (c), 6) x, round(max(py) filter (c), 6) y, count(*) filter (not c) image_count from {canvas('u', 10000, 10000)} group by label",
    "images_of_positions": "select vec_id, case when vec_id % 3 = 0 then 't' || vec_id else 'f' || vec_id end shown from embeddings where vec_id % 10 <> 0",
    "image_file_filter": rf"with {PATHS}, x as (select p_partkey, lower(regexp_extract(f, '(\.[^./\\]+)$', 1)) extension from p) select * from x where extension in ('.jpg', '.jpeg', '.gif', '.png', '.bmp')",
    "file_basename": rf"with {PATHS} select p_partkey, list_extract(regexp_split_to_array(f, '[/\\]'), -1) \"name\", trim(f) = '' blank from p".replace('\\"', '"'),
    "thumb_key": f"with {PATHS} select p_partkey, substr(sha256(lower(f)), 1, 32) \"key\", '/thumbs/' || substr(sha256(lower(f)), 1, 32) || '.jpg' thumbnail_path from p",
    "size_text": "with x as (select doc_id, case when doc_id % 7 <> 0 then n_chars * 997 end n from documents) select doc_id, case when n is null then '0 KB' when n >= 1048576 then printf('%.1f MB', floor(n / 1048576.0::double * 10 + 0.5) / 10) else printf('%.0f KB', floor(n / 1024.0::double + 0.5)) end size_text from x",
    "incremental_scan": "select page_id, url from pages where page_id not in (select item_id from benchmark)",
    "already_seen": "select page_id, url from pages where page_id in (select item_id from benchmark)",
    "store_upsert": "with old as (select * from customer where c_nationkey < 15), new as (select * from customer where c_nationkey >= 10), lo as (select c_nationkey, c_mktsegment, max(c_custkey) c_custkey from old group by all), ln as (select c_nationkey, c_mktsegment, max(c_custkey) c_custkey from new group by all), k as (select * from ln union all select * from lo where (c_nationkey, c_mktsegment) not in (select (c_nationkey, c_mktsegment) from ln)) select c_nationkey, c_mktsegment, c_custkey, c_name from k join customer using (c_nationkey, c_mktsegment, c_custkey)",
    "store_round_trip": "select vec_id, 'p' || vec_id file_path, case when vec_id % 7 = 0 then -1 when vec_id % 3 = 0 then vec_id else 0 end::bigint file_size, len(embedding)::int dims, round(case when vec_id % 2 = 0 and vec_id % 7 <> 0 then embedding[1]::double else 9.0::double end, 6) pca_x, not (vec_id % 2 = 0 and vec_id % 7 <> 0) unplaced from embeddings",
    "unique_violations": "select user_id, count(*) n from events where event_id % 5 = 0 group by user_id having count(*) > 1",
    "pca_update": "select vec_id, round(case when vec_id % 3 <> 0 then embedding[1]::double else label::double end, 6) pca_x, round(case when vec_id % 3 <> 0 then embedding[2]::double end, 6) pca_y from embeddings",
    "pca_cache_complete": "select * from (values (true, 'all'), ((select count(*) filter (vec_id % 2 = 1) = 0 from embeddings), 'half'), (true, 'none')) t(complete, \"rows\")",
    "point_fetch": "select vec_id, label from embeddings where vec_id = 7",
    "scan_steps": "with x as (select event_id seq, 'f' || event_id current_file, user_id % 4 = 0 skipped, event_id % 11 = 0 failed from events), y as (select *, sum(case when failed then 0 else 1 end) over (order by seq)::bigint processed_count, count(*) over () total_count from x) select seq, current_file, processed_count, total_count, round(processed_count::double / total_count::double * 100.0, 6) pct from y where not skipped and not failed",
    "softmax_label": f"with {E}, x as (select vec_id, v, list_max(v) top from e) select vec_id, (list_position(v, top) - 1)::int label_index, round(1.0 / list_sum(list_transform(v, lambda y: exp(y - top))), 6) probability from x",
    "normalized_pixels": "with x as (select p_partkey, (p_size * 5 % 256)::double p from part) select p_partkey, round((p / 255.0::double - 0.485::double) / 0.229::double, 6) red, round((p / 255.0::double - 0.456::double) / 0.224::double, 6) green, round((p / 255.0::double - 0.406::double) / 0.225::double, 6) blue from x",
    "first_of_duplicates": "select min(vec_id) vec_id, (vec_id // 3)::bigint file_path from embeddings group by 2",
}
