"""Removal of boilerplate lines by their spread over sites.

For each line that more than one site holds, HyperLogLog sketches of its sites, made in every
task, merge by aggregation. Lines whose estimate is close to the threshold get an exact distinct
count; the others are decided by the estimate. Of a boilerplate line the copies in the document
with the smallest doc_id stay, so that no text leaves the corpus altogether; all others go.

Edge cases: lines are split at \n and are equal when they are byte for byte; lines without a word
are never boilerplate. Null text is empty and stays null. Null sites together count as one site.
Null doc_ids come after all others. Of rows that share the smallest doc_id all keep the line.
Repeated rows are treated alike. Very long texts are split and joined in one row, in linear time.
An empty table gives an empty result. Other columns are passed on or ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import WORD_CHAR, let, materialize, text_key, with_text


@dataclass(frozen=True)
class LineConfig:
    #: A line on this many sites is boilerplate.
    min_sites: int = 6
    #: Base-2 logarithm of a sketch's slots: 4096 slots have a standard error of 1.6 %.
    log_k: int = 12
    #: Estimates within this share of the threshold are counted exactly: six standard errors.
    margin: float = 0.1


def line_keys(text: Column) -> Column:
    """For each line the two parts of its key, or null if it has no word."""
    key = lambda x: F.when(x.rlike(WORD_CHAR), F.struct(F.xxhash64(x).alias("h"), F.hash(x, F.lit(7)).alias("g")))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), key)


def boilerplate(lines: DataFrame, config: LineConfig) -> DataFrame:
    """(h, g, first_id) of lines(doc_id, site, h, g) that are on min_sites sites or more."""
    spread = lines.groupBy("h", "g").agg(F.min("doc_id").alias("first_id"), F.min("site").alias("a"), F.max("site").alias("b"), F.count("*").alias("n"))
    several = materialize(spread.filter((F.col("a") != F.col("b")) & (F.col("n") >= config.min_sites)).select("h", "g", "first_id"))
    wide = several.select("h", "g")
    sketch = lines.join(wide, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.hll_sketch_agg("site", config.log_k).alias("sketch"))
    about = materialize(several.join(sketch.select("h", "g", F.hll_sketch_estimate("sketch").alias("sites")), ["h", "g"]))
    near = F.abs(F.col("sites") - config.min_sites) <= F.lit(max(1.0, config.margin * config.min_sites))
    exact = lines.join(about.filter(near).select("h", "g"), ["h", "g"], "left_semi").groupBy("h", "g", "site").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.count("*").alias("exact"))
    out = about.join(exact, ["h", "g"], "left")
    sites = F.when(near, F.col("exact")).otherwise(F.col("sites"))
    return materialize(out.filter(sites >= config.min_sites).select("h", "g", "first_id"))


def removals(docs: DataFrame, config: LineConfig) -> DataFrame:
    """(doc_id, th, places): the 0-based lines that go, for each document that loses any."""
    base = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("site"), text_key(F.col("text")).alias("th"), line_keys(F.col("text")).alias("keys"))
    lines = materialize(base.select("doc_id", "site", "th", F.posexplode("keys").alias("place", "key")).filter("key is not null").select("doc_id", "site", "th", "place", "key.h", "key.g"))
    found = boilerplate(lines, config).select(F.col("h").alias("bh"), F.col("g").alias("bg"), "first_id")
    gone = lines.join(found, F.expr("h = bh and g = bg")).filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("place")).alias("places"))


def cut_lines(text: Column, places: Column) -> Column:
    """The text without the lines at these places; in linear time, as sets are subtracted by hash."""

    def kept(lines: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i))

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def line_changes(docs: DataFrame, config: LineConfig | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with n_lines, n_removed and new_text."""
    gone = removals(docs, config or LineConfig()).select(F.col("doc_id").alias("__es_id"), F.col("th").alias("__es_th"), "places")
    own = docs.select("doc_id", "text")
    out = own.join(gone, own["doc_id"].eqNullSafe(gone["__es_id"]) & (text_key(own["text"]) == gone["__es_th"]), "left")
    return out.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(cut_lines(F.col("text"), F.col("places"))).alias("new_text"),
    )


def line_dedup(docs: DataFrame, config: LineConfig | None = None) -> DataFrame:
    """The documents without their boilerplate lines, with all their columns."""
    gone = removals(docs, config or LineConfig()).select(F.col("doc_id").alias("__es_id"), F.col("th").alias("__es_th"), F.col("places").alias("__es_places"))
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__es_id"]) & (text_key(docs["text"]) == gone["__es_th"]), "left")
    return with_text(out, F.when(F.col("__es_places").isNull(), F.col("text")).otherwise(cut_lines(F.col("text"), F.col("__es_places")))).select(*docs.columns)


def oracle(config: LineConfig | None = None) -> str:
    config = config or LineConfig()
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(source, chr(1)) site, string_split(text, chr(10)) ls from documents),
l as (select rid, doc_id, site, unnest(range(1, len(ls) + 1)) i, unnest(ls) line from d),
b as (select line, min(doc_id) first_id from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by line having count(distinct site) >= {config.min_sites}),
k as (select rid, count(*) n, count(*) filter (b.line is not null and l.doc_id is distinct from first_id) gone,
        coalesce(string_agg(l.line, chr(10) order by i) filter (b.line is null or l.doc_id is not distinct from first_id), '') kept from l left join b using (line) group by rid)
select doc_id, coalesce(n, 0)::bigint n_lines, coalesce(gone, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (rid)"""
