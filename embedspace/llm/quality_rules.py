"""Quality rules with adaptive thresholds.

Every document gets a few metrics. For each language and source a mergeable quantile sketch
(logarithmic buckets of 64 steps an octave, so within 1/64 of the true value; two sketches merge
by adding their counts) holds each metric's distribution. A fence lies beyond the group's median
by a multiple of the distance from there to an outer quintile, so that a fifth of bad rows does
not move it; that distance counts as one step of the sketch at least, as less can't be told. No
fence has a fixed place or width. Quantiles are drawn towards those of the language's merged
sketch, and these towards those of all rows, the more so the fewer rows a group has. The fences
are joined back to the documents.

Edge cases: null text counts as empty, so base_failed is true. Null language or source is a group
of its own. Every row is judged by itself: repeated rows get the same verdict. A value equal to a
fence is within it. Very long texts are measured whole, in one row. An empty table gives an empty
result. Other columns are passed on or ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import WORD_CHAR, let, materialize, words_of

WINDOW = 5
#: ASCII punctuation.
MARKS = r"[!-/:-@\[-`{-~]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityConfig:
    """Fences: a metric is an outlier beyond the median by more than `reach` times the distance of median and outer quintile."""

    reach: int = 8
    #: Rows that a merged sketch's quantiles count as, in the mean with the group's own.
    weight: int = 25
    #: metric: has a lower fence too
    metrics: dict[str, bool] = field(default_factory=lambda: {"word_length": True, "marks": False, "shouting": False})


#: Quantiles of a sketch, as fractions.
QUANTILES = {"low": (1, 5), "mid": (1, 2), "high": (4, 5)}
#: Shrunk quantiles are whole numbers of this part of a unit.
PART = 64


def repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more in the text, told apart by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])
            return F.array_sort(F.array_compact(F.transform(s, lambda e, k: F.when(same(e, k), e["p"]))))

        steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        ranked = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        some = let(let(ranked, places), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(some)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    return F.when(F.size(words) > WINDOW, let(hashes, covered)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """Struct of the base counts and three more, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    long = lambda c, name: c.cast("long").alias(name)
    return F.struct(
        let(words_of(text), lambda w: F.struct(long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(repeat_words(w), "n_repeat_words"))).alias("w"),
        long(F.regexp_count(text, F.lit("[#*$%&|<>]")), "n_symbols"),
        long(F.regexp_count(text, F.lit(MARKS)), "n_marks"),
        long(F.regexp_count(text, F.lit("[A-Z!]")), "n_shouts"),
        let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"))).alias("l"),
    )


def bucket(value: Column) -> Column:
    """Bucket of a whole number from 0; exact below 128."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.when(value < 64, value).otherwise(F.expr("0") + shift * 64 + F.call_function("shiftright", value, shift))


def bucket_floor(b: Column) -> Column:
    """Least value of a bucket."""
    shift = F.greatest(F.floor(b / 64).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", b - shift * 64, shift)


def per(part: Column, scale: int, whole: Column) -> Column:
    return F.floor(part * scale / F.greatest(whole, F.lit(1))).cast("long")


def score(docs: DataFrame, keys: list[Column]) -> DataFrame:
    """keys, lang, source, the measures and the metrics of every row."""
    out = docs.select(*keys, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), measures(F.col("text")).alias("m"))
    out = out.select(*[c for c in out.columns if c != "m"], "m.w.*", "m.n_symbols", "m.n_marks", "m.n_shouts", "m.l.*")
    n, chars = F.col("n_words"), F.col("word_chars")
    return out.withColumns({
        "word_length": per(chars, 100, n), "marks": per(F.col("n_marks"), 1000, chars), "shouting": per(F.col("n_shouts"), 1000, chars),
        "base_failed": (n < 10) | (100 * F.col("n_repeat_words") > 20 * n),
    })


def sketches(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """(lang, source, metric, bucket, n): one sketch for each language, source and metric, of rows that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).cast("int").alias("bucket")) for m in metrics)))
    return scored.filter(~F.col("base_failed")).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def level_sql(keys: str, source: str) -> str:
    """Quantiles (as buckets) of the sketches that are merged by keys; the same text in both dialects."""
    picks = ", ".join(f"min(case when cum * {b} >= total * {a} then bucket end) {name}" for name, (a, b) in QUANTILES.items())
    return f"""select {keys} metric, max(total) total, {picks}
        from (select {keys} metric, bucket, sum(n) over (partition by {keys} metric order by bucket) cum, sum(n) over (partition by {keys} metric) total
              from (select {keys} metric, bucket, sum(n) n from {source} group by {keys} metric, bucket)) group by {keys} metric"""


def fences(sketch: DataFrame, config: QualityConfig) -> DataFrame:
    """(lang, source, lows, highs): maps from metric to fence, in parts of a unit. Sketches merge upwards: source to language to all."""
    sketch.createOrReplaceTempView(view := f"sketch_{id(sketch)}")
    spark = sketch.sparkSession
    try:
        own, lang, everything = (spark.sql(level_sql(k, view)) for k in ("lang, source,", "lang,", ""))
    finally:
        spark.catalog.dropTempView(view)
    own = own.alias("o").join(lang.alias("l"), F.expr("o.lang <=> l.lang and o.metric = l.metric")).join(F.broadcast(everything).alias("e"), F.expr("o.metric = e.metric"))  # a row for each metric
    whole = lambda x, y: F.call_function("div", x.cast("long"), y.cast("long"))
    place = lambda at, q: bucket_floor(F.col(f"{at}.{q}")) * PART
    toward = lambda at, q, merged: whole(F.col(f"{at}.total") * place(at, q) + config.weight * merged, F.col(f"{at}.total") + config.weight)
    own = own.select("o.lang", "o.source", "o.metric", *(toward("o", q, toward("l", q, place("e", q))).alias(q) for q in QUANTILES))
    step = PART + whole(F.col("mid"), F.lit(PART))
    high = F.col("mid") + config.reach * F.greatest(F.col("high") - F.col("mid"), step)
    low = F.col("mid") - config.reach * F.greatest(F.col("mid") - F.col("low"), step)
    both = (F.struct(F.col("metric").alias("k"), x.cast("long").alias("v")) for x in (low, high))
    return own.groupBy("lang", "source").agg(*(F.map_from_entries(F.collect_list(x)).alias(name) for x, name in zip(both, ("lows", "highs"), strict=True)))


def judge(scored: DataFrame, config: QualityConfig) -> DataFrame:
    """scored (materialised by the caller) with kept: passes the base rules and lies within its group's fences."""
    limits = materialize(fences(materialize(sketches(scored, list(config.metrics))), config))
    limits = limits.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), "lows", "highs")
    out = scored.join(limits, F.expr("lang <=> __l and source <=> __s"), "left")
    odd = F.lit(False)
    for m, low in config.metrics.items():
        odd = odd | F.coalesce(F.col(m) * PART > F.col("highs")[m], F.lit(False))
        odd = odd | F.coalesce(F.col(m) * PART < F.col("lows")[m], F.lit(False)) if low else odd
    return out.withColumn("kept", ~F.col("base_failed") & ~odd).drop("__l", "__s", "lows", "highs")


def quality_verdicts(docs: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """One row for each document: doc_id, the measures, base_failed and kept."""
    config = config or QualityConfig()
    out = judge(materialize(score(docs, [F.col("doc_id")])), config)
    return out.select("doc_id", *BASE, "base_failed", "kept", *config.metrics)


def quality_filter(docs: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """The documents that are kept, with all their columns."""
    config = config or QualityConfig()
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    out = judge(materialize(score(docs, [whole])), config)
    return out.filter("kept").select("doc.*")


def oracle(config: QualityConfig | None = None) -> str:
    """The same by plain SQL."""
    config = config or QualityConfig()
    ms = list(config.metrics)
    place = lambda x: f"(case when {x} < 128 then {x} else ({x} - ({x} // 64 - 1) * 64) << ({x} // 64 - 1) end) * {PART}"
    toward = lambda at, q, merged: f"(({at}.total * {place(f'{at}.{q}')} + {config.weight} * {merged}) // ({at}.total + {config.weight}))"
    shrunk = ", ".join(f"{toward('o', q, toward('l', q, place(f'e.{q}')))} {q}" for q in QUANTILES)
    low = ", ".join(f"'{m}'" for m, has in config.metrics.items() if has)
    return rf"""
with d as (select row_number() over () rid, *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from documents),
win as (select rid, i, array_to_string(w[i:i + 4], ' ') s from (select rid, w, unnest(range(1, len(w) - 3)) i from d)),
rep as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + 5)) p from (select *, count(*) over (partition by rid, s) c from win) where c > 1) group by rid),
m as (select d.rid, doc_id, lang, source, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint sy,
        (length(text) - length(regexp_replace(text, '{MARKS}', '', 'g')))::bigint mk, (length(text) - length(regexp_replace(text, '[A-Z!]', '', 'g')))::bigint sh,
        (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words from d left join rep using (rid)),
s as (select *, coalesce(sy, 0) n_symbols, word_chars * 100 // greatest(n_words, 1) word_length, coalesce(mk, 0) * 1000 // greatest(word_chars, 1) marks,
        coalesce(sh, 0) * 1000 // greatest(word_chars, 1) shouting, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m),
u as (unpivot (select rid, lang, source, base_failed, {", ".join(ms)} from s) on {", ".join(ms)} into name metric value v),
sk as (select lang, source, metric, bucket, count(*) n from (select *, case when v < 64 then v else greatest(length(bin(v)) - 7, 0) * 64 + (v >> greatest(length(bin(v)) - 7, 0)) end bucket from u where not base_failed) group by all),
own as ({level_sql("lang, source,", "sk")}), bylang as ({level_sql("lang,", "sk")}), everything as ({level_sql("", "sk")}),
f as (select o.lang, o.source, o.metric, {shrunk} from own o join bylang l on o.lang is not distinct from l.lang and o.metric = l.metric join everything e on o.metric = e.metric),
odd as (select distinct u.rid from u join f on u.lang is not distinct from f.lang and u.source is not distinct from f.source and u.metric = f.metric
        where v * {PART} > mid + {config.reach} * greatest(high - mid, {PART} + mid // {PART}) or u.metric in ({low}) and v * {PART} < mid - {config.reach} * greatest(mid - low, {PART} + mid // {PART}))
select doc_id, {", ".join(BASE)}, base_failed, not base_failed and odd.rid is null kept, {", ".join(ms)} from s left join odd using (rid)"""
