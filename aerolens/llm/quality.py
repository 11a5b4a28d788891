"""Operator 1: quality rules with adaptive thresholds. DataFrame functions only.

A first pass measures every whole text. Integer measures (per mille or hundredths) go
into mergeable quantile sketches: log-linear histograms whose buckets keep five
significant bits, so any quantile is right to 1/32, and merging is adding counts, in any
order, with the same result after a lost executor. There is one sketch per (language, source), per
language and of all documents. A threshold lies SPREADS spreads above the median. The second
pass joins the documents with their group's thresholds and filters.

Junk must not move the thresholds: the spread is the inter-quartile range, but at most twice the
median less the lower quartile, which holds up to half a group of junk; and a group's
threshold lies no further above its own lower quartile than its language's does, which
holds up to three quarters, while the language has under a half. Small groups say little: a
group's threshold is the mean of its own, weighted by its documents, and its language's, weighted
by PRIOR_DOCS; the language's likewise with that of all.

Groups may be hot: sketches are pre-aggregated before the shuffle, and the join goes by
common.lookup_join.

Defined cases: a null text has no words; texts under 50 words fail by contract; null
lang or source counts as ''; rows that repeat are measured each for itself; an empty
table gives an empty result; of other columns nothing is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common
from .common import let

MIN_WORDS = 50
#: Documents that the wider group counts for in a threshold.
PRIOR_DOCS = 20
SPREADS = 6
#: Measures and the least slack above the median (in the measure's unit), where the quartiles coincide.
MEASURES = {"symbols": 20, "marks": 40, "capitals": 60, "dup_lines": 500, "repeats": 400, "word_length": 150}


def n_repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the array."""

    def of_windows(h: Column) -> Column:
        def covered(z: Column) -> Column:
            twice = F.filter(z, lambda e, j: (e["h"] == F.get(z, j - 1)["h"]) | (e["h"] == F.get(z, j + 1)["h"]))
            places = F.array_sort(F.transform(twice, lambda e: e["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

        found = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(0)

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))))
    return let(hashes, of_windows)


def _left(text: Column, pattern: str) -> Column:
    """Code points of text in the class that pattern's complement deletes."""
    return F.length(F.regexp_replace(text, pattern, ""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    from_words = lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), n_repeat_words(w).alias("n_repeat_words"))
    from_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    rows = base.select(
        "doc_id", "lang", "source",
        let(F.array_remove(F.split("text", common.SPACES), ""), from_words).alias("w"),
        let(lines, from_lines).alias("l"),
        _left(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        _left(F.col("text"), r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+").alias("n_marks"),
        _left(F.col("text"), r"[^\p{Lu}]+").alias("n_capitals"),
    )
    longs = lambda *names: [F.col(c).cast("long").alias(c.split(".")[-1]) for c in names]
    return rows.select("doc_id", "lang", "source", *longs("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_marks", "n_capitals"))


def _measures() -> dict[str, Column]:
    whole = lambda a, b, of=1000: F.expr(f"({of} * {a}) div greatest({b}, 1)")
    return {"symbols": whole("n_symbols", "word_chars"), "marks": whole("n_marks", "word_chars"), "capitals": whole("n_capitals", "word_chars"), "dup_lines": whole("n_dup_lines", "n_lines"), "repeats": whole("n_repeat_words", "n_words"), "word_length": whole("word_chars", "n_words", 100)}


def bucket(value: Column) -> Column:
    """Lower bound of value's bucket: its five leading bits. Values are whole and not negative."""
    cut = F.greatest(F.length(F.bin(value)) - 5, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(measures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, measure, bucket, count: sketches of every (lang, source), of every lang and of all."""
    long = measures.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("x")).select(*keys, "x.*")
    fine = long.groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("count"))
    fine = fine.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    kept = [F.when(F.col("level") <= len(keys) - 1 - i, F.col(k)).alias(k) for i, k in enumerate(keys)]
    return fine.select("level", *kept, "measure", "bucket", "count").groupBy("level", *keys, "measure", "bucket").agg(F.sum("count").alias("count"))


def quantiles(sketch: DataFrame, by: list[str], points: tuple[int, ...] = (25, 50, 75)) -> DataFrame:
    """q25, q50, q75 (bucket bounds) and n of each sketch; one sketch has under 2,000 buckets."""
    window = Window.partitionBy(*by)
    ran = sketch.withColumn("below", F.sum("count").over(window.orderBy("bucket"))).withColumn("n", F.sum("count").over(window))
    return ran.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("below") * 100 >= F.col("n") * q, F.col("bucket"))).alias(f"q{q}") for q in points])


def thresholds(measures: DataFrame) -> DataFrame:
    """lang, source and max_<measure>: one row per group."""
    sketch = common.materialise(sketches(measures, ["lang", "source"]), "sketches")
    q = quantiles(sketch, ["level", "lang", "source", "measure"])
    slack = F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair])
    spread = F.least(F.col("q75") - F.col("q25"), 2 * (F.col("q50") - F.col("q25")))
    q = q.withColumn("most", F.col("q50") + F.greatest(F.lit(SPREADS) * spread, slack[F.col("measure")]))
    wide = common.materialise(q.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("measure") == m, F.col(of))).alias(f"{name}_{m}") for of, name in (("most", "max"), ("q25", "low")) for m in MEASURES]), "thresholds")
    names = [f"max_{m}" for m in MEASURES]
    lows = [f"low_{m}" for m in MEASURES]
    pick = lambda level: wide.where(F.col("level") == level).select("lang", "source", F.struct("n", *names, *lows).alias(f"t{level}"))
    joined = pick(0).join(pick(1).drop("source"), "lang").join(F.broadcast(pick(2).drop("lang", "source")), F.lit(True))
    limits = []
    for m in MEASURES:
        own = f"least(t0.max_{m}, t0.low_{m} + t1.max_{m} - t1.low_{m})"
        language = f"((t1.n * t1.max_{m} + {PRIOR_DOCS} * t2.max_{m}) div (t1.n + {PRIOR_DOCS}))"
        limits.append(F.expr(f"(t0.n * {own} + {PRIOR_DOCS} * {language}) div (t0.n + {PRIOR_DOCS})").alias(f"max_{m}"))
    return joined.select("lang", "source", *limits)


def quality(docs: DataFrame) -> DataFrame:
    """The contract's counts, base_failed, kept, then the measures and their thresholds."""
    m = measured(docs)
    m = common.materialise(m.select("*", *[c.cast("long").alias(n) for n, c in _measures().items()]), "measures")
    with_words = m.where("n_words > 0")
    limits = common.materialise(thresholds(with_words), "limits")
    joined = common.lookup_join(m, limits, ["lang", "source"], F.col("doc_id"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = F.lit(True)
    for name in MEASURES:
        fits = fits & F.coalesce(F.col(name) <= F.col(f"max_{name}"), F.lit(True))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*counts, failed.alias("base_failed"), (~failed & fits).alias("kept"), *MEASURES, *[f"max_{n}" for n in MEASURES])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"))


_BUCKET = "(({0} >> greatest(length(bin({0})) - 5, 0)) << greatest(length(bin({0})) - 5, 0))"
OP1_SQL = rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
k as (select doc_id, unnest(ws) as x, unnest(range(len(ws))) as i from w where len(ws) > 2),
g as (select doc_id, i, x, lead(x, 1) over o as y, lead(x, 2) over o as z from k window o as (partition by doc_id order by i)),
h as (select doc_id, i, count(*) over (partition by doc_id, x, y, z) as c from g where z is not null),
r as (select doc_id, count(distinct p)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from h where c > 1) group by 1),
b as (select w.doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
  length(regexp_replace(text, '[\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]+', '', 'g'))::bigint as n_marks, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::bigint as n_capitals
  from w left join r on r.doc_id = w.doc_id),
m as (select *, (1000 * n_symbols) // greatest(word_chars, 1) as symbols, (1000 * n_marks) // greatest(word_chars, 1) as marks, (1000 * n_capitals) // greatest(word_chars, 1) as capitals,
  (1000 * n_dup_lines) // greatest(n_lines, 1) as dup_lines, (1000 * n_repeat_words) // greatest(n_words, 1) as repeats, (100 * word_chars) // greatest(n_words, 1) as word_length from b),
u as ({" union all ".join(f"select lang, source, '{n}' as measure, {s} as slack, {_BUCKET.format(n)} as bucket from m where n_words > 0" for n, s in MEASURES.items())}),
l as (select 0 as level, lang, source, measure, slack, bucket from u union all select 1, lang, null, measure, slack, bucket from u union all select 2, null, null, measure, slack, bucket from u),
q as (select level, lang, source, measure, max(slack) as slack, count(*) as n, quantile_disc(bucket, 0.25) as q25, quantile_disc(bucket, 0.5) as q50, quantile_disc(bucket, 0.75) as q75 from l group by all),
x as (select level, lang, source, max(n) as n, {", ".join(f"max(case when measure = '{n}' then q50 + greatest({SPREADS} * least(q75 - q25, 2 * (q50 - q25)), slack) end) as max_{n}, max(case when measure = '{n}' then q25 end) as low_{n}" for n in MEASURES)} from q group by all),
j as (select m.*, {", ".join(f"(t0.n * least(t0.max_{n}, t0.low_{n} + t1.max_{n} - t1.low_{n}) + {PRIOR_DOCS} * ((t1.n * t1.max_{n} + {PRIOR_DOCS} * t2.max_{n}) // (t1.n + {PRIOR_DOCS}))) // (t0.n + {PRIOR_DOCS}) as max_{n}" for n in MEASURES)},
  n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed
  from m left join x t0 on t0.level = 0 and t0.lang = m.lang and t0.source = m.source left join x t1 on t1.level = 1 and t1.lang = m.lang left join x t2 on t2.level = 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(f"coalesce({n} <= max_{n}, true)" for n in MEASURES)} as kept, {", ".join(MEASURES)}, {", ".join(f"max_{n}" for n in MEASURES)} from j
"""
