"""Operator 9: near-duplicate lines by a deletion-neighbourhood join. DataFrame functions only.

A line is a \\n-separated part of a text; its words are compared, so white space does not
count. A letter of a script written without blanks counts as a word. A line with a word goes
if an earlier line anywhere in the table (by doc_id, then place in the text) is its exact copy.
Edit distance is over words: inserting, deleting or replacing one is one edit. A line of
NEAR_WORDS words or more that has MIN_WORDS words or NEAR_CHARS characters (without blanks)
also goes if an earlier such line is within one edit.

Exact copies meet by a 128-bit hash of their words. For the distinct lines:

* Two lines within one edit share their first or last half of words (the shorter one's
  half, rounded down). Half keys, shared by two or more lines, pick the lines that can
  have a partner at all; this is exact, and leaves few.
* Those emit their deletion neighbourhood: the line itself and the line without each of
  its words, hashed. Equal variants are joined; to stay linear where many lines share one,
  each variant's earliest lines answer for it: the earliest line of each (variant, deleted
  place) group is compared with the group's others, which finds every line that has an
  earlier partner (see near_lines).
* The edit distance of each pair met is verified: the words that both keep must be equal.

Lines are handled as strings of words with one blank between, by functions that Spark
compiles. Nothing is kept per document but the numbers of the lines to drop. Groups of copies of
any size are only pre-aggregated minima and joins that Spark can split.

Defined cases: null text stays null; a text whose lines all go becomes ''; lines without
words stay; rows without doc_id are left as they are, and rows repeating a doc_id count as
copies: a line of equal (doc_id, number) is not its own duplicate, so both keep it; an
empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

MIN_WORDS = 5
NEAR_WORDS = 3
NEAR_CHARS = 20
#: Letters of scripts that don't part words by blanks, with the marks on them; all lie in WIDE.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]\p{M}*)"
WIDE = r"[\x{0E00}-\x{10FFFF}]"
#: Words of lines whose variants are made from running sums, so that they are linear in the line.
LONG = 512
#: Words summed at a time there.
BLOCK = 256


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line: the lines that have a word."""
    each = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.where(F.length(F.btrim("line", F.lit(" \t\x0b\f\r"))) > 0)


def with_words(rows: DataFrame) -> DataFrame:
    """s (the words of line, one blank between), bare (without blanks) and n (words) in line's place."""
    rest = [c for c in rows.columns if c != "line"]
    # a character of WIDE has two bytes more than a length of one
    wide = (F.octet_length("line") >= F.length("line") + 2) & F.col("line").rlike(WIDE)
    rows = rows.select(*rest, F.when(wide, F.regexp_replace("line", UNSPACED, " $1 ")).otherwise(F.col("line")).alias("line"))
    other = F.startswith(F.col("line"), F.lit(" ")) | F.endswith(F.col("line"), F.lit(" "))
    for gap in ("  ", "\t", "\x0b", "\f", "\r"):
        other = other | F.contains(F.col("line"), F.lit(gap))
    rows = rows.select(*rest, F.when(other, F.btrim(F.regexp_replace("line", common.SPACES, " "))).otherwise(F.col("line")).alias("s"))
    rows = rows.select(*rest, "s", F.replace(F.col("s"), F.lit(" "), F.lit("")).alias("bare"))
    return rows.select(*rest, "s", "bare", (F.octet_length("s") - F.octet_length("bare") + 1).alias("n"))


def _words(s: Column, k: Column) -> Column:
    """The first k words, or the last -k."""
    return F.call_function("substring_index", s, F.lit(" "), k.cast("int"))


def placed_lines(docs: DataFrame) -> DataFrame:
    """at (doc_id, line_no), h1, h2 of every line; ends: the keys by which it meets near lines, null where only copies count.

    For a pair of m and n words, m <= n <= m + 1, the shared half has m div 2 words: ends
    has the halves for m = n and for m = n - 1.
    """
    near = (F.col("n") >= MIN_WORDS) | (F.col("n") >= NEAR_WORDS) & (F.length("bare") >= NEAR_CHARS)
    half = lambda m: [F.xxhash64(F.lit(1), m, _words(F.col("s"), F.floor(m / 2))), F.xxhash64(F.lit(2), m, _words(F.col("s"), -F.floor(m / 2)))]
    ends = F.when(near, F.array(*half(F.col("n")), *half(F.col("n") - 1)))
    return with_words(lines(docs)).select(F.struct("doc_id", "line_no").alias("at"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(9), "s").alias("h2"), ends.alias("ends"))


def without(s: Column, n: Column, at: Column) -> Column:
    """The line without its word number at; the whole line for -1."""
    before, after = _words(s, at), _words(s, at - n + 1)
    return F.when(at < 0, s).when(at == 0, after).when(at == n - 1, before).otherwise(F.concat(before, F.lit(" "), after))


def running(hashes: Column) -> Column:
    """0 and the running exclusive or, summed by blocks: an array grows by copying."""
    xor = lambda a, x: F.array_append(a, F.element_at(a, -1).bitwiseXOR(x))
    sums = lambda x: F.aggregate(x, F.array(F.lit(0).cast("long")), xor)
    blocks = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / BLOCK).cast("int")), lambda b: sums(F.slice(h, b * BLOCK + 1, BLOCK))))

    def whole(own: Column) -> Column:
        start = sums(F.transform(own, lambda x: F.element_at(x, -1)))
        moved = let(start, lambda o: F.flatten(F.transform(own, lambda x, b: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v.bitwiseXOR(o[b])))))
        return F.array_append(moved, F.element_at(start, -1))

    return let(blocks, whole)


def long_variants(words: Column) -> Column:
    """Keys of the line and of the line without each of its words, in order.

    A line's hash is the exclusive or of its words' hashes with their places, so all its
    variants come from running sums: of the words where they are, and moved one forward.
    """

    def of(w: Column) -> Column:
        here = running(F.transform(w, lambda x, i: F.xxhash64(x, i)))
        moved = running(F.transform(w, lambda x, i: F.xxhash64(x, i - 1)))

        def keys(sums: Column) -> Column:
            all_moved = F.element_at(sums["moved"], -1)
            cut = F.transform(w, lambda _, i: sums["here"][i].bitwiseXOR(all_moved).bitwiseXOR(sums["moved"][i + 1]))
            return F.concat(F.array(F.element_at(sums["here"], -1)), cut)

        return let(F.struct(here.alias("here"), moved.alias("moved")), keys)

    return let(words, of)


def variants(able: DataFrame) -> DataFrame:
    """first, key, at of able (first, s, n): the line (at -1) and the line without its word number at.

    Up to LONG words the key is the variant's own hash, beyond it comes from long_variants; lines of
    LONG + 1 words emit both kinds, so that any two lines within one edit share a kind.
    """
    short, long = F.array_repeat(F.lit(0).cast("long"), F.col("n") + 1), long_variants(F.split("s", " "))
    keys = F.when(F.col("n") <= LONG, short).when(F.col("n") == LONG + 1, F.concat(short, long)).otherwise(long)
    each = able.select("first", "s", "n", F.posexplode(keys).alias("place", "key"))
    each = each.select("first", "s", "n", "key", (F.col("place") % (F.col("n") + 1) - 1).alias("at"), ((F.col("n") <= LONG + 1) & (F.col("place") <= F.col("n"))).alias("short"))
    own = F.xxhash64(without(F.col("s"), F.col("n"), F.col("at")))
    return each.select("first", F.when(F.col("short"), own).otherwise(F.xxhash64(F.lit(9), "key")).alias("key"), "at")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """first (doc_id, line_no) of the distinct lines that have an earlier line within the bound.

    Lines whose variants agree fall into groups by (variant, deleted place), which replace
    one word at one place, and by (variant, whole or not), which insert or delete one. In
    the first kind all members are mutual partners, so whoever is not the earliest has the
    earliest as partner. In the second, a whole line's partners are all the lines that lose a
    word to become it, and theirs is that one line; each needs the earlier of the two only.
    So joining each group with one line, its earliest, finds all.
    """
    ends = distinct.where("ends is not null").select("h1", F.explode(F.array_distinct("ends")).alias("end"))
    met = ends.groupBy("end").agg(F.count("*").alias("m")).where("m > 1").select("end")
    able = distinct.select("h1", "first").join(ends.join(met, "end", "left_semi").select("h1").distinct(), "h1", "left_semi")
    # the words come from each line's first place: one line for each distinct line
    at = common.materialise(able.select("first.doc_id", "first.line_no"), "able")
    found = common.possible_rows(lines(docs), at, ["doc_id", "line_no"]).join(at.hint("merge"), ["doc_id", "line_no"], "left_semi")
    found = with_words(found).select(F.struct("doc_id", "line_no").alias("first"), F.struct("s", "n").alias("x"))
    # rows that repeat a doc_id may put several lines at one place: the least speaks for it
    able = common.materialise(found.groupBy("first").agg(F.min("x").alias("x")).select("first", "x.*"), "candidates")

    emitted = common.materialise(variants(able), "variants")
    places = common.materialise(emitted.groupBy("key", "at").agg(F.min("first").alias("low"), F.count("*").alias("m")), "places")
    of = F.struct("low", "at")
    keys = places.groupBy("key").agg(F.max("m").alias("most"), F.min(F.when(F.col("at") < 0, of)).alias("whole"), F.min(F.when(F.col("at") >= 0, of)).alias("cut"))
    some = keys.where((F.col("most") > 1) | F.col("whole").isNotNull() & F.col("cut").isNotNull())
    partners = F.array(of, F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole")))
    groups = places.join(some.select("key", "whole", "cut"), "key").select("key", "at", F.array_distinct(F.array_compact(partners)).alias("partners"))
    pairs = emitted.join(groups, ["key", "at"]).select("first", "at", F.explode("partners").alias("p")).select("first", "at", "p.low", F.col("p.at").alias("low_at")).where("low < first").distinct()
    other = able.select(F.col("first").alias("low"), F.col("s").alias("low_s"), F.col("n").alias("low_n"))
    kept = without(F.col("s"), F.col("n"), F.col("at")) == without(F.col("low_s"), F.col("low_n"), F.col("low_at"))
    return pairs.join(able, "first").join(other, "low").where(kept).select("first").distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, dropped: the sorted numbers of the lines that go, for the documents that lose any."""
    placed = common.materialise(placed_lines(docs), "placed")
    distinct = common.materialise(placed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.any_value("ends").alias("ends")), "distinct")
    near = common.materialise(near_lines(docs, distinct), "near").withColumn("near", F.lit(True))
    verdict = distinct.select("h1", "h2", "first", "n").join(near, "first", "left").where("near or n > 1")
    gone = placed.select("at", "h1", "h2").join(verdict, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (F.col("at") != F.col("first")))
    return gone.select("at.*").groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the text cleaned, all their columns, and __n (lines) and __gone (long) after them."""
    gone = common.materialise(dropped_lines(docs), "dropped").withColumnsRenamed({"doc_id": "__doc_id", "dropped": "__dropped"})
    joined = docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__doc_id"), "left")
    # places first: looking each line's number up in dropped would be quadratic
    kept = let(F.split("text", "\n"), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__dropped")), lambda i: ls[i]))
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias("__n"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("__gone")]
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *counts)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("__n")).cast("long").alias("n_lines"), "text", F.greatest("__gone", F.lit(0)).cast("long").alias("n_dropped"))


OP9_SQL = r"""
with l as (select doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) as line_no, string_split(text, chr(10)) as ls from documents where text is not null and doc_id is not null),
w as (select doc_id, line_no, regexp_extract_all(regexp_replace(ls[line_no + 1], '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]\p{M}*)', ' \1 ', 'g'), '[^\x20\x09-\x0D]+') as ws from l),
e as (select doc_id, line_no, ws, array_to_string(ws, ' ') as s from w where len(ws) >= 1),
d as (select s, ws, min({'doc_id': doc_id, 'line_no': line_no}) as f from e group by s, ws),
c as (select * from d where len(ws) >= 5 or len(ws) >= 3 and length(array_to_string(ws, '')) >= 20),
v as (select s, f, ws, -1 as at, s as k from c union all
      select s, f, ws, i as at, array_to_string(ws[1:i] || ws[i+2:], ' ') as k from (select *, unnest(range(0, len(ws))) as i from c)),
n as (select distinct b.s from v a join v b on a.k = b.k and a.f < b.f and a.s <> b.s and (a.at = b.at or a.at = -1 or b.at = -1)),
g as (select distinct e.doc_id, e.line_no from e join d on d.s = e.s left join n on n.s = e.s where n.s is not null or d.f <> {'doc_id': e.doc_id, 'line_no': e.line_no}),
o as (select l.doc_id, string_agg(l.ls[l.line_no + 1], chr(10) order by l.line_no) filter (where g.doc_id is null) as text, count(*) as n_lines, count(g.doc_id) as n_dropped
      from l left join g on g.doc_id = l.doc_id and g.line_no = l.line_no group by l.doc_id)
select x.doc_id, coalesce(o.n_lines, 0)::bigint as n_lines, case when x.text is not null then coalesce(o.text, '') end as text, coalesce(o.n_dropped, 0)::bigint as n_dropped
from documents x left join o on o.doc_id = x.doc_id
"""
