"""Operator 2: near-duplicates by min-max hashing, confirmed on full shingle sets.

1. Each text gives its set of five-word shingles (64-bit hashes), and under each of
   PERMUTATIONS hash functions both the smallest and the largest value: 128 signature
   values for 64 evaluations a shingle (Ji et al., "Min-Max Hash", 2013). Four values (two
   functions) make a band: with 32 bands a pair at similarity 0.75 is missed with
   probability (1 - 0.75^4)^32, about 5e-6.
2. Texts with equal sets become one class before anything is paired.
3. In a band's bucket every class is compared with the bucket's hub only: the one that
   shares its buckets with most others (a star, linear in the bucket). Links are confirmed exactly: intersection and union of the
   full sets. Their components label the classes.
4. Where a bucket still holds more than one label, its classes are open; an odd one is labelled
   otherwise than a hub of its. Only a pair of an odd class and another label can change a
   component. A pair at similarity 0.75 shares one of the rarest shingles of either set: of n,
   n + 1 less the overlap that the other's size asks for (prefix filter, exact for any order).
   Rarest is by the open classes' own counts, so a group that shares one source text
   meets by what its members have besides it, which is little: an odd class differs
   from the source in more shingles than that prefix holds. The size class of the partner is part
   of the key, so that the prefix is as short as the partner allows, and the shared shingle's
   place in both (positional filter) leaves few pairs. They are confirmed exactly.
5. Components of all links give the result.

Copies are never paired with each other; pairs, links and components stay in tables.

Defined cases: a null or wordless text has an empty set and links with nothing; rows that
repeat a doc_id are one document (the row of greatest fingerprint counts); rows without
doc_id stay, unlinked, with null component_id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE_WORDS = 5
SIMILAR, OF = 75, 100
PERMUTATIONS = 64
BAND_VALUES = 4
BANDS = 2 * PERMUTATIONS // BAND_VALUES
#: Size classes of sets grow by this factor.
SIZE_STEP = 1 + 1 / 32
CACHE_WORDS = 500_000

_U = np.uint64
_rng = np.random.default_rng(20240611)
_MULTIPLIERS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=_U) * _U(2) + _U(1)
_PLACES = _rng.integers(1, 1 << 63, SHINGLE_WORDS + 1, dtype=_U) * _U(2) + _U(1)
_BAND_PLACES = _rng.integers(1, 1 << 63, BAND_VALUES, dtype=_U) * _U(2) + _U(1)
_BAND_SALT = _rng.integers(1, 1 << 63, BANDS, dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalising steps of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: _WordHashes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; bytes.lower() and .split() are the contract's rules."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, _U)
    w = np.fromiter(map(hashes.__getitem__, words), _U, n)
    width = min(k, n)
    total = np.full(n - width + 1, width * int(_PLACES[k]) & 0xFFFFFFFFFFFFFFFF, _U)
    for i in range(width):
        total += w[i : n - width + 1 + i] * _PLACES[i]
    return np.unique(_mix(total))


def min_max(values: np.ndarray) -> np.ndarray:
    """2 x PERMUTATIONS values: minimum and maximum under each function, side by side."""
    low, high = np.full(PERMUTATIONS, ~_U(0)), np.zeros(PERMUTATIONS, _U)
    for a in range(0, len(values), 4096):
        image = _MULTIPLIERS[:, None] * values[None, a : a + 4096]
        np.minimum(low, image.min(1), out=low)
        np.maximum(high, image.max(1), out=high)
    return np.stack([low, high], 1).reshape(-1)


def bands_of(signature: np.ndarray) -> np.ndarray:
    return _mix((signature.reshape(BANDS, BAND_VALUES) * _BAND_PLACES).sum(1) + _BAND_SALT).view(np.int64)


SIGNATURES = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, names = _WordHashes(), [x.split()[0] for x in SIGNATURES.split(", ")]
        types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = shingle_set(text.as_py(), hashes)
                if len(values):
                    f1, f2 = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64).tolist()
                    rows.append((doc, len(values), f1, f2, bands_of(min_max(values))))
                else:
                    rows.append((doc, 0, 0, 0, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNATURES)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, f1, f2, shingles: the same hashes again, for the documents that are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _WordHashes()
        for batch in batches:
            rows, size = [], 0
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                values = shingle_set(texts[i].as_py(), hashes)
                f1, f2 = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64).tolist() if len(values) else (0, 0)
                rows.append((doc, f1, f2, values.view(np.int64)))
                size += len(values)
                if size > 2_000_000 or i == batch.num_rows - 1:
                    types = [pa.int64()] * 3 + [pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "f1", "f2", "shingles"])
                    rows, size = [], 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, f1 long, f2 long, shingles array<long>")


def _sizes_fit(na, nb):
    return F.least(na, nb) * OF >= F.greatest(na, nb) * SIMILAR


def sets_of(needed: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, shingles of the classes named in needed (doc_id, distinct), written."""
    needed = common.materialise(needed, "needed")
    chosen = needed.join(classes.select("doc_id", "f1", "f2"), "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # merge joins at every size: what is needed grows with the table, and so must not be broadcast
    texts = common.possible_rows(texts, needed).join(needed.hint("merge"), "doc_id", "left_semi")
    # rows that repeat a doc_id: the set that its class was made from
    return common.materialise(shingle_sets(texts).join(chosen, ["doc_id", "f1", "f2"], "left_semi").select("doc_id", "shingles"), "sets").dropDuplicates(["doc_id"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").where(both * OF >= (F.size("sa") + F.size("sb") - both) * SIMILAR).select("a", "b")


def _overlap(na, nb):
    """The least intersection of sets of these sizes at the similarity: SIMILAR / (OF + SIMILAR) of their sum."""
    return F.ceil((na + nb) * SIMILAR / (OF + SIMILAR) - 1e-9).cast("long")


def size_class(n):
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP) + 1e-9).cast("int")


def prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of open classes that may be similar, one of them odd, with different labels.

    members: doc_id, root, odd. Shingles of one class only meet nobody and just take places.
    """
    tokens = members.join(sets, "doc_id").select("doc_id", F.size("shingles").cast("long").alias("n"), "root", "odd", F.explode("shingles").alias("token"))
    tokens = common.materialise(tokens, "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    ranked = tokens.join(counts.hint("merge"), "token").groupBy("doc_id", "n", "root", "odd").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("ranked"))
    # places of the shared shingles follow those of the n - size(ranked) that nobody shares
    ranked = common.materialise(ranked.withColumn("own", F.col("n") - F.size("ranked")), "ranked")
    prefix = lambda longest: F.posexplode(F.slice("ranked", 1, F.greatest(longest - F.col("own"), F.lit(0)).cast("int"))).alias("at", "x")
    smallest = F.ceil(F.col("n") * SIMILAR / OF - 1e-9).cast("long")
    largest = F.floor(F.col("n") * OF / SIMILAR + 1e-9).cast("long")
    sizes = ranked.where("odd").withColumn("class", F.explode(F.sequence(size_class(smallest), size_class(largest))))
    least = F.greatest(smallest, F.floor(F.pow(F.lit(SIZE_STEP), F.col("class")) - 1e-6).cast("long"))
    left = sizes.select("doc_id", "n", "root", "class", "own", prefix(F.col("n") - _overlap(F.col("n"), least) + 1))
    right = ranked.select("doc_id", "n", "root", "odd", size_class(F.col("n")).alias("class"), "own", prefix(F.col("n") - smallest + 1))
    side = lambda df, x, *more: df.select(F.col("x.token").alias("token"), "class", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "root", *more)], (F.col("n") - F.col("own") - F.col("at")).alias(f"left_{x}"))
    met = side(left, "a").join(side(right, "b", "odd").hint("merge"), ["token", "class"])
    once = ~F.col("odd_b") | (F.col("doc_id_a") < F.col("doc_id_b"))
    able = F.least("left_a", "left_b") >= _overlap(F.col("n_a"), F.col("n_b"))
    met = met.where((F.col("root_a") != F.col("root_b")) & once & _sizes_fit(F.col("n_a"), F.col("n_b")) & able)
    return met.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    signed = common.materialise(signatures(docs), "signatures")
    with_id = signed.where("doc_id is not null")
    # rows that repeat a doc_id are one document
    one = with_id.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "f1", "f2")).alias("x")).select("doc_id", "x.*")
    firsts = one.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    classes = common.materialise(firsts, "classes")
    full = classes.join(with_id.select("doc_id", "f1", "f2", "bands").dropDuplicates(["doc_id", "f1", "f2"]), ["doc_id", "f1", "f2"])
    members = full.select("doc_id", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    shared = common.materialise(members.join(sizes, "bucket"), "members")
    # the hub is whoever shares its buckets with most others: the text that others were made from
    known = shared.groupBy("doc_id").agg(F.sum("m").alias("known"))
    shared = shared.join(known, "doc_id")
    best = F.struct("known", -F.col("doc_id"))
    stars = shared.groupBy("bucket").agg(F.max_by("doc_id", best).alias("hub"), F.max_by("n", best).alias("hub_n"))
    shared = common.materialise(shared.join(stars, "bucket").drop("known"), "shared")

    sets = sets_of(shared.select("doc_id").distinct(), docs, classes)
    star_pairs = shared.where((F.col("doc_id") != F.col("hub")) & _sizes_fit(F.col("n"), F.col("hub_n"))).select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    first_links = common.materialise(confirm(common.materialise(star_pairs, "pairs"), sets), "links")
    labels = common.materialise(components(first_links), "labels").select(F.col("node").alias("doc_id"), "root")

    labelled = common.materialise(shared.where("m > 2").select("bucket", "doc_id", "hub").join(labels, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "labelled")
    main = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("doc_id") == F.col("hub"), F.col("root"))).alias("main")).where("low < high").select("bucket", "main")
    opened = labelled.join(main, "bucket").groupBy("doc_id").agg(F.max("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("odd"))
    across = common.materialise(prefix_pairs(common.materialise(opened, "open"), sets), "across")
    if across.isEmpty():
        roots = labels
    else:
        links = first_links.unionByName(confirm(across, sets))
        roots = common.materialise(components(links), "labels").select(F.col("node").alias("doc_id"), "root")

    by_class = classes.join(roots, "doc_id", "left").select("f1", "f2", F.coalesce("root", "doc_id").alias("root"))
    found = one.join(by_class, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    found = found.unionByName(signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
k as (select doc_id, unnest(ws) as x, unnest(range(len(ws))) as i from w),
g as (select doc_id, len(ws) as n, i, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' ' || lead(x, 4) over o as sh
      from k join w using (doc_id) window o as (partition by doc_id order by i)),
t as (select distinct doc_id, sh from g where sh is not null union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4),
s as (select w.doc_id, count(t.sh) as n from w left join t on t.doc_id = w.doc_id group by w.doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as n from t a join t b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
l as (select a, b from i join s x on x.doc_id = a join s y on y.doc_id = b where 100 * i.n >= 75 * (x.n + y.n - i.n)),
r as (select doc_id as node, doc_id as root from s union select l.b, r.root from r join l on l.a = r.node where r.root < l.b)
select s.doc_id, s.n::bigint as n_shingles, min(root) as component_id, s.doc_id = min(root) as kept
from s join r on r.node = s.doc_id group by s.doc_id, s.n
"""
