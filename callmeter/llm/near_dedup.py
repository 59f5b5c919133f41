"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Signature: multiplicative permutations of the shingle hashes; the minimum and the maximum of each are kept, so 32
evaluations give 64 values. Bands of ROWS values, as many as a pair at the threshold needs to miss them all with
probability MISS at most: at 0.85 16 bands (32 permutations, (1 - 0.85^4)^16 = 7e-6), at 0.8 23 bands (46
permutations, (1 - 0.8^4)^23 = 5e-6). Nearer pairs miss less often, at 0.9 16 bands with 2e-8.

A bucket is never expanded into pairs. First its smallest set is the hub, and each member is compared with the hub on
full sets. Where that leaves more than one component, the members are compared with a centre: the shingles that most
members of a bounded sample hold. With D(x) = x minus/plus centre (symmetric difference), two members x and y differ in
|D(x)| + |D(y)| - 2 |D(x) n D(y)| shingles, exactly. So pairs that are near even if their differences are disjoint are
all near the member with the smallest margin, and one star links them; any other near pair shares an element of
D within a prefix of it. In such a pair the member of the larger margin is not near the star, so it needs the more of the other's D: the
other's prefix ("low") is the shorter the farther the star's reach, and in copies of one text it has only what their own edits
brought, not what many of them lost of the text. The prefix of the larger margin ("high") is longer, but counts only where a low one has the
element. Members that share one and are still in different components are smaller groups: a join on that element
compares the differences of low with high, and gives only links; while such a group has more than MANY squared of these
pairs, it gets a centre of its own. This loses no link, whatever the centre is.

Defined results: a null or empty text has no shingles and is linked with nothing; texts of fewer words than
a shingle are one shingle; equal sets are one class; repeated rows each get their class's component; a null
doc_id takes part and is never a component's id unless the component has no other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, bit_set, components, counted, cut, in_bits, kept, passing, shingle_sets, small_cut, with_columns

ROWS, MISS = 4, 7.5e-6
#: Members of a group that its centre is taken from; any number gives right results.
SAMPLE = 16
#: Members of a group up to which its pairs of fitting size and different components are compared on full sets (120 pairs
#: at most), and of a group around a centre (the root of low times high) up to which differences are compared in the join; larger ones are split.
FEW, MANY = 16, 256
#: Pairs that are compared on full sets at a time, and in how many parts at most: each part reads the written sets again, and shuffles its own.
PART_PAIRS, PARTS = 10_000, 8


def minmax_signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, interleaved: 2 values for each hash evaluation."""
    lows = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    highs = np.zeros(len(multipliers), np.uint64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192] * multipliers[:, None]
        lows, highs = np.minimum(lows, part.min(1)), np.maximum(highs, part.max(1))
    return np.stack([lows, highs], 1).ravel()


def bands_for(need: tuple[int, int]) -> int:
    return max(1, ceil(log(MISS) / log1p(-((need[0] / need[1]) ** ROWS)))) if need[0] < need[1] else 1


def _multipliers(seed: int, permutations: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _key(hashes: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None


def signatures(docs: DataFrame, shingle: int, n_bands: int, seed: int = 7) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key, bands): key names the shingle set; under 6 billion distinct
    sets, less than one pair of them is expected to share a 64-bit key."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(seed, -(-n_bands * ROWS // 2))
        for batch in batches:
            counts, keys, bands = [], [], []
            for hashes in shingle_sets(batch.column("text"), shingle):
                counts.append(len(hashes))
                keys.append(_key(hashes))
                if len(hashes):
                    rows = minmax_signature(hashes, multipliers)[: n_bands * ROWS].reshape(n_bands, ROWS)
                    bands.append([xxhash.xxh3_64_intdigest(r.tobytes(), b) - (1 << 63) for b, r in enumerate(rows)])
                else:
                    bands.append([])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "key", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, key long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(key, s): the shingle sets of the texts whose hashes are in wanted(text_hash). A bounded bit set keeps
    most other texts from being shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(wanted, "text_hash"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(in_bits(on, batch.column("text_hash").to_numpy(zero_copy_only=False))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, held = [], [], 0
            for hashes in shingle_sets(batch.column("text"), shingle):
                keys.append(_key(hashes))
                sets.append(hashes.view(np.int64))
                held += len(hashes)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "s"])
                    keys, sets, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "s"])

    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(likely, "text string, text_hash long")
    once = texts.groupBy("text_hash").agg(F.first("text").alias("text")).join(wanted, "text_hash", "left_semi")
    return once.select("text").mapInArrow(build, "key long, s array<long>")


def _centres(groups: DataFrame, sets: DataFrame, seed: int) -> DataFrame:
    """(g, c): the shingles of most of up to SAMPLE members of each group."""
    sample = groups.groupBy("g", F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(SAMPLE)).alias("part")).agg(F.min("x").alias("key"))
    sample = sample.withColumn("of", F.count("*").over(Window.partitionBy("g")))
    held = sample.join(sets, "key").select("g", "of", F.explode("s").alias("e")).groupBy("g", "e").agg(F.count("*").alias("n"), F.min("of").alias("of"))
    return held.filter("2 * n > of").groupBy("g").agg(F.collect_list("e").alias("c"))


def _compared(groups: DataFrame, sets: DataFrame, centres: DataFrame, need: tuple[int, int]) -> DataFrame:
    """groups (g, x) with n = |x|, d = D(x), size = |D| and the margin a: x and y of disjoint D are linked if a + a' <= 0."""
    p, q = need
    both = groups.join(sets.select(F.col("key").alias("x"), F.col("s").alias("sx")), "x").join(centres, "g")
    # what the centre lacks comes first: it is rarer
    d = F.concat(F.array_except("sx", "c"), F.array_except("c", "sx"))
    diff = both.select("g", "x", F.size("sx").cast("long").alias("n"), d.alias("d")).withColumn("size", F.size("d"))
    return diff.withColumn("a", (p + q) * F.col("size") - (q - p) * F.col("n"))


def _rooted(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (x, ...) with root: the member's component."""
    return members.join(labels.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))


def _open(rooted: DataFrame) -> DataFrame:
    """Distinct groups (g, p, x, n, root, low, high, members) of groups (g, p, x, n, root, low, high) with members of each role and of more than one component;
    p: the group that it is part of; g becomes a hash of p and the members; members: the root of how many are low times how many are high. rooted is read twice: a written table."""
    of = F.sqrt(F.count_if("low") * F.count_if("high")).alias("members")
    still = rooted.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.xxhash64(F.min("p"), F.bit_xor(F.xxhash64("x", "low", "high")), F.count("*")).alias("f"), of).filter("lo <> hi and members > 0").select("g", "f", "members")
    return rooted.join(still, "g").select(F.col("f").alias("g"), "p", "x", "n", "root", "low", "high", "members").distinct()


def _pairs(groups: DataFrame, condition: str, *more: str) -> DataFrame:
    """Pairs (u, v) of a low and a high member of the same group and of different components that meet the condition on n1, n2, ..."""
    one, two = (groups.filter(role).select("g", *[F.col(c).alias(f"{c}{i}") for c in ("x", "n", "root", *more)]) for i, role in ((1, "low"), (2, "high")))
    return one.join(two, "g").filter(f"root1 <> root2 and {condition}").select(F.col("x1").alias("u"), F.col("x2").alias("v")).distinct()


def _direct(pairs: DataFrame, n: int, sets: DataFrame, need: tuple[int, int], every: bool = False) -> DataFrame:
    """The pairs (u, v) that full sets confirm. pairs: a written table of n rows; every: each of sets is in a pair. The sets are the largest rows that are
    shuffled, so many pairs are taken in parts, and a part's shuffle files go before the next."""
    parts = max(1, min(PARTS, n // PART_PAIRS))
    if parts == 1:
        return _confirmed(pairs, sets, need, every)
    found = [cut(_confirmed(pairs.filter(F.pmod(F.xxhash64("u"), F.lit(parts)) == i), sets, need), "confirmed") for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _confirmed(pairs: DataFrame, sets: DataFrame, need: tuple[int, int], every: bool = False) -> DataFrame:
    p, q = need
    keys = lambda: pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    held = sets if every else sets.join(small_cut(keys(), "keys"), "key", "left_semi")
    inter = F.size(F.array_intersect("su", "sv"))
    both = pairs.join(held.select(F.col("key").alias("u"), F.col("s").alias("su")), "u").join(held.select(F.col("key").alias("v"), F.col("s").alias("sv")), "v")
    return both.filter(q * inter >= p * (F.size("su") + F.size("sv") - inter)).select("u", "v")


def linked(pairs: DataFrame, n_pairs: int, sets: DataFrame, need: tuple[int, int]) -> DataFrame:
    """(node, root) of the components of all links among members of the same group; pairs (x, hub): a written table of n_pairs rows, sets (key, s): those of its members."""
    p, q = need
    as_edges = lambda labels: labels.select(F.col("node").alias("u"), F.col("root").alias("v"))
    sized = sets.select(F.col("key").alias("x"), F.size("s").cast("long").alias("n"))
    labels = components(_direct(pairs.select(F.col("x").alias("u"), F.col("hub").alias("v")), n_pairs, sets, need, True))
    members = pairs.select(F.col("hub").alias("g"), "x").unionByName(pairs.select(F.col("hub").alias("g"), F.col("hub").alias("x"))).distinct().join(sized, "x")
    both = members.withColumns({"p": F.col("g"), "low": F.lit(True), "high": F.lit(True)})
    groups, n = counted(_open(cut(_rooted(both, labels), "members")), "groups")
    if not n:
        return labels
    few, n_few = counted(_pairs(groups.filter(F.col("members") <= FEW), f"x1 < x2 and {q} * n1 >= {p} * n2 and {q} * n2 >= {p} * n1"), "few")
    links = _direct(few, n_few, sets, need) if n_few else few
    (many, left), level = counted(groups.filter(F.col("members") > FEW).select("g", "x"), "many"), 0
    while left:
        level += 1
        held = sets.join(small_cut(many.select(F.col("x").alias("key")).distinct(), "keys"), "key", "left_semi")
        seen = cut(_compared(many, held, _centres(many, held, level), need), "compared")
        best = seen.groupBy("g").agg(F.min_by("x", F.struct("a", "x")).alias("star"), F.min("a").alias("least"))
        margins = seen.join(best, "g")
        stars = margins.filter("x <> star and a + least <= 0").select(F.col("x").alias("u"), F.col("star").alias("v"))
        labels = components(links.unionByName(stars).unionByName(as_edges(labels)))
        margins = _rooted(margins, labels)
        # a partner's D is at most (q - p) / (p + q) (n + n q / p) smaller, so it shares the rest of D(x) but for one element less
        slack = F.floor(F.lit((q - p) / (p + q) * (1 + q / p)) * F.col("n") + F.lit(1e-6)).cast("int") + 2
        shares = lambda least: F.greatest(F.lit(1), F.ceil((F.col("a") + least) / F.lit(2.0 * (p + q))).cast("int"))  # noqa: E731  with a partner of that margin or more
        prefix = lambda least: F.greatest(F.least(slack, F.col("size") - shares(least) + 1), F.lit(0))
        margins = margins.withColumn("high", F.col("a") + F.col("least") > 0).withColumn("first", prefix(F.greatest("a", 1 - F.col("least"))))
        taken = F.slice("d", 1, F.when(F.col("high"), prefix(F.col("least"))).otherwise(F.col("first")))
        shared = margins.select("x", "n", "root", F.col("g").alias("p"), "high", "first", F.posexplode(taken).alias("at", "e"))
        shared = shared.select("x", "n", "root", "p", (F.col("at") < F.col("first")).alias("low"), "high", F.xxhash64("p", "e").alias("g"))
        groups = cut(_open(cut(shared, "shared")), "groups")
        # |x1 minus/plus x2| = |D1| + |D2| - 2 |D1 n D2| decides at once, in groups of bounded numbers of pairs
        near = groups.filter(F.col("members") <= MANY).join(seen.select(F.col("g").alias("p"), "x", "a", "d", "size"), ["p", "x"])
        links = cut(_pairs(near, f"a1 <= a2 and {p + q} * (size1 + size2 - 2 * size(array_intersect(d1, d2))) <= {q - p} * (n1 + n2)", "a", "d", "size"), "links")
        many, left = counted(groups.filter(F.col("members") > MANY).select("g", "x"), "many")
    return components(links.unionByName(as_edges(labels)))


def _found(docs: DataFrame, shingle: int, need: tuple[int, int]) -> DataFrame:
    """(doc_id, text_hash, n_shingles, root, component_id) for each row of docs; root: null without shingles, else the
    component's smallest set key."""
    docs = with_columns(docs, {"doc_id": "long", "text": "string"})
    sig = cut(signatures(docs, shingle, bands_for(need)), "signatures")
    bands = sig.filter("key is not null").select(F.explode("bands").alias("band"), "key")
    hubs = bands.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("top")).filter("hub <> top").select("band", "hub")
    pairs, n = counted(bands.join(hubs, "band").filter("key <> hub").select(F.col("key").alias("x"), "hub").distinct(), "pairs")
    with passing():  # the sets and what links them are the largest tables by far
        labels = None
        if n:
            members = pairs.select(F.col("x").alias("key")).unionByName(pairs.select(F.col("hub").alias("key"))).distinct()
            wanted = cut(sig.filter("key is not null").groupBy("key").agg(F.min("text_hash").alias("text_hash")).join(members, "key", "left_semi").select("text_hash").distinct(), "wanted")
            sets = cut(full_sets(docs, wanted, shingle), "sets")
            labels = linked(pairs, n, sets, need)
        classes = sig.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
        classes = classes.withColumn("root", F.col("key")) if labels is None else classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        classes = kept(cut(classes, "classes"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("key", "root", "component_id")
    out = sig.select("doc_id", "text_hash", "n_shingles", "key").join(named, "key", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, need: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text). Linked: need[1] * |intersection| >=
    need[0] * |union| of the sets of `shingle`-word shingles; components are those of all links."""
    return _found(docs, shingle, need).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


@beside("doc_id", "text")
def one_of_each(docs: DataFrame, shingle: int = 5, need: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one document of each component: of its smallest doc_id, there of the smallest text hash. Rows repeated whole
    (same doc_id, same text) become one. A document is known by its doc_id, which may be null or repeated, and its text's hash."""
    with passing():
        found = kept(cut(_found(docs, shingle, need), "near"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = found.filter(same & F.col("root").isNotNull())
    tied = small_cut(first.groupBy("root").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).filter("lo <> hi"), "tied")
    others = found.filter(~same).select("doc_id", "text_hash").unionByName(first.join(tied, "root").filter("text_hash <> lo").select("doc_id", "text_hash"))
    rows = lambda keys, name: small_cut(keys.select(F.col("doc_id").alias("near_id"), F.col("text_hash").alias("near_hash")).distinct(), name)
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("near_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("near_hash"))
    rest = docs.join(rows(others, "dropped"), met, "left_anti")
    again, n = counted(found.groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"), "again")
    if not n:
        return rest
    again = rows(again, "repeated")
    return rest.join(again, met, "left_anti").unionByName(rest.join(again, met, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (85, 100))


#: Brute force over all pairs that share a shingle.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w)=0 then [] when len(w)<3 then [array_to_string(w,' ')] else list_distinct(list_transform(range(1,len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2])) end as s from w),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
i as (select a.doc_id as u, b.doc_id as v, a.n as nu, b.n as nv, count(*) as c from x a join x b on a.g=b.g and a.doc_id<b.doc_id group by all),
e as (select u, v from i where 100*c >= 85*(nu+nv-c)),
r as (select doc_id as d, doc_id as c from s union select r.d, case when e.u=r.c then e.v else e.u end from r join e on e.u=r.c or e.v=r.c),
k as (select d, min(c) as component_id from r group by d)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, k.component_id, s.doc_id=k.component_id as kept from s join k on k.d=s.doc_id
"""
