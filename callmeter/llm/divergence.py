"""Source divergence audit: how far the sources of a language differ in their terms, by run-length columns.

A group is a (lang, source). A term's share in a group is p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), N the group's terms and V
the language's kept terms; two shares differ by f = floor((p - q)^2 / (p + q)). All of it is whole numbers, so sums have one value in any order.

The vocabulary of a language is laid out so that equal counts stand together: terms of the same counts in all groups become one row with
their number, and these rows are sorted by their counts, the groups of the fewest terms first (a group without a term has zero there, and
the sorting brings zeros together). Ranges of these rows are cut into segments of SEGMENT rows; in each, a group's column is run-length
encoded. A pair of groups of a segment is met in one pass over the bounds of both: f of the two shares, times the length of the
piece. Groups that a segment lacks are one run of zeros; pairs of two such groups are left to the end, as all their pieces have the same f.

Counting is one pass over the texts with a bounded table of counts in each task, then one shuffle by (lang, term), which serves the
group's, the term's and the language's count. What follows is of the size of the vocabulary.

Bounds: a term's row holds a count for each source that has it, a segment SEGMENT such rows, a task the pairs of groups of a segment; a
result has a row for each pair of groups in any case. Sizes of a language's groups are broadcast if measured as small, else joined.

Defined results: null text, lang and source are ''; a group without any kept term has shares of 2 of 2 V, and pairs of value 0 if its language
keeps none; repeated rows count again; a lang of one source has no pairs; no rows give none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, small_cut, with_columns

SCALE, LEAST_DOCUMENTS, TOP = 1_000_000_000, 10, 10
#: Distinct terms that a task counts before it passes them on, and rows of a segment.
HELD_TERMS, SEGMENT = 200_000, 4096
#: Terms: runs of letters A-Z, a-z and of all code points from 128 on, in UTF-8 with A-Z already lower-cased.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_END = re.compile(rb"[^A-Za-z\x80-\xff]")


def _terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of pieces of about SLICE_BYTES, cut where no term stands."""
    at = 0
    while at < len(raw):
        m = _END.search(raw, at + SLICE_BYTES)
        end = m.start() if m else len(raw)
        yield _TERM.findall(raw[at:end].lower())  # bytes.lower() changes A-Z only
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(lang, source, text), added up within tasks only: occurrences, and documents that have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([of[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                n, of = held.setdefault(group, (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in _terms(texts[i].as_py()):
                    n.update(terms)
                    seen.update(terms)
                of.update(seen)
                size += len(n) - before
                if size >= HELD_TERMS:
                    yield from told()
                    held, size = {}, 0
        yield from told()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def vocabulary(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, by): the terms in at least `least` documents of their language, with their occurrences and those of each source."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
    return terms.filter(F.col("docs") >= least).select("lang", "term", "total", "by")


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact: products of whole numbers in decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * v))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, terms, v, lang_total): every group that occurs, with its occurrences of kept terms, their number in it and in its language."""
    own = terms.select("lang", F.explode("by").alias("b")).groupBy("lang", "b.source").agg(F.sum("b.n").alias("total"), F.count("*").alias("terms"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("total", "terms", "v", "lang_total")))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, of, counts) in order, of: the number of terms, counts: [group, count, group, count, ...] -> segments (lang, terms, runs), runs:
    [group, start, length, count, ...] of the counts above zero."""
    held: list[tuple[int, np.ndarray]] = []
    lang = None

    def told() -> pa.RecordBatch:
        sizes = np.array([n for n, _ in held], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate([c.reshape(-1, 2) for _, c in held])
        row = np.repeat(np.arange(len(held)), [len(c) // 2 for _, c in held])
        order = np.lexsort((row, flat[:, 0]))
        group, count, row = flat[order, 0], flat[order, 1], row[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(group) != 0) | (np.diff(count) != 0) | (np.diff(row) != 1))))
        last = np.concatenate((first[1:], [len(row)])) - 1
        begin, end = starts[row[first]], starts[row[last]] + sizes[row[last]]
        runs = np.stack([group[first], begin, end - begin, count[first]], 1).ravel()
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int(sizes.sum())], pa.int64()), pa.array([runs], pa.list_(pa.int64()))], ["lang", "terms", "runs"])

    for batch in batches:
        for own, n, counts in zip(batch.column("lang").to_pylist(), batch.column("of").to_pylist(), batch.column("counts"), strict=True):
            if held and (own != lang or len(held) >= SEGMENT):
                yield told()
                held = []
            lang = own
            held.append((n, counts.values.to_numpy(zero_copy_only=False)))
    if held:
        yield told()


def _column(runs: np.ndarray, terms: int, zero: int) -> tuple[np.ndarray, np.ndarray]:
    """A group's runs (start, length, share), with the zeros between them: (ends, shares)."""
    bounds = np.stack([runs[:, 0], runs[:, 0] + runs[:, 1]], 1).ravel()
    ends = np.concatenate((bounds, [terms]))
    shares = np.full(len(ends), zero)
    shares[1::2] = runs[:, 2]
    some = np.diff(ends, prepend=0) > 0
    return ends[some], shares[some]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (lang, terms, runs, totals, v), totals: of all groups by number -> (lang, a, b, value, covered): of pairs a < b the sum of f over
    the segment's terms, for pairs of which it has one at least."""
    for batch in batches:
        for lang, terms, runs, totals, v in zip(*(batch.column(c).to_pylist() for c in ("lang", "terms", "runs", "totals", "v")), strict=True):
            every = np.array(runs, np.int64).reshape(-1, 4)
            zero = [1 + 2 * SCALE // (t + 2 * v) for t in totals]
            columns, flat = {}, {}
            for g, own in ((int(r[0, 0]), r) for r in np.split(every, np.flatnonzero(np.diff(every[:, 0])) + 1)):
                counts, back = np.unique(own[:, 3], return_inverse=True)
                shares = np.array([1 + SCALE * (c + 2) // (totals[g] + 2 * v) for c in counts.tolist()], np.int64)
                columns[g] = _column(np.stack([own[:, 1], own[:, 2], shares[back]], 1), terms, zero[g])
            out: list[tuple[int, int, int]] = []
            for a, (ends_a, shares_a) in columns.items():
                for b in range(len(totals)):
                    if b in columns and b <= a:
                        continue
                    ends_b, shares_b = columns[b] if b in columns else flat.setdefault(b, (np.array([terms]), np.array([zero[b]])))
                    ends = np.union1d(ends_a, ends_b)
                    p, q = shares_a[np.searchsorted(ends_a, ends)], shares_b[np.searchsorted(ends_b, ends)]
                    value = int(((p - q) ** 2 // (p + q) * np.diff(ends, prepend=0)).sum())
                    out.append((min(a, b), max(a, b), value))
            if out:
                a, b, values = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), *[pa.array(x, pa.int64()) for x in (a, b, values, [terms] * len(out))]], ["lang", "a", "b", "value", "covered"])


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(lang, source, text). Part pair: each other source of the language, and the sum of f over
    all kept terms. Part term: up to `top` terms of a larger share in the group than in the language, and f of the two. Ranks: by value
    from the largest, then by item."""
    docs = with_columns(docs, {"lang": "string", "source": "string", "text": "string"}).na.fill("")
    terms = cut(vocabulary(docs, least), "vocabulary")
    number = F.row_number().over(W.partitionBy("lang").orderBy("terms", "source")) - 1
    groups = small_cut(groups_of(docs, terms).withColumn("number", number.cast("long")), "groups")

    numbered = terms.select("lang", "term", F.explode("by").alias("b")).select("lang", "term", "b.source", "b.n").join(groups.select("lang", "source", "number"), ["lang", "source"])
    rows = numbered.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("c")).select("lang", F.flatten(F.transform("c", lambda x: F.array(x["number"], x["n"]))).alias("counts"))
    distinct = cut(rows.groupBy("lang", "counts").agg(F.count("*").alias("of")), "counts")
    segments = distinct.repartitionByRange("lang", "counts").sortWithinPartitions("lang", "counts").select("lang", "of", "counts").mapInArrow(_segments, "lang string, terms long, runs array<long>")
    sizes = groups.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "total"))), lambda x: x["total"]).alias("totals"), F.max("v").alias("v"))
    sums = segments.join(small_cut(sizes, "sizes"), "lang").mapInArrow(_pairs, "lang string, a long, b long, value long, covered long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))

    shown = groups.select("lang", "source", "number", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.greatest("v", F.lit(1)))).alias("p"), "v")
    one, two = (shown.select("lang", *[F.col(c).alias(f"{c}_{i}") for c in ("source", "number", "p", "v")]) for i in (1, 2))
    pairs = one.join(two, "lang").filter("number_1 < number_2").join(sums.withColumnsRenamed({"a": "number_1", "b": "number_2"}), ["lang", "number_1", "number_2"], "left")
    rest = (F.col("v_1") - F.coalesce("covered", F.lit(0))) * _apart(F.col("p_1"), F.col("p_2"))
    valued = cut(pairs.select("lang", "source_1", "source_2", F.when(F.col("v_1") > 0, F.coalesce("value", F.lit(0)) + rest).otherwise(0).cast("long").alias("value")), "pairs")
    both = valued.select("lang", F.col("source_1").alias("source"), F.lit("pair").alias("part"), F.col("source_2").alias("item"), "value").unionByName(valued.select("lang", F.col("source_2").alias("source"), F.lit("pair").alias("part"), F.col("source_1").alias("item"), "value"))

    own = terms.select("lang", "term", "total", F.explode("by").alias("b")).select("lang", "term", F.col("total").alias("in_lang"), "b.source", "b.n").join(groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("in_lang"), F.col("lang_total"), F.col("v"))
    more = own.withColumns({"p": p, "q": q}).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).filter(F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with d as (select row_number() over () as id, coalesce(lang,'') as lang, coalesce(source,'') as source, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from w group by all having count(distinct id) >= 10),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
l as (select lang, count(*)::hugeint as v, sum(total)::hugeint as total from k group by all),
g as (select d.lang, d.source, coalesce(max(s.total), 0)::hugeint as total from (select distinct lang, source from d) d left join (select lang, source, sum(n) as total from c group by all) s using (lang, source) group by all),
f as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) as p, 1 + (1000000000::hugeint * (k.total + 2)) // (l.total + 2 * l.v) as q from g join l using (lang) join k using (lang) left join c using (lang, source, term)),
p as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from f a join f b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join p on p.lang = a.lang and p.source = a.source and p.item = b.source
union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from f where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from r)
select lang, source, part, item, value, rank::int as rank from o where part = 'pair' or rank <= 10
"""
