"""Mixing sources to target weights, through a tree domain - language - source.

Weights are whole numbers of the nodes, shared among siblings. Budgets go down the tree: at each node the budget is
dealt to its children in proportion to their weights, none above its capacity (its leaves' tokens times max_epochs), and
what a child cannot take goes to its siblings. As a subtree's capacity bounds its budget, a shortage is made up among
siblings first, and only what they cannot take reaches the level above. Dealing is in closed form: siblings sorted by
capacity per weight; those before the break are full, the rest share what is left.

A leaf's budget is full epochs over its documents and a prefix of one more epoch, in an order seeded by
(seed, epoch, doc_id): documents are taken while their running token count is within the budget. The prefix sums are taken
over ranges of that order, then only within the range that the cut falls in, so no leaf meets in one task; the texts
are not shuffled.

Defined results: null and empty texts have 0 tokens; a null language or source is a node of its own; leaves
without tokens get nothing; repeated doc_ids of a leaf stand or fall together; nodes without a weight get the default 1;
columns beside the documents' are kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, cut, small_cut

SEED, MAX_EPOCHS, RANGE_ROWS = 11, 2, 4096
LEVELS = ("domain", "lang", "source")
#: The target weights of the queries; other nodes weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}


def domain_of(source: Column) -> Column:
    """The domain of the test tables' sources: d0 to d3 by the number in the name, dx without one."""
    n = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(n != "", F.concat(F.lit("d"), (n.cast("int") % 4).cast("string"))).otherwise(F.lit("dx"))


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves(*LEVELS, tokens) with budget: the tokens that each is to give. Budgets and shares are whole numbers; only the order of
    siblings goes by a ratio. A level's windows hold nodes of the tree, one row each, not documents."""
    out = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("decimal(38,0)")).withColumn("b", budget.cast("decimal(38,0)"))
    for depth, level in enumerate(LEVELS):
        parents, own = LEVELS[:depth], LEVELS[: depth + 1]
        nodes = out.groupBy(*own).agg(F.sum("cap").cast("decimal(38,0)").alias("c"), F.max("b").alias("b")).withColumn("w", _weight(level, weights))
        part = W.partitionBy(*(parents or [F.lit(0)]))
        order = part.orderBy(F.col("c") * F.lit(1.0) / F.col("w"), level)
        before = F.coalesce(F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)")
        after = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
        nodes = nodes.withColumn("before", before).withColumn("after", after)
        full = F.col("c") * F.col("after") <= (F.col("b") - F.col("before")) * F.col("w")
        nodes = nodes.withColumn("full", full).withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(part), F.lit(0)).cast("decimal(38,0)")).withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(part))
        share = F.expr("((b - spent) * w) div open").cast("decimal(38,0)")
        nodes = nodes.select(*[F.col(x).alias(f"k_{x}") for x in own], F.when(F.col("full"), F.col("c")).otherwise(share).alias("b"))
        match = [F.col(x).eqNullSafe(F.col(f"k_{x}")) for x in own]
        cond = match[0]
        for m in match[1:]:
            cond = cond & m
        out = out.drop("b").join(nodes, cond).drop(*[f"k_{x}" for x in own])
    return out.select(*LEVELS, "tokens", "rows", F.col("b").cast("long").alias("budget"))


def _order(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


@beside("doc_id", "text", "lang", "source")
def mix(docs: DataFrame, domain: Column, share: float, weights: dict[str, dict[str, int]], seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs(doc_id, text, lang, source) with domain, n_tokens and copies (1 or more): the mixture of `share` of the corpus's tokens."""
    rows = docs.drop("domain", "n_tokens", "copies").withColumn("domain", domain).withColumn("n_tokens", tokens(F.col("text")))
    slim = cut(rows.select("doc_id", *LEVELS, "n_tokens"), "tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    total = slim.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    plan = budgets(leaves, F.lit(int(total * share)), weights, max_epochs).filter("tokens > 0")
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = cut(plan.withColumn("leaf", F.xxhash64(F.to_json(F.struct(*LEVELS)))).withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("rows") / RANGE_ROWS))), "plan")
    leaf = F.xxhash64(F.to_json(F.struct(*LEVELS)))
    thin = small_cut(plan.select("leaf", "epochs", "rest", "ranges"), "leaves")
    placed = slim.withColumn("leaf", leaf).join(thin, "leaf").withColumn("o", _order(F.col("epochs"), F.col("doc_id"), seed))
    at = F.floor(F.conv(F.substring("o", 1, 7), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 28)).cast("long")
    placed = placed.withColumn("range", at)
    sums = placed.groupBy("leaf", "range", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = W.partitionBy("leaf").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    edge = sums.withColumn("upto", F.sum("t").over(upto)).filter("upto > rest").groupBy("leaf").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("t")).alias("before")), F.col("range")).alias("e")).select("leaf", F.col("e.range").alias("edge"), F.col("e.before").alias("before"))
    edge = small_cut(edge, "edge")
    within = placed.select("leaf", "range", "rest", "o", "n_tokens").join(edge, "leaf").filter(F.col("range") == F.col("edge"))
    run = F.sum("n_tokens").over(W.partitionBy("leaf").orderBy("o").rangeBetween(W.unboundedPreceding, 0))
    last = within.withColumn("run", run + F.col("before")).filter("run <= rest").groupBy("leaf").agg(F.max("o").alias("last"))
    # a leaf without an edge takes the whole prefix epoch; one whose edge range has no document within the budget stops before it
    limits = plan.select("leaf", "epochs", "ranges").join(edge, "leaf", "left").join(last, "leaf", "left").withColumn("none", F.col("edge").isNotNull() & F.col("last").isNull())
    limits = small_cut(limits.select("leaf", F.col("epochs").alias("__e"), F.col("ranges").alias("__r"), F.col("edge").alias("__edge"), F.col("last").alias("__last")), "limits")
    o = _order(F.col("__e"), F.col("doc_id"), seed)
    found = rows.withColumn("leaf", leaf).join(limits, "leaf").withColumn("__o", o)
    at = F.floor(F.conv(F.substring("__o", 1, 7), 16, 10).cast("long") * F.col("__r") / F.lit(1 << 28)).cast("long")
    taken = F.col("__edge").isNull() | (at < F.col("__edge")) | ((at == F.col("__edge")) & (F.col("__o") <= F.col("__last")))
    copies = F.col("__e") + F.when(taken, 1).otherwise(0)
    return found.withColumn("copies", copies.cast("long")).filter("copies > 0").select(*[c for c in docs.columns if c not in ("domain", "n_tokens", "copies")], "domain", "n_tokens", "copies")


def stage(docs: DataFrame) -> DataFrame:
    return mix(docs, domain_of(F.col("source")), 0.5, WEIGHTS)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _level(above: str, keys: str, parents: str, level: str, weight: str) -> str:
    over = f"partition by {parents}" if parents else ""
    on = " and ".join(f"{above}.{k} is not distinct from n.{k}" for k in keys.split(", "))
    return f"""
n_{level} as (select {keys}, sum(cap) as c, max(b) as b, {weight} as w from {above} group by {keys}),
p_{level} as (select *, coalesce(sum(c) over ({over} order by c*1.0/w, {level} nulls first rows between unbounded preceding and 1 preceding), 0) as before, sum(w) over ({over} order by c*1.0/w, {level} nulls first rows between current row and unbounded following) as after from n_{level}),
f_{level} as (select *, c*after <= (b-before)*w as full_ from p_{level}),
s_{level} as (select *, coalesce(sum(case when full_ then c end) over ({over}), 0) as spent, sum(case when not full_ then w end) over ({over}) as open_ from f_{level}),
b_{level} as (select {keys}, case when full_ then c else ((b-spent)*w)//open_ end as b from s_{level}),
l_{level} as (select {above}.* exclude (b), n.b from {above} join b_{level} n on {on})"""


ORACLE = (
    r"""with d as (select doc_id, lang, source, case when regexp_extract(source, '([0-9]{1,9})$', 1) <> '' then 'd' || (cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int) % 4) else 'dx' end as domain, cast(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens from documents),
l0 as (select domain, lang, source, sum(n_tokens) as tokens, 2*sum(n_tokens) as cap, (select cast(floor(sum(n_tokens)*0.5) as hugeint) from d) as b from d group by all),"""
    + _level("l0", "domain", "", "domain", "case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end")
    + ","
    + _level("l_domain", "domain, lang", "domain", "lang", "case lang when 'en' then 5 when 'de' then 2 when 'fr' then 2 else 1 end")
    + ","
    + _level("l_lang", "domain, lang, source", "domain, lang", "source", "1")
    + """,
q as (select domain, lang, source, cast(b // tokens as bigint) as e, b - (b // tokens) * tokens as rest from l_source where tokens > 0),
o as (select d.*, q.e, q.rest, md5('11:' || q.e || ':' || coalesce(cast(d.doc_id as varchar), 'null')) as o from d join q on d.domain=q.domain and d.lang is not distinct from q.lang and d.source is not distinct from q.source),
r as (select *, sum(n_tokens) over (partition by domain, lang, source order by o) as run from o)
select doc_id, domain, lang, source, n_tokens, cast(e + case when run <= rest then 1 else 0 end as bigint) as copies from r where e + case when run <= rest then 1 else 0 end > 0
"""
)
