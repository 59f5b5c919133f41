"""Personal data: base spans by fixed patterns, and identifiers found by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) come from regular expressions; positions are code points, from the lengths of
the pieces between the matches. The expressions start only where a match can start leftmost, and repeat possessively
where that changes nothing, so long runs cost linear time and no stack. Positions are running sums,
in time linear in the matches.

Bootstrapping: a mention is a run with a digit, at least MIN_LENGTH long. Its lexical patterns are the word left of it
with the signs between, if these assign (a colon, an equals sign or a quote), and the form of the mention itself (letters,
digits and signs run-length coded). Seed entities: mentions that overlap a base span; assigned ones of a form that credentials
have (SEED_FORMS); those assigned to a word for a password (SEED_WORDS). Rounds alternate over the pattern-instance graph: a
pattern's confidence is the smoothed mean of its instances', an instance's is that of its two patterns combined (noisy-or), and
instances of confidence ACCEPT count as found in the next round. A pattern needs SUPPORT instances. Accepted mentions outside
base spans are the found spans, of kind `id`; without rounds these are the seeds alone. All rounds are grouped
aggregations and joins over distinct (word, signs, form), never over texts or mentions.

Everything here is built-in DataFrame functions; no Python runs on executors.

Defined results: a null text is empty and has no span; repeated rows each get their spans; ids may be null; extra
columns are ignored (find) or kept (redact).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, cut, small_cut, with_columns

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, anchored at run starts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A text without the sign or run that a kind needs is not searched for it.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

MIN_LENGTH, ROUNDS, ACCEPT, PRIOR, SUPPORT = 8, 3, 0.8, 1.0, 5
#: Forms of credentials as they are issued (hexadecimal digests, prefixed keys, signed tokens), and words for passwords.
SEED_FORMS = r"^(?:(?=[0-9]*[a-f])(?=[a-f]*[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|[sr]k[-_](?:live|test)[-_][A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+)$"
SEED_WORDS = r"(?:pass(?:word|wd|phrase)?|pwd|secret|api_?key|access_?key|private_?key)$"
#: Signs between a word and a mention that make it a pattern.
ASSIGNS = "[=:\"']"
#: Elements of an array that running() folds one by one.
RUN = 32
#: Characters of a text that stand together when it is cut up for redaction.
BLOCK = 512
#: A run with a digit of at least MIN_LENGTH characters that neither spaces nor the signs around a value end.
_IN = r"[^\s\"'<>()\[\]{},;=:#$%&*|]"
MENTION = rf"(?:\G|(?<!{_IN}))(?=[^\s\"'<>()\[\]{{}},;=:#$%&*|0-9]*+[0-9]){_IN}{{{MIN_LENGTH},}}+"



def _bound(value: Column, f) -> Column:
    """f(value), where f may use its argument more than once and it is evaluated once."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, zero: Column, op, depth: int = 5) -> Column:
    """For each element of an array op over it and all before it. Runs of RUN elements are folded one by one, and their totals
    in the same way a level up, so n elements cost about n * RUN steps (up to RUN ** (depth + 1) of them)."""
    folded = lambda a, start, n: F.aggregate(F.slice(a, start, n), zero, lambda x, y: op(x, y))
    few = lambda a: F.transform(a, lambda x, i: folded(a, F.lit(1), i + 1))
    if not depth:
        return _bound(values, few)
    run = lambda i: F.floor(i / RUN).cast("int")
    totals = lambda a: F.transform(F.sequence(F.lit(0), run(F.size(a) - 1)), lambda c: folded(a, c * RUN + 1, F.lit(RUN)))
    upto = lambda a, before: F.transform(a, lambda x, i: op(F.when(i >= RUN, F.get(before, run(i) - 1)).otherwise(zero), folded(a, run(i) * RUN + 1, i - run(i) * RUN + 1)))
    many = lambda a: _bound(running(totals(a), zero, op, depth - 1), lambda before: upto(a, before))
    return _bound(values, lambda a: F.when(F.size(a) <= RUN, few(a)).otherwise(many(a)))


def _spans(text: Column, pattern: str, keep, before: int = 0) -> Column:
    """array<struct<start, end, v, left>> of the matches that keep(match) holds for; left: up to `before` characters of what
    stands between the match before and this one."""
    piece = lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("v"), (F.substring(g, -before, before) if before else F.lit("")).alias("left"))
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), piece)  # one more gap than matches
    length = lambda p: F.coalesce(F.length(p["v"]), F.lit(0))
    ends = lambda p: running(F.transform(p, lambda x: x["gap"] + length(x)), F.lit(0), lambda x, y: x + y)
    span = lambda x, end: F.struct((end - length(x)).alias("start"), end.alias("end"), x["v"].alias("v"), x["left"].alias("left"))
    return F.filter(_bound(pieces, lambda p: F.zip_with(p, ends(p), span)), lambda x: x["v"].isNotNull() & keep(x["v"]))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    digits = F.transform(F.filter(F.split(F.reverse(_digits(v)), ""), lambda d: d != ""), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


KEEP = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}
_NONE = "array<struct<start:int,end:int,v:string,left:string>>"


def _as_spans(found: Column, rank: Column, kind: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank, kind, x["end"].alias("end")))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, kind, end>> of a text's base spans by start, then kind as listed."""
    parts = []
    for rank, kind in enumerate(KINDS):
        found = F.when(text.rlike(NEEDS[kind]), _spans(text, PATTERNS[kind], KEEP[kind])).otherwise(F.array().cast(_NONE))
        named = (F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
        parts.append(_as_spans(found, *named))
    return F.array_sort(F.concat(*parts))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _form(v: Column) -> Column:
    """A mention's shape: runs of letters, hex letters with digits, digits, and its signs, with rounded lengths."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")
    return F.concat(F.when(v.rlike("^[0-9a-f]+$"), "hex").when(v.rlike("^[A-Z0-9]+$"), "CAPS").when(v.rlike("^[0-9]+$"), "num").otherwise(F.regexp_replace(plain, r"(.)\1+", "$1+")), F.lit(":"), (F.length(v) / 4).cast("int").cast("string"))


def scored(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """graph(word, signs, form, p, n) with conf: p of the n mentions are seeds. A group of a conf of ACCEPT or more is accepted."""
    graph = graph.withColumn("context", F.when((F.col("word") != "") & F.col("signs").rlike(ASSIGNS), F.concat_ws("|", "word", "signs"))).withColumn("conf", F.col("p") / F.col("n"))
    graph = cut(graph, "graph")
    for _ in range(rounds):
        mean = lambda c: graph.filter(F.col(c).isNotNull()).groupBy(c).agg((F.sum(F.col("conf") * F.col("n")) / (F.sum("n") + PRIOR)).alias(f"{c}_conf"), F.sum("n").alias(f"{c}_n")).filter(F.col(f"{c}_n") >= SUPPORT).drop(f"{c}_n")
        joined = graph.join(mean("context"), "context", "left").join(mean("form"), "form", "left")
        both = 1 - (1 - F.coalesce("context_conf", F.lit(0.0))) * (1 - F.coalesce("form_conf", F.lit(0.0)))
        graph = cut(joined.withColumn("conf", F.greatest("conf", F.when(both >= ACCEPT, both).otherwise(F.lit(0.0)))).select(*graph.columns), "graph")
    return graph


def discovered(found: DataFrame, row: str, rounds: int = ROUNDS) -> DataFrame:
    """(row, start, end) of mentions outside base spans that bootstrapping accepts; found (row, start, end, word, signs, form, based,
    seed): a written table."""
    # one row for each distinct (word, signs, form): hot contexts shrink before they are joined
    graph = scored(found.groupBy("word", "signs", "form").agg(F.count_if("seed").alias("p"), F.count("*").alias("n")), rounds)
    accepted = graph.filter(F.col("conf") >= ACCEPT).select("word", "signs", "form")
    others = found.filter("not based")
    return others.filter("seed").select(row, "start", "end").unionByName(others.filter("not seed").join(accepted, ["word", "signs", "form"], "left_semi").select(row, "start", "end"))


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_key, base, found): base spans and the spans that bootstrapping adds, for each row of docs(doc_id, text).
    text_key is a hash of the text; rows of equal doc_id and text have equal spans."""
    docs = with_columns(docs, {"doc_id": "long", "text": "string"}).withColumn("row", F.monotonically_increasing_id())
    with_base = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("base", base_spans(F.col("text")))
    # one pass over the texts: mentions stay beside their row as an array, texts are not written
    listed = cut(with_mentions(with_base).select("row", "doc_id", F.xxhash64("text").alias("text_key"), "base", "mentions"), "mentions")
    found = discovered(listed.select("row", F.explode("mentions").alias("m")).select("row", "m.*"), "row", rounds)
    spans = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit("id").alias("kind"), "end"))).alias("found"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return listed.select("row", "doc_id", "text_key", "base").join(spans, "row", "left").select("doc_id", "text_key", "base", F.coalesce("found", none).alias("found"))


def _events(mentions: Column) -> Column:
    """Base spans and mentions as one array by start, base spans first."""
    none = [F.lit(None).cast("string").alias(c) for c in ("word", "signs", "form", "v")]
    bases = F.transform("base", lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("mention"), b["end"].alias("end"), *none))
    return F.array_sort(F.concat(bases, F.transform(mentions, lambda m: F.struct(m["start"].alias("start"), F.lit(1).alias("mention"), m["end"].alias("end"), *[m[c].alias(c) for c in ("word", "signs", "form", "v")]))))


def _overlaps(events: Column) -> Column:
    """For each event whether a base span overlaps it: the furthest end of those that start up to it, and the next start after it."""
    none = F.lit(None).cast("int")
    furthest = running(F.transform(events, lambda e: F.when(e["mention"] == 0, e["end"])), none, F.greatest)
    following = F.reverse(running(F.transform(F.reverse(events), lambda e: F.when(e["mention"] == 0, -e["start"])), none, F.greatest))
    around = F.arrays_zip(furthest.alias("end"), following.alias("start"))
    return F.zip_with(events, around, lambda e, x: F.coalesce(x["end"] > e["start"], F.lit(False)) | F.coalesce(-x["start"] < e["end"], F.lit(False)))


def with_mentions(docs: DataFrame) -> DataFrame:
    """docs(text, base) with mentions array<struct<start, end, word, signs, form, based, seed, mention>>; based: a base span overlaps it.
    Step by step as columns of their own, so that each is worked out once."""
    text = F.col("text")
    cand = F.when(text.rlike("[0-9]"), _spans(text, MENTION, lambda v: F.lit(True), 24)).otherwise(F.array().cast(_NONE))
    # where little stands between two mentions, the one before is part of the context
    tail = lambda i: F.when(i > 0, F.right(F.get("cand", i - 1)["v"], F.lit(24))).otherwise("")
    context = lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["v"].alias("v"), F.right(F.concat(tail(i), m["left"]), F.lit(24)).alias("left"))
    lexical = lambda m: F.struct(
        m["start"].alias("start"),
        m["end"].alias("end"),
        F.lower(F.regexp_extract(m["left"], r"([\p{L}_]{0,16})[^\p{L}_]{0,4}$", 1)).alias("word"),
        F.regexp_extract(F.right(m["left"], F.lit(4)), r"([^\p{L}0-9]{0,4})$", 1).alias("signs"),
        _form(m["v"]).alias("form"),
        m["v"].alias("v"),
    )
    assigned = lambda e: e["signs"].rlike(ASSIGNS) & (e["word"].rlike(SEED_WORDS) | e["v"].rlike(SEED_FORMS))
    shown = lambda e, based: F.struct(*[e[c].alias(c) for c in ("start", "end", "word", "signs", "form")], based.alias("based"), (based | assigned(e)).alias("seed"), e["mention"].alias("mention"))
    steps = docs.withColumn("cand", cand).withColumn("near", F.transform("cand", context)).withColumn("events", _events(F.transform("near", lexical)))
    steps = steps.withColumn("over", F.when(F.size("base") == 0, F.transform("events", lambda e: F.lit(False))).otherwise(_overlaps(F.col("events"))))
    return steps.withColumn("mentions", F.filter(F.zip_with("events", "over", shown), lambda e: e["mention"] == 1)).drop("cand", "near", "events", "over")


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text cut into blocks; only the blocks that hold them are touched."""
    low = F.floor(start / BLOCK).cast("int")
    held = F.slice(blocks, low + 1, F.greatest(F.floor((end - 1) / BLOCK).cast("int") - low + 1, F.lit(0)))
    return F.when(end > start, F.substring(F.array_join(held, ""), start - low * BLOCK + 1, end - start)).otherwise("")


def replaced(docs: DataFrame, spans: str) -> DataFrame:
    """docs with each of the spans (array<struct<start, rank, kind, end>> by start; null: none) of text replaced by its kind in
    brackets; of overlapping spans the first counts, and all go."""
    some = F.col(spans).isNotNull()
    steps = docs.withColumn("__ends", F.when(some, running(F.transform(spans, lambda x: x["end"]), F.lit(0), F.greatest)))
    steps = steps.withColumn("__blocks", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    at = lambda i: F.when(i > 0, F.get("__ends", i - 1)).otherwise(0)
    part = lambda x, i: F.when(x["start"] >= at(i), F.concat(_between(F.col("__blocks"), at(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
    whole = F.concat(F.array_join(F.transform(spans, part), ""), _between(F.col("__blocks"), F.element_at("__ends", -1), F.length("text")))
    return steps.withColumn("text", F.when(some, whole).otherwise(F.col("text"))).drop("__ends", "__blocks")


@beside("doc_id", "text", "n_chars")
def redact(docs: DataFrame) -> DataFrame:
    """docs with every base and found span of text replaced by its kind in brackets; other columns unchanged.
    Overlapping spans are one, of the first kind by start."""
    names = docs.columns
    rows = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    spans = find(docs).withColumn("__spans", F.array_sort(F.concat("base", "found"))).filter(F.size("__spans") > 0)
    spans = spans.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("text_key").alias("__text")).agg(F.first("__spans").alias("__spans"))
    changed = replaced(rows.join(small_cut(spans, "spans"), ["__id", "__text"], "left"), "__spans")
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.select(*names)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_count("base", kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "found"))).alias("spans"))
