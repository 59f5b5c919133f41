"""URL lists with dates: each capture is judged by the entries that were active when it was fetched.

Entries are read as captures are: scheme, user, port, query and fragment go, the host is lower-cased and loses dots at its ends (and a leading "*."),
empty path steps go; what then has no host of two labels is refused (refused() tells which). List events (kind, value, action, day) become validity intervals: an add opens one, the next event of the same kind and
value closes it. A capture's keys are its URL without scheme, query and fragment, cut at each of its path steps (of those
numbers of steps that entries have), and its host's suffixes of at least two labels. Keys and intervals meet in an as-of join: equal key and
valid_from <= fetched < valid_to. Intervals and captures are also cut into spans of DAYS days, so an entry that changed often
meets a capture only with the changes of its span. The longest matching key decides; at equal length allow comes before block.

Everything here is built-in DataFrame functions.

Defined results: a null or odd URL has no key and no verdict but none; a null page_id or fetch time is kept (a null time
matches nothing); repeated captures each get a row; repeated events count once; an event closing nothing has no effect;
entries never removed are open-ended; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, with_columns

DAYS = 30


def host_of(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def _host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^(?:\*?\.)+|\.+$", "")


def _steps(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")


def entry_key(value: Column) -> Column:
    """The key that a list entry names: its host, with its path steps if it has some; null if it names none."""
    v = F.trim(value)
    url = F.when(v.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), v).otherwise(F.concat(F.lit("x://"), v))
    host, steps = _host(url), _steps(url)
    return F.when(host.rlike(r"^[^.\s]+(\.[^.\s]+)+$"), F.when(F.size(steps) > 0, F.concat(host, F.lit("/"), F.array_join(steps, "/"))).otherwise(host))


def refused(events: DataFrame) -> DataFrame:
    """The list events that name no key or have no day."""
    return events.filter(entry_key(F.col("value").cast("string")).isNull() | F.col("day").cast("date").isNull())


def depths_of(values: DataFrame) -> list[int]:
    """The numbers of path steps that entries `value` have: distinct small numbers, none above the longest entry's steps."""
    return sorted(r[0] for r in values.select((F.size(F.split("value", "/")) - 1).alias("n")).filter("n > 0").distinct().collect())


def keys(url: Column, depths: list[int] | None = None) -> Column:
    """array<string> of the keys that list entries may name: host suffixes of two labels or more, host/path prefixes;
    depths: only prefixes of so many steps."""
    host = _host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.when((host != "") & (n >= 2), F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))
    steps = _steps(url)
    m = F.size(steps)
    wanted = F.sequence(F.lit(1), m) if depths is None else F.filter(F.array(*[F.lit(n) for n in depths]).cast("array<int>"), lambda i: i <= m)
    prefixes = F.when((host != "") & (m >= 1), F.transform(wanted, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_distinct(F.concat(suffixes, prefixes)), F.array().cast("array<string>"))


def intervals(events: DataFrame) -> DataFrame:
    """(verdict, value, valid_from, valid_to) of events(verdict, value, action, day): action add or remove."""
    events = with_columns(events, {"verdict": "string", "value": "string", "action": "string", "day": "date"}).withColumn("value", entry_key(F.col("value"))).filter("day is not null and value is not null").distinct()
    # one event a day for each entry: an add on the day of a remove reopens it
    days = events.groupBy("verdict", "value", "day").agg(F.max(F.col("action") == "add").alias("added"))
    after = F.lead("day").over(W.partitionBy("verdict", "value").orderBy("day"))
    return days.withColumn("valid_to", after).filter("added").select("verdict", "value", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, url, fetched, verdict, rule, n_active) for each of captures(page_id, url, fetched)."""
    captures = with_columns(captures, {"page_id": "long", "url": "string", "fetched": "date"})
    captures = cut(captures.withColumn("row", F.monotonically_increasing_id()), "captures")  # both uses see the same numbers
    span = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / DAYS).cast("int")
    bounds = captures.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi"))
    listed = cut(intervals(events), "intervals")
    active = listed.crossJoin(F.broadcast(bounds)).filter("valid_from <= hi and coalesce(valid_to > lo, true)")  # bounds is one row
    last = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("hi")), F.col("hi"))
    active = active.withColumn("span", F.explode(F.sequence(span(F.greatest("valid_from", "lo")), span(last)))).drop("lo", "hi")
    asked = captures.select("row", "fetched", F.explode(keys(F.col("url"), depths_of(listed))).alias("value")).withColumn("span", span(F.col("fetched")))
    met = asked.join(active, ["value", "span"]).filter("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    best = F.max(F.struct(F.length("value").alias("n"), (F.col("verdict") == "allow").alias("allow"), F.col("value").alias("value"), F.col("verdict").alias("verdict")))
    verdicts = met.groupBy("row").agg(best.alias("best"), F.count("*").alias("n_active"))
    out = captures.join(verdicts, "row", "left")
    return out.select("page_id", "url", "fetched", F.coalesce("best.verdict", F.lit("none")).alias("verdict"), F.col("best.value").alias("rule"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))


#: List events and fetch dates of the test tables, as SQL that Spark and DuckDB share: hosts and their parents are listed by a
#: hash of the name, removed and added again; fetch dates follow page_id.
_CAPTURES = "select page_id, url, cast(date '2024-01-01' + cast(page_id % 366 as int) as date) as fetched from pages"
_NUMBER = "cast(length(value) * 7 + ascii(substring(value, 3, 1)) * 31 + ascii(substring(value, 4, 1)) * 13 as int)"
_EVENTS = f"""
select case when n % 5 = 0 then 'allow' else 'block' end as verdict, value, 'add' as action, cast(date '2023-12-01' + cast(n % 200 as int) as date) as day from v where n % 3 <> 0
union all select case when n % 5 = 0 then 'allow' else 'block' end, value, 'remove', cast(date '2024-03-01' + cast(n % 150 as int) as date) from v where n % 3 <> 0 and n % 2 = 0
union all select case when n % 5 = 0 then 'allow' else 'block' end, value, 'add', cast(date '2024-08-01' + cast(n % 90 as int) as date) from v where n % 6 = 2"""


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))
    host = host_of(F.col("url"))
    values = pages.select(F.explode(F.array(host, F.regexp_replace(host, r"^[^.]+\.", ""), F.concat(host, F.lit("/en")))).alias("value")).filter("value rlike '^[^./].*[.]'").distinct()
    v = values.withColumn("n", F.expr(_NUMBER))
    events = spark.sql(_EVENTS.replace("from v", "from {v}"), v=v)
    return judge(captures, events)


ORACLE = f"""
with h as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) as host from pages),
w as (select distinct value from (select unnest([host, regexp_replace(host, '^[^.]+\\.', ''), host || '/en']) as value from h) where regexp_matches(value, '^[^./].*[.]')),
v as (select value, {_NUMBER} as n from w),
e as ({_EVENTS}),
dd as (select verdict, value, day, max(action = 'add') as added from e group by all),
i as (select * from (select *, lead(day) over (partition by verdict, value order by day) as valid_to from dd) where added),
c as ({_CAPTURES}),
s as (select page_id, host, string_split(host, '.') as l, list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') as p from h),
k as (select distinct page_id, unnest(list_concat(list_transform(range(1, len(l)), lambda j: array_to_string(l[j:], '.')), list_transform(range(1, len(p) + 1), lambda j: host || '/' || array_to_string(p[1:j], '/')))) as value from s where host <> ''),
m as (select c.page_id, i.value, i.verdict from c join k using (page_id) join i on i.value = k.value and i.day <= c.fetched and (i.valid_to is null or c.fetched < i.valid_to)),
b as (select page_id, count(*) as n_active, max(struct_pack(n := length(value), allow := verdict = 'allow', value := value, verdict := verdict)) as best from m group by page_id)
select c.page_id, c.url, c.fetched, coalesce(best.verdict, 'none') as verdict, best.value as rule, cast(coalesce(n_active, 0) as bigint) as n_active from c left join b using (page_id)
"""
