"""URL filters (operator 10): host and path rules, and for URLs without a rule a character language-model ratio.

Two smoothed variable-order Markov models of characters are counted, one over distinct URLs that a rule allows, one
over those that a rule blocks, whole but for the scheme. P(c | h) backs off from five characters of context to four and
so on to none and to a uniform choice, by Witten-Bell weights. A URL's score is the difference of its log-likelihoods
over its length. The cut between the classes lies midway between the mean scores of URLs held out from counting; the
models that judge are counted over all of them.

The table of contexts and characters grows with the URLs: it is counted with partial sums, its orders are joined by key,
and URLs meet it by key. Nothing of it is broadcast or collected but one row of totals. Everything is DataFrame
operations. Log-likelihoods are rounded to whole millionths, so sums don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm.util import discard, partitions, stored

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
ORDER = 5  # characters of context
URLS = 20_000  # that a task spells out into positions, about
BEGIN, END = "\x02", "\x03"
HELD = "012"  # first hex digits of a URL's MD5 that hold it out while the cut is calibrated
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts by class (1: allowed, 0: blocked): n of all URLs with a rule, m without those held out.
COUNTS = ("n1", "n0", "m1", "m0")


def with_parts(url: Column) -> Column:
    """struct<host, path, rule> of a URL; rule is the index of the longest fitting one, or null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    host, path = F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))
    rule = F.lit(None).cast("int")
    for i in sorted(range(len(RULES)), key=lambda i: len(RULES[i][1] + RULES[i][2])):
        _, h, p = RULES[i]
        rule = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(i)).otherwise(rule)
    return F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"))


def labelled(rule: Column) -> Column:
    """1 if the rule allows, 0 if it blocks, null without one."""
    allow = [i for i, r in enumerate(RULES) if r[0] == "allow"]
    return F.when(rule.isNotNull(), rule.isin(allow).cast("int"))


def model_text(url: Column) -> Column:
    """What the models read: a URL behind its scheme, A-Z in lower case."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(url)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def positions(urls: DataFrame) -> DataFrame:
    """Each character of text, and the end, with the ORDER characters before it: context, c."""
    symbols = F.concat(F.array_repeat(F.lit(BEGIN), ORDER), F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), F.array(F.lit(END)))
    at = lambda i: F.struct(F.array_join(F.slice("symbols", i, F.lit(ORDER)), "").alias("context"), F.get("symbols", i + (ORDER - 1)).alias("c"))
    each = urls.withColumn("symbols", symbols).withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.size("symbols") - ORDER), at)))
    return each.select(*(c for c in urls.columns if c != "text"), "at.context", "at.c")


def backed_off(count: Column, total: Column, kinds: Column, p: Column) -> Column:
    return F.when(total > 0, (count + kinds * p) / (total + kinds)).otherwise(p)


def gram_scores(urls: DataFrame) -> DataFrame:
    """(context, c, final, held): the differences of log-likelihoods in millionths, of the models over all URLs with a
    rule and of those without the held ones, for all that occurs in urls."""
    is_class = lambda k, out: (F.col("label") == int(k)) & (~F.col("held") if out else F.lit(True))
    grams = positions(urls.select("label", "held", "text")).groupBy("context", "c").agg(*(F.count(F.when(is_class(n[1], n[0] == "m"), 1)).alias(n) for n in COUNTS))
    grams = stored(grams, "url-grams")
    levels = {ORDER: grams}
    for k in range(ORDER - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy(F.substring("context", 2, k).alias("context"), "c").agg(*(F.sum(n).alias(n) for n in COUNTS))
    sums = [x for n in COUNTS for x in (F.sum(n).alias(f"total_{n}"), F.count(F.when(F.col(n) > 0, 1)).alias(f"kinds_{n}"))]
    total = levels[0].agg(F.count("*").alias("symbols"), *sums).first()
    uniform = F.lit(1.0 / (total["symbols"] + 1))
    known = levels[0].select("c", *(backed_off(F.col(n), F.lit(total[f"total_{n}"] or 0), F.lit(total[f"kinds_{n}"] or 0), uniform).alias(f"p_{n}") for n in COUNTS)).withColumn("short", F.lit(""))
    for k in range(1, ORDER + 1):
        own = Window.partitionBy("context")  # a context has as many rows as characters follow it
        here = levels[k].withColumns({f"total_{n}": F.sum(n).over(own) for n in COUNTS} | {f"kinds_{n}": F.count(F.when(F.col(n) > 0, 1)).over(own) for n in COUNTS})
        here = here.withColumn("short", F.substring("context", 2, k - 1)).join(known, ["short", "c"])
        known = here.select(F.col("context").alias("short"), "c", *(backed_off(F.col(n), F.col(f"total_{n}"), F.col(f"kinds_{n}"), F.col(f"p_{n}")).alias(f"p_{n}") for n in COUNTS))
    micro = lambda a: F.round((F.log(f"p_{a}1") - F.log(f"p_{a}0")) * 1e6).cast("long")
    found = stored(known.select(F.col("short").alias("context"), "c", micro("n").alias("final"), micro("m").alias("calibrating")), "url-model")
    discard(grams)
    return found


def filter_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Judge every URL by the rules, else by the ratio of two language models counted from the rules' URLs.

    Returns every row and column of pages with host, path, rule (such as net/; null without one) and verdict (allow or
    block); columns of pages with these names are replaced, others may have any name. A null URL, or one without ://,
    has an empty host and path; the models read it as it is, a null one as an empty string. URLs of any length are read
    whole. Each distinct URL counts once in the models, however many rows have it. Where one class has no URL to
    calibrate by, the cut is 0. An empty table gives an empty result.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    url = F.col("url")
    urls = pages.select(F.col(f"`{url_col}`").alias("url")).distinct()
    held = F.coalesce(F.substring(F.md5(url), 1, 1).isin(list(HELD)), F.lit(False))
    urls = urls.select(url, labelled(with_parts(url)["rule"]).alias("label"), held.alias("held"), model_text(url).alias("text"))
    urls = stored(urls.withColumn("place", F.monotonically_increasing_id()), "urls")
    # a URL becomes many rows, so a file of URLs is too much for a task
    spread = urls.repartition(max(partitions(pages.sparkSession), -(-urls.count() // URLS)))
    grams = gram_scores(spread)
    judged = spread.filter("label is null or held").select("place", "label", "text")
    points = positions(judged).join(grams, ["context", "c"]).groupBy("place", "label").agg(F.round(F.sum(F.when(F.col("label").isNull(), F.col("final")).otherwise(F.col("calibrating"))) / F.count("*")).cast("long").alias("points"))
    points = stored(points, "url-scores")
    means = {r["label"]: r["total"] / r["n"] for r in points.filter("label is not null").groupBy("label").agg(F.sum("points").alias("total"), F.count("*").alias("n")).collect()}
    cut = (means[0] + means[1]) / 2 if len(means) == 2 else 0.0
    free = points.filter("label is null").join(urls.select("place", "url"), "place").select(F.coalesce("url", F.lit("")).alias("key"), F.col("url").isNull().alias("none"), "points")
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(f"`{url_col}`").alias("url"))
    rows = rows.withColumn("parts", with_parts(url))
    # URLs with a rule need no partner; their keys are spread so that they meet in no one task
    key = F.when(F.col("parts.rule").isNull(), F.coalesce(url, F.lit(""))).otherwise(F.concat(F.lit("\u0000"), url))
    rows = rows.select("row", "parts", key.alias("key"), url.isNull().alias("none")).join(free, ["key", "none"], "left")
    rule = F.col("parts.rule")
    name = F.coalesce(*(F.when(rule == i, F.lit(h + p)) for i, (_, h, p) in enumerate(RULES)))
    by_rule = F.when(labelled(rule) == 1, "allow").otherwise("block")
    by_model = F.when(F.col("points") >= F.lit(cut), "allow").otherwise("block")
    return rows.select(*(F.col("row")[c].alias(c) for c in pages.columns), "parts.host", "parts.path", name.alias("rule"), F.when(rule.isNotNull(), by_rule).otherwise(by_model).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    order = sorted(range(len(RULES)), key=lambda i: -len(RULES[i][1] + RULES[i][2]))
    case = "case " + " ".join(f"when (host = '{RULES[i][1]}' or ends_with(host, '.{RULES[i][1]}')) and starts_with(path, '{RULES[i][2]}') then {i}" for i in order) + " end"
    allow = ", ".join(str(i) for i, r in enumerate(RULES) if r[0] == "allow")
    names = "case rule " + " ".join(f"when {i} then '{h + p}'" for i, (_, h, p) in enumerate(RULES)) + " end"
    held = ", ".join(f"'{x}'" for x in HELD)
    each = lambda form: ", ".join(form.format(n=n) for n in COUNTS)
    levels, models = [], []
    for k in range(ORDER + 1):
        levels.append(f"g{k} as (select right(h, {k}) as h, c, {each('sum({n}) as {n}')} from g group by all)")
        sums = each("sum({n}) over (partition by h) as total_{n}, count(*) filter (where {n} > 0) over (partition by h) as kinds_{n}")
        source = f"(select *, {sums} from g{k})"
        if k:
            parts = [f"case when total_{n} > 0 then (x.{n} + kinds_{n} * p_{n}) / (total_{n} + kinds_{n})::double else p_{n} end as p_{n}" for n in COUNTS]
            models.append(f"p{k} as (select x.h, x.c, {', '.join(parts)} from {source} x join p{k - 1} y on y.c = x.c and y.h = right(x.h, {k - 1}))")
        else:
            parts = [f"case when total_{n} > 0 then ({n} + kinds_{n} * (1.0::double / (v + 1))) / (total_{n} + kinds_{n})::double else 1.0::double / (v + 1) end as p_{n}" for n in COUNTS]
            models.append(f"p0 as (select h, c, {', '.join(parts)} from {source}, (select count(*) as v from g0))")
    micro = lambda a: f"cast(round((ln(p_{a}1) - ln(p_{a}0)) * 1e6) as bigint)"
    return rf"""
with a as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host from a),
q0 as (select page_id, url, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') as path from b),
q as (select *, {case} as rule from q0),
u as (select distinct url, case when rule is not null then rule in ({allow}) end as label, coalesce(substr(md5(url), 1, 1) in ({held}), false) as held from q),
t as (select url, label, held, repeat(chr(2), {ORDER}) || translate(case when url is null then '' when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else url end, '{_UPPER}', '{_LOWER}') || chr(3) as s from u),
c as (select url, label, held, substr(s, i, {ORDER}) as h, substr(s, i + {ORDER}, 1) as c from (select *, unnest(range(1, length(s) - {ORDER} + 1)) as i from t)),
g as (select h, c, count(*) filter (where label) as n1, count(*) filter (where not label) as n0, count(*) filter (where label and not held) as m1, count(*) filter (where not label and not held) as m0 from c group by all),
{", ".join(levels)},
{", ".join(models)},
m as (select h, c, {micro("n")} as final, {micro("m")} as calibrating from p{ORDER}),
s as (select url, label, cast(round(sum(case when label is null then final else calibrating end)::double / count(*)) as bigint) as points from c join m using (h, c) where label is null or held group by all),
e as (select sum(points) filter (where label)::double / count(*) filter (where label) as good, sum(points) filter (where not label)::double / count(*) filter (where not label) as bad from s),
cut as (select coalesce((good + bad) / 2, 0) as x from e)
select page_id, q.host, q.path, {names} as rule,
  case when rule is not null then case when rule in ({allow}) then 'allow' else 'block' end when points >= x then 'allow' else 'block' end as verdict
from q left join s on q.url is not distinct from s.url and s.label is null, cut
"""


ORACLE_SQL = _sql()
