"""URL filter: rules first, then the ratio of two character language models.

Variable-order Markov models of accepted and rejected URLs share one count table.  A
probability of order L interpolates the counts after L-1 characters with the probability
of order L-1, down to a uniform one.  What a URL's character contributes depends on
the window of the last ``ORDER`` characters alone, so each distinct window is scored once, in
millionths, and a URL's score is the sum over its windows divided by their number.

The rules' own verdicts are the labels.  A fold of them is kept out of the counts and sets the
threshold: the score with the least sum of both error rates.

Defined cases: a null URL is the empty one; it has score 0; without labels all scores and
the threshold are 0 (allow); repeated rows get equal verdicts; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.llm.common import lower_ascii, materialise, table

ORDER, ALPHA, UNIFORM, MILLION = 5, 2.0, 256.0, 1_000_000
#: Thresholds are whole hundredths.
BIN = 10_000
PAD = "^"
#: (verdict, host, path); a short list, written into the plan.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and ruled (its verdict) and _s, the text the models read."""
    url = F.coalesce(F.col("url"), F.lit(""))
    out = df.withColumn("host", lower_ascii(F.regexp_extract(url, _PARTS, 1))).withColumn("path", F.regexp_extract(url, _PARTS, 2))
    out = out.withColumn("_s", lower_ascii(F.regexp_replace(url, r"(?s)^.*?://", "")))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return out.withColumn("rule", rule).withColumn("ruled", ruled)


def windows(s: Column) -> Column:
    """One window per character: it and the characters before it, padded at the start."""
    chars = F.concat(F.array_repeat(F.lit(PAD), ORDER - 1), F.filter(F.split(s, ""), lambda c: c != ""))
    return F.transform(F.sequence(F.lit(1), F.size(chars) - (ORDER - 1)), lambda i: F.array_join(F.slice(chars, i, F.lit(ORDER)), ""))


def exploded(urls: DataFrame, *keep: str) -> DataFrame:
    return urls.where(F.col("_s") != "").select(*keep, F.explode(windows(F.col("_s"))).alias("w"))


def window_scores(train: DataFrame, seen: DataFrame) -> DataFrame:
    """(w, score): for each distinct window of ``seen`` (w) the models' log ratio in millionths.

    ``train``: w, yes, no (counts of accepted and rejected URLs' windows).
    """
    length = F.explode(F.sequence(F.lit(1), F.lit(ORDER)))
    cut = lambda c: (F.expr("right(w, l)"), F.expr("left(right(w, l), l - 1)"))[c]
    grams = train.select("*", length.alias("l")).select("l", cut(0).alias("gram"), cut(1).alias("ctx"), "yes", "no")
    of_gram = materialise(grams.groupBy("l", "gram", "ctx").agg(F.sum("yes").alias("gy"), F.sum("no").alias("gn")), "url-grams")
    of_ctx = of_gram.groupBy("l", "ctx").agg(F.sum("gy").alias("cy"), F.sum("gn").alias("cn"))
    rows = seen.select("w", length.alias("l")).select("w", "l", cut(0).alias("gram"), cut(1).alias("ctx"))
    rows = rows.join(of_gram.drop("ctx"), ["l", "gram"], "left").join(of_ctx, ["l", "ctx"], "left")
    cells = [F.sum(F.when(F.col("l") == i, F.col(c))).alias(f"{c}{i}") for i in range(1, ORDER + 1) for c in ("gy", "gn", "cy", "cn")]
    wide = rows.groupBy("w").agg(*cells)

    def log_p(side: str) -> Column:
        p = F.lit(1.0 / UNIFORM)
        for i in range(1, ORDER + 1):
            p = (F.coalesce(f"g{side}{i}", F.lit(0)) + F.lit(ALPHA) * p) / (F.coalesce(f"c{side}{i}", F.lit(0)) + F.lit(ALPHA))
        return F.log(p)

    return wide.select("w", F.round((log_p("y") - log_p("n")) * MILLION).cast("long").alias("score"))


def threshold(marks: DataFrame) -> DataFrame:
    """One row: the score (in millionths) from which a URL is allowed; null without marks.

    ``marks``: score, yes, no per held-out URL.  Scores fall into few bins, and only
    those are ordered.
    """
    bins = marks.groupBy(F.floor(F.col("score") / BIN).cast("long").alias("b")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    below = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy()
    at = bins.select("b", F.coalesce(F.sum("yes").over(below), F.lit(0)).alias("lost"), F.coalesce(F.sum("no").over(below), F.lit(0)).alias("caught"),
                     F.sum("yes").over(all_of).alias("ny"), F.sum("no").over(all_of).alias("nn"))
    wrong = F.col("lost") * F.greatest("nn", F.lit(1)) + (F.col("nn") - F.col("caught")) * F.greatest("ny", F.lit(1))
    return at.agg(F.min_by(F.col("b") * BIN, F.struct(wrong.cast("double"), F.abs("b"), "b")).alias("t"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score; only ``url`` and ``page_id`` are read."""
    rows = url_parts(pages.select("page_id", "url"), rules).drop("url").checkpoint()
    held = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 1).isin("0", "1", "2")
    one = lambda v: F.when(F.col("ruled") == v, 1).otherwise(0).cast("long")
    labelled = rows.where(F.col("ruled").isNotNull()).select("_s", held.alias("held"), one("allow").alias("yes"), one("block").alias("no"))
    labelled = labelled.groupBy("_s", "held").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    train = exploded(labelled.where(~F.col("held")), "yes", "no").groupBy("w").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    asked = rows.where(F.col("ruled").isNull()).select("_s").union(labelled.where("held").select("_s")).distinct()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(tasks)  # few bytes become many rows: not to be gathered in one task
    parts = materialise(exploded(asked, "_s").groupBy("_s", "w").agg(F.count("*").alias("n")), "url-windows")
    scored = materialise(window_scores(train, parts.select("w").distinct()), "url-window-scores")
    scores = parts.join(scored, "w").groupBy("_s").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"))
    scores = materialise(scores, "url-scores")
    t = threshold(labelled.where("held").join(scores, "_s").select("score", "yes", "no"))
    t = materialise(t, "url-threshold")
    score = F.coalesce("score", F.lit(0.0))
    by_model = F.when(score >= F.coalesce(t.scalar(), F.lit(0)), F.lit("allow")).otherwise(F.lit("block"))
    return rows.join(scores, "_s", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"),
        F.when(F.col("ruled").isNull(), score / MILLION).alias("score"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6."""
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_P = "1.0/256.0"
for _i in range(1, ORDER + 1):
    _P = f"((coalesce(g@{_i}, 0) + 2.0::double * {_P}) / (coalesce(c@{_i}, 0) + 2.0::double))"
OP6_SQL = r"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path,
         translate(regexp_replace(coalesce(url, ''), '(?s)^.*?://', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as s
  from pages),
r(verdict, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
q as (
  select p.*, (select arg_max(rh || rp, length(rh || rp)) from r where (host = rh or host like '%.' || rh) and starts_with(path, rp)) as rule,
         (select arg_max(verdict, length(rh || rp)) from r where (host = rh or host like '%.' || rh) and starts_with(path, rp)) as ruled,
         substr(md5(coalesce(cast(page_id as varchar), '')), 1, 1) in ('0', '1', '2') as held
  from p),
win as (select *, unnest([substr('^^^^' || s, i, 5) for i in range(1, length(s) + 1)]) as w from q where s <> ''),
train as (select w, sum((ruled = 'allow')::int) as y, sum((ruled = 'block')::int) as n from win where ruled is not null and not held group by 1),
gram as (select l, right(w, l) as g, sum(y) as y, sum(n) as n from (select *, unnest([1, 2, 3, 4, 5]) as l from train) group by 1, 2),
ctx as (select l, left(g, l - 1) as c, sum(y) as y, sum(n) as n from gram group by 1, 2),
seen as (select w, unnest([1, 2, 3, 4, 5]) as l from (select distinct w from win where ruled is null or held)),
cell as (select seen.w, seen.l, gram.y as gy, gram.n as gn, ctx.y as cy, ctx.n as cn from seen
         left join gram on gram.l = seen.l and gram.g = right(seen.w, seen.l)
         left join ctx on ctx.l = seen.l and ctx.c = left(right(seen.w, seen.l), seen.l - 1)),
wide as (select w, CELLS from cell group by 1),
ws as (select w, cast(round((ln(PY) - ln(PN)) * 1000000) as bigint) as score from wide),
us as (select s, sum(score)::double / count(*) as score from (select distinct s from q where ruled is null or held) join
       (select s, unnest([substr('^^^^' || s, i, 5) for i in range(1, length(s) + 1)]) as w from (select distinct s from q where s <> '')) using (s) join ws using (w) group by 1),
bins as (select cast(floor(score / 10000) as bigint) as b, sum((ruled = 'allow')::int) as y, sum((ruled = 'block')::int) as n from q join us using (s) where ruled is not null and held group by 1),
cum as (select b, coalesce(sum(y) over (order by b rows between unbounded preceding and 1 preceding), 0) as lost,
              coalesce(sum(n) over (order by b rows between unbounded preceding and 1 preceding), 0) as caught, sum(y) over () as ny, sum(n) over () as nn from bins),
t as (select b * 10000 as t from cum order by lost * greatest(nn, 1) + (nn - caught) * greatest(ny, 1), abs(b), b limit 1)
select page_id, host, path, rule,
       coalesce(ruled, case when coalesce(us.score, 0) >= coalesce((select t from t), 0) then 'allow' else 'block' end) as verdict
from q left join us using (s)
""".replace("CELLS", ", ".join(f"sum({c}) filter (l = {i})::double as {c}{i}" for i in range(1, ORDER + 1) for c in ("gy", "gn", "cy", "cn"))).replace(
    "PY", _P.replace("@", "y")).replace("PN", _P.replace("@", "n"))
