"""Statistics over texts, chunks and order lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.functions import vector
from docloom.operators import stats
from docloom.registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
query = R.query

_EST = "cast(floor(length(regexp_replace(text, '[^가-힣]', '', 'g')) / 2 + (length(text) - length(regexp_replace(text, '[^가-힣]', '', 'g'))) / 4) as bigint)"
_S = "s as (select doc_id, text, " + _EST + " as tokens from documents where text is not null)"


def sized(x):
    return x.documents.filter("text is not null").select("doc_id", "text", "source", t.token_estimate(F.col("text")).alias("tokens"))


@query(f"with {_S} select count(*) as n, round(avg(tokens), 4) as mean, round(median(tokens), 4) as median, min(tokens) as least, max(tokens) as most, round(stddev_pop(tokens), 4) as std from s")
def stats_summary(x):
    c = F.col("tokens")
    return sized(x).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 4).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.stddev_pop(c), 4).alias("std"))


_BUCKET = "case when tokens < 64 then '1: <64' when tokens < 128 then '2: <128' when tokens < 256 then '3: <256' when tokens < 512 then '4: <512' when tokens < 2048 then '5: <2048' else '6: more' end"


@query(f"with {_S} select {_BUCKET} as bucket, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct from s group by 1")
def histogram_buckets(x):
    n = F.col("tokens")
    bucket = F.when(n < 64, "1: <64").when(n < 128, "2: <128").when(n < 256, "3: <256").when(n < 512, "4: <512").when(n < 2048, "5: <2048").otherwise("6: more")
    g = sized(x).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # six rows


@query(f"with {_S} select count(*) filter (tokens < 512) as below, count(*) filter (tokens between 512 and 2048) as within, count(*) filter (tokens > 2048) as above from s")
def token_range_counts(x):
    n = F.col("tokens")
    return sized(x).agg(F.count_if(n < 512).alias("below"), F.count_if(n.between(512, 2048)).alias("within"), F.count_if(n > 2048).alias("above"))


_CLASS = "case when blocks <= 7 then cast(blocks as varchar) when blocks <= 10 then '8~10' when blocks <= 20 then '11~20' else '21+' end"


@query(f"with b as (select distinct id, section_id, content from parser_blocks where section_id is not null), g as (select section_id, count(*) as blocks, avg(length(coalesce(content, ''))) as chars from b group by 1) select {_CLASS} as size_class, count(*) as sections, round(avg(chars), 4) as mean_chars from g group by 1")
def group_means(x):
    b = x.parser_blocks.filter("section_id is not null").select("id", "section_id", "content").distinct()
    g = b.groupBy("section_id").agg(F.count(F.lit(1)).alias("blocks"), F.avg(F.char_length(F.coalesce("content", F.lit("")))).alias("chars"))
    n = F.col("blocks")
    kind = F.when(n <= 7, n.cast("string")).when(n <= 10, "8~10").when(n <= 20, "11~20").otherwise("21+")
    return g.groupBy(kind.alias("size_class")).agg(F.count(F.lit(1)).alias("sections"), F.round(F.avg("chars"), 4).alias("mean_chars"))


@query("select round((avg(l_discount) - 0.05) / (stddev_samp(l_discount) / sqrt(count(l_discount))), 4) as t, count(l_discount) - 1 as df from lineitem")
def ttest_one_sample(x):
    c = F.col("l_discount")
    return x.lineitem.agg(F.round(stats.t_one_sample(c, 0.05), 4).alias("t"), (F.count(c) - 1).alias("df"))


@query(
    """with g as (select count(*) filter (l_returnflag = 'R') as na, count(*) filter (l_returnflag <> 'R') as nb, avg(l_quantity) filter (l_returnflag = 'R') as ma, avg(l_quantity) filter (l_returnflag <> 'R') as mb,
      var_samp(l_quantity) filter (l_returnflag = 'R') as va, var_samp(l_quantity) filter (l_returnflag <> 'R') as vb from lineitem)
    select round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 4) as t, na + nb - 2 as df from g"""
)
def ttest_ind(x):
    return x.lineitem.agg(F.round(stats.t_independent(F.col("l_quantity"), F.col("l_returnflag") == "R"), 4).alias("t"), (F.count("l_quantity") - 2).alias("df"))


@query("select round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 4) as t, count(*) - 1 as df from lineitem")
def ttest_paired(x):
    return x.lineitem.agg(F.round(stats.t_paired(F.col("l_discount"), F.col("l_tax")), 4).alias("t"), (F.count(F.lit(1)) - 1).alias("df"))


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept from lineitem group by 1")
def trend_slope(x):
    y, q = F.col("l_extendedprice"), F.col("l_quantity")
    return x.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope(y, q), 4).alias("slope"), F.round(F.regr_intercept(y, q), 2).alias("intercept"))


@query("select l_linestatus, round(avg(case when l_discount - l_tax > 0 then 1.0 else 0.0 end), 6) as improved from lineitem group by 1")
def improvement_ratio(x):
    return x.lineitem.groupBy("l_linestatus").agg(F.round(F.avg(F.when(F.col("l_discount") - F.col("l_tax") > 0, 1.0).otherwise(0.0)), 6).alias("improved"))


@query(
    f"""with {_S}, o as (select doc_id, tokens, row_number() over (order by tokens desc, doc_id) as a, row_number() over (order by tokens, doc_id) as b from s) select 'top' as side, doc_id, tokens from o where a <= 5 union all select 'bottom', doc_id, tokens from o where b <= 5"""
)
def top_bottom_n(x):
    d = sized(x).select("doc_id", "tokens")
    cut = lambda side, *o: d.orderBy(*o).limit(5).select(F.lit(side).alias("side"), "doc_id", "tokens")
    return cut("top", F.desc("tokens"), "doc_id").unionByName(cut("bottom", "tokens", "doc_id"))
