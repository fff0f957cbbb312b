"""Mixing sources to target shares of the tokens.

Method: a time-varying curriculum. Source s has the weight
``w_s(t) = share_s * (1 + tilt_s * (2t - 1))`` at time t of the training (0 to 1);
the tilts are centred, so that the weights sum to one at any time, and their
integral over the whole training is the target share. A text takes its place by
inverting the integral at its source's cumulative tokens, and all texts are
range-sorted by that position.

The total is the largest at which no source must repeat a text more often than
it may; with a larger ``total_tokens`` the scarce sources give all they can and
the report shows their actual shares.

Scale: tokens are counted by a map; running sums inside a source go over 4096
hash ranges of its texts, so that a source with a third of all rows is no
single sorted group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread
from .tokens import TOKENIZER, opened, shipped

RANGES, MAX_SOURCES = 4096, 100_000


def _sizer(ranks):
    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = opened(ranks)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            digest = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([len(enc.encode_ordinary(t)) for t in texts], pa.int64()), pa.array(digest, pa.binary())], names=["doc_id", "source", "n_tokens", "digest"])

    return size


def listed(targets: DataFrame) -> DataFrame:
    """(source, target_pct, max_repeats), one row a source.

    Of repeated rows of a source the largest target counts. Null and negative
    targets count as zero, null and negative repeat caps as no use.
    """
    return targets.filter("source is not null").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_pct", F.lit(0.0)), F.lit(0.0))).alias("target_pct"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))


def sized(texts: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every distinct text of a listed source.

    A text of several listed sources goes to the scarcest of them (the one whose
    tokens allow the smallest total), sources out of use last; of its ids there
    the least counts.
    """
    rows = spread(texts.select("doc_id", "source", "text").filter("doc_id is not null and source is not null and text <> ''"), "doc_id")
    t = materialize(listed(targets))
    if t.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = rows.join(F.broadcast(t.select("source")), "source", "left_semi")  # MAX_SOURCES rows at most
    one = rows.mapInArrow(_sizer(shipped(texts.sparkSession, path)), "doc_id bigint, source string, n_tokens bigint, digest binary").filter("n_tokens > 0")
    each = materialize(one.groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens")))
    most = F.when((F.col("target_pct") > 0) & (F.col("max_repeats") > 0), F.sum("n_tokens") * F.col("max_repeats") / F.col("target_pct"))
    scarce = each.join(F.broadcast(t), "source").groupBy("source", "target_pct", "max_repeats").agg(F.coalesce(most, F.lit(float("inf"))).alias("most")).select("source", "most")
    best = each.join(F.broadcast(scarce), "source").groupBy("digest").agg(F.min(F.struct("most", "source", "doc_id", "n_tokens")).alias("t"))
    return best.select("t.doc_id", "t.source", "t.n_tokens")


def budget(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per listed source: target, tokens at hand, tokens to use and tilt; one row a source."""
    t = listed(targets)
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    s = t.join(have, "source", "left").na.fill(0, ["tokens", "texts"])
    usable = (F.col("tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_pct") > 0)
    s = s.withColumn("usable", usable)
    everything = Window.partitionBy()  # one row a source
    share = F.when(usable, F.col("target_pct") / F.sum(F.when(usable, F.col("target_pct"))).over(everything)).otherwise(0.0)
    s = s.withColumn("share", share).withColumn("most", F.col("tokens") * F.col("max_repeats"))
    exact = F.min(F.when(usable, F.col("most") / F.col("share"))).over(everything)
    s = s.withColumn("total", F.coalesce(F.lit(total_tokens).cast("double"), exact, F.lit(0.0)))
    s = s.withColumn("demand", F.least(F.col("share") * F.col("total"), F.col("most")))
    # sources that may repeat more often grow in weight towards the end
    rank = F.when(usable, F.log(F.col("max_repeats") + 1.0))
    mean = F.sum(rank * F.col("share")).over(everything)
    s = s.withColumn("off", rank - mean)
    widest = F.max(F.abs("off")).over(everything)
    return s.withColumn("tilt", F.coalesce(F.when(widest > 0, 0.8 * F.col("off") / widest), F.lit(0.0))).drop("off")


def mixed(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The chosen texts (doc_id, source, repeat_no, n_tokens, position), range-sorted by position, and the budget."""
    sizes = materialize(sized(texts, targets, path))
    plan = materialize(budget(sizes, targets, total_tokens))
    use = plan.filter("usable").select("source", "tokens", "max_repeats", "demand", "tilt")
    h = F.xxhash64("doc_id", F.lit(11))
    rows = sizes.join(F.broadcast(use), "source").withColumn("h", h).withColumn("range", F.shiftright(F.col("h"), 52))
    by = rows.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_tokens"))
    # at most RANGES rows a source
    before = by.withColumn("before", F.sum("range_tokens").over(Window.partitionBy("source").orderBy("range")) - F.col("range_tokens")).drop("range_tokens")
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id")
    rows = rows.withColumn("run", F.sum("n_tokens").over(inside)).join(before, ["source", "range"])
    start = F.col("before") + F.col("run") - F.col("n_tokens")
    # repeat r of a text takes the tokens from r * tokens + start on; it is used if its middle lies within the demand
    times = F.least(F.col("max_repeats"), F.greatest(F.lit(0), F.floor((F.col("demand") - F.col("start") - F.col("n_tokens") / 2.0) / F.col("tokens")) + 1)).cast("int")
    rows = rows.withColumn("start", start).withColumn("times", times).filter("times > 0")
    copies = rows.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("times"))))
    x = F.least(F.lit(1.0), (F.col("start") + F.col("n_tokens") / 2.0 + (F.col("repeat_no") - 1) * F.col("tokens")) / F.col("demand"))
    a = F.col("tilt")
    # the share of the source's tokens due by time t is t + tilt * (t^2 - t); solved for t
    t = F.when(F.abs(a) < 1e-9, x).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * x)) / (2 * a))
    chosen = copies.select("doc_id", "source", "repeat_no", "n_tokens", F.round(t, 12).alias("position"))
    return chosen.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "repeat_no"), plan


def p7_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))[0]


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Per listed source the target and the share reached, the texts used and the most repeats of one."""
    got = chosen.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("repeat_no").alias("most_repeats"), F.count(F.when(F.col("repeat_no") == 1, 1)).alias("texts_used"))
    out = plan.select("source", "target_pct", "max_repeats", "texts", F.col("tokens").alias("source_tokens")).join(got, "source", "left").na.fill(0)
    share = 100.0 * F.col("used_tokens") / F.greatest(F.sum("used_tokens").over(Window.partitionBy()), F.lit(1))
    return out.withColumn("reached_pct", F.round(share, 4))


def p7_shares(spark, sf_dir: str) -> DataFrame:
    return shares(*mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")))


def p7_shares_of_all(spark, sf_dir: str) -> DataFrame:
    """The report for a total of all tokens of the listed sources, at which scarce sources give all they may and fall short of their targets."""
    texts, targets = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")
    total = sized(texts, targets).agg(F.sum("n_tokens").alias("n")).first().n or 0
    return shares(*mixed(texts, targets, total))
