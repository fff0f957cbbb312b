"""Groups of near-copies among short texts.

Method: fast similarity sketching. The words of a text, numbered by occurrence,
are the elements of a set, so that the Jaccard similarity of two sets is the
share of words in common counted with repetition. Rounds of hashed placement
throw every element into one of ``BINS`` bins with a value that grows with the
round; a bin keeps its least value. The first rounds place by hash, the last
ones fill bin after bin with every element, so all coordinates fill, and two
sketches agree in a coordinate with the probability of the similarity,
concentrated as for independent choices. ``BANDS`` bands of ``ROWS`` coordinates
are then joined on equality. Pairs that agree in less than ``CHECK_AGREE`` of one
bit of 128 coordinates are dropped in the join, of the others those below
``FULL_AGREE`` of all ``BINS`` bits and those whose sizes forbid the similarity; every
pair left is verified exactly on its words.

Scale: texts with the same words are one class, so copies meet once; the band
join moves about 22 bytes a class and band, keyed by one number, texts are read
for pairs that passed both tests only. A band shared by many different texts is
split by Spark's skew join. Sides of joins that grow with the data are never
broadcast, so that the plan is the same at every size.
A pair at similarity 0.70 shares a band with probability 0.992, at 0.72 with 0.996,
at 0.75 with 0.999; the two bit tests reject 5 in 1 000 of those at 0.70.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread

BINS, ROWS, BANDS = 192, 5, 26
CHECK_AGREE, FULL_AGREE = 98, 148
SIGNS = [f"chk{i}" for i in range(BINS // 64)]
WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed (word, occurrence) elements of all texts and the text that each belongs to."""
    words = [WORD.findall(t.lower()) for t in texts]
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.empty(len(owner), object)
    flat[:] = [w for ws in words for w in ws]
    codes, uniques = pd.factorize(flat)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in uniques], np.uint64)
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(codes)) - start[np.cumsum(new) - 1] if len(codes) else np.zeros(0, np.int64)
    return _mix(hashes[codes] + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), owner


def sketches(elems: np.ndarray, owner: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """n x bins values; every row is of a text with at least one element."""
    out = np.full((n, bins), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    empty = np.iinfo(np.uint64).max
    for i in range(2 * bins):
        h = _mix(elems ^ _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((h >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        np.minimum.at(flat, owner * bins + place, (_U(i) << _U(32)) | (h & _U(0xFFFFFFFF)))
        if i % 2 or i >= bins:
            open_ = (out == empty).any(1)
            if not open_.any():
                break
            going = open_[owner]
            if going.mean() < 0.8:
                elems, owner = elems[going], owner[going]
    return out


def signatures(elems: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums a text: equal for texts with the same words, whatever their order."""
    sums = np.zeros((2, n), np.uint64)
    np.add.at(sums[0], owner, _mix(elems))
    np.add.at(sums[1], owner, _mix(elems ^ _U(0xD6E8FEB86659FD93)))
    return sums[0].view(np.int64), sums[1].view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = (np.arange(ROWS, dtype=np.uint64) * _U(2) + _U(1)) * _U(0x9E3779B97F4A7C15)
    for batch in batches:
        for s in range(0, batch.num_rows, 2000):
            part = batch.slice(s, 2000)
            elems, owner = elements(part.column("text").to_pylist())
            having, owner = np.unique(owner, return_inverse=True)  # texts without a word have no near-copy
            n = len(having)
            if not n:
                continue
            sig1, sig2 = signatures(elems, owner, n)
            mixed = _mix(sketches(elems, owner, n))
            keys = (_mix((mixed[:, : ROWS * BANDS].reshape(n, BANDS, ROWS) * seeds).sum(2)) & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            bits = (mixed >> _U(7) & _U(1)).reshape(n, len(SIGNS), 64) << np.arange(64, dtype=np.uint64)
            check = np.bitwise_or.reduce(bits, axis=2).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("tbl").take(pa.array(having)), part.column("id").take(pa.array(having)), pa.array(sig1), pa.array(sig2), pa.array(np.bincount(owner, minlength=n).astype(np.int32)), *[pa.array(check[:, i]) for i in range(len(SIGNS))], bands],
                names=["tbl", "id", "sig1", "sig2", "words", *SIGNS, "bands"],
            )


_SKETCH = "tbl string, id bigint, sig1 bigint, sig2 bigint, words int, " + ", ".join(f"{c} bigint" for c in SIGNS) + ", bands array<int>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        elems, owner = elements(texts)
        sig1, sig2 = signatures(elems, owner, len(texts))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("tbl", "id", "text")], pa.array(sig1), pa.array(sig2)], names=["tbl", "id", "text", "sig1", "sig2"])


def in_common(a: str, b: str) -> tuple[int, int]:
    """Words of both and words of either, counted with repetition."""
    x, y = Counter(WORD.findall(a.lower())), Counter(WORD.findall(b.lower()))
    both = (x & y).total()
    return both, x.total() + y.total() - both


def _verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                both, either = in_common(a, b)
                good.append(both >= threshold * either - 1e-9)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("tbl", "class_a", "class_b")], names=["tbl", "class_a", "class_b"])

    return verify


def classes_and_pairs(texts: DataFrame, threshold: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """Members (tbl, class, id) of all classes of texts with the same words, and near pairs (tbl, class_a, class_b) of different classes.

    ``texts`` has (tbl, id, text). Rows with a null id or text and texts without
    a letter or digit are left out. Repeated rows count once; an id with several
    contents belongs to the class of each. A class is named by a 64-bit digest of
    its words; should two share it, both are verified and both linked.
    """
    source = texts.select("tbl", "id", "text").filter("id is not null and text is not null")
    sk = materialize(spread(source, "id").mapInArrow(_sketch_batches, _SKETCH))
    name = F.xxhash64("tbl", "sig1", "sig2")
    members = sk.select("tbl", name.alias("class"), "id").distinct()
    # copies have equal sketches
    reps = sk.groupBy("tbl", "sig1", "sig2").agg(*[F.first(c).alias(c) for c in ("words", *SIGNS, "bands")]).withColumn("class", name)
    # 48 bits of a key are enough to tell bands apart; what meets by chance fails the tests below
    bands = reps.select("tbl", "class", "chk0", "chk1", F.posexplode("bands").alias("band", "h")).select(F.shiftright(F.xxhash64("tbl", "band", "h"), 16).alias("h"), "class", "chk0", "chk1")
    agree = lambda *signs: F.lit(64 * len(signs)) - sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in signs), F.lit(0))
    meet = (F.col("a.h") == F.col("b.h")) & (F.col("a.class") < F.col("b.class")) & (agree("chk0", "chk1") >= CHECK_AGREE)
    cand = materialize(bands.alias("a").join(bands.alias("b"), meet).select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b")).distinct())
    side = lambda df, s: df.select(F.col("class").alias(f"class_{s}"), F.struct(*df.drop("class").columns).alias(s))
    ends = lambda df: df.select(F.col("class_a").alias("class")).union(df.select(F.col("class_b").alias("class"))).distinct()
    wanted = sk.select(name.alias("class"), "tbl", "words", *SIGNS).join(ends(cand).hint("merge"), "class", "left_semi").distinct()
    near_size = F.least("a.words", "b.words") >= threshold * F.greatest("a.words", "b.words") - 1e-9
    cand = cand.join(side(wanted, "a").hint("merge"), "class_a").join(side(wanted, "b").hint("merge"), "class_b").filter((F.col("a.tbl") == F.col("b.tbl")) & near_size & (agree(*SIGNS) >= FULL_AGREE))
    cand = materialize(cand.select(F.col("a.tbl").alias("tbl"), "class_a", "class_b"))
    # the text of one member of each class, told from the id's other texts by its signatures
    one = sk.select("tbl", name.alias("class"), "sig1", "sig2", "id").join(ends(cand).hint("merge"), "class", "left_semi").groupBy("tbl", "class", "sig1", "sig2").agg(F.min("id").alias("id"))
    one = materialize(one)
    signed = source.join(one.select("tbl", "id").distinct().hint("merge"), ["tbl", "id"], "left_semi").mapInArrow(_sign, "tbl string, id bigint, text string, sig1 bigint, sig2 bigint")
    content = signed.join(one.hint("merge"), ["tbl", "id", "sig1", "sig2"]).groupBy("class", "sig1", "sig2").agg(F.min("text").alias("text")).select("class", "text")
    both = cand.join(side(content, "a").hint("merge"), "class_a").join(side(content, "b").hint("merge"), "class_b").select("tbl", "class_a", "class_b", F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b"))
    return members, both.mapInArrow(_verifier(threshold), "tbl string, class_a bigint, class_b bigint").distinct()


def near_pairs(texts: DataFrame, threshold: float = 0.70) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: all pairs of ids whose texts reach the threshold, copies included.

    Its size is that of the pairs; ``near_groups`` gives the same links without expanding copies.
    """
    members, near = classes_and_pairs(texts, threshold)
    near = materialize(near)
    copied = members.groupBy("tbl", "class").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("tbl", "class")
    linked = near.select("tbl", F.col("class_a").alias("class")).union(near.select("tbl", F.col("class_b").alias("class"))).union(copied).distinct()
    members = materialize(members.join(linked.hint("merge"), ["tbl", "class"], "left_semi"))
    side = lambda s: members.select("tbl", F.col("class").alias(f"class_{s}"), F.col("id").alias(s))
    across = near.join(side("a").hint("merge"), ["tbl", "class_a"]).join(side("b").hint("merge"), ["tbl", "class_b"]).select("tbl", "a", "b")
    within = members.select("tbl", "class", F.col("id").alias("a")).join(members.select("tbl", "class", F.col("id").alias("b")), ["tbl", "class"]).filter("a < b").select("tbl", "a", "b")
    pairs = across.unionByName(within).filter("a <> b")
    return pairs.select("tbl", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(tbl, id, group_id): the least id of each connected component, by label spreading and pointer jumping."""
    both = materialize(edges.select("tbl", F.col("id_a").alias("id"), F.col("id_b").alias("nb")).unionByName(edges.select("tbl", F.col("id_b").alias("id"), F.col("id_a").alias("nb"))))
    labels = materialize(both.groupBy("tbl", "id").agg(F.least(F.min("nb"), F.col("id")).alias("label")))
    while True:
        seen = both.join(labels.select("tbl", F.col("id").alias("nb"), F.col("label").alias("theirs")), ["tbl", "nb"])
        least = seen.groupBy("tbl", "id").agg(F.min("theirs").alias("theirs"))
        near = labels.join(least, ["tbl", "id"]).select("tbl", "id", F.col("label").alias("was"), F.least("label", "theirs").alias("label"))
        jump = labels.select("tbl", F.col("id").alias("label"), F.col("label").alias("far"))
        new = materialize(near.join(jump, ["tbl", "label"], "left").select("tbl", "id", "was", F.least(F.col("label"), F.coalesce("far", "label")).alias("label")))
        labels = new.drop("was")
        if not new.filter("label <> was").limit(1).count():
            return labels.withColumnRenamed("label", "group_id")


def near_groups(texts: DataFrame, threshold: float = 0.70) -> DataFrame:
    """(table_name, id, class_id, group_id, links): every record that has a near-copy.

    ``class_id`` is the least id with the same words, ``group_id`` the least
    ``class_id`` of all records reachable by near pairs, ``links`` the near pairs
    between the record's class and other classes. Copies are not expanded into
    pairs; an id with several contents has a row for the class of each.
    """
    members, near = classes_and_pairs(texts, threshold)
    near = materialize(near)
    size = members.groupBy("tbl", "class").agg(F.min("id").alias("class_id"), F.max("id").alias("high"))
    both = near.select("tbl", F.col("class_a").alias("class")).unionByName(near.select("tbl", F.col("class_b").alias("class")))
    links = both.groupBy("tbl", "class").agg(F.count(F.lit(1)).alias("links"))
    kept = materialize(size.join(links, ["tbl", "class"], "left").filter("links is not null or class_id < high").select("tbl", "class", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")))
    group = components(near.select("tbl", F.col("class_a").alias("id_a"), F.col("class_b").alias("id_b"))).select("tbl", F.col("id").alias("class"), "group_id")
    named = kept.join(group, ["tbl", "class"], "left").withColumn("group", F.coalesce("group_id", "class")).drop("group_id")
    least = named.groupBy("tbl", "group").agg(F.min("class_id").alias("group_id"))
    out = members.join(named.join(least, ["tbl", "group"]).drop("group"), ["tbl", "class"])
    return out.select(F.col("tbl").alias("table_name"), "id", "class_id", "group_id", "links").distinct()


def catalogue_texts(spark, sf_dir: str) -> DataFrame:
    """(tbl, id, text) of the propositions and the text blocks."""
    props = spark.read.parquet(f"{sf_dir}/parser_propositions.parquet").select(F.lit("parser_propositions").alias("tbl"), "id", F.col("proposition").alias("text"))
    blocks = spark.read.parquet(f"{sf_dir}/parser_blocks.parquet").filter("block_type = 'text'").select(F.lit("parser_blocks").alias("tbl"), "id", F.col("content").alias("text"))
    return props.unionByName(blocks)


def p1_found(spark, sf_dir: str) -> DataFrame:
    return near_pairs(catalogue_texts(spark, sf_dir)).withColumnRenamed("tbl", "table_name")


def p1_groups(spark, sf_dir: str) -> DataFrame:
    return near_groups(catalogue_texts(spark, sf_dir))
