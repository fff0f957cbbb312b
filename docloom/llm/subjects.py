"""Subject areas of documents.

Method: complement naive Bayes, trained on the labelled documents, refined by
expectation-maximization over the sentences of all documents, and calibrated so
that each area gets a posterior of its own. A sentence's posterior comes from
the complement weights of its words and its document's prior: labels, else the
unreliable category, whose worth is estimated from the labelled documents, and what
the labelled documents of its document type deal with. A document's share of an area
is the mean over its sentences. A logistic curve turns shares into posteriors; it is
fitted on labelled documents, each scored by a model that was trained without the
half of them that it belongs to.

Scale: texts are read once. A word is coded by a hash of ``CODES`` values; codes that
occur ``MIN_COUNT`` times or more, whatever their rank or language, share ``BUCKETS``
weights, so that the model (buckets x areas) has a fixed size. Scripts without spaces
give pairs of characters. The passes read the codes; a pass sends one row a bucket and
task to an aggregation, from at most two tasks a core. The calibration sample (``CALIBRATION``
labelled documents) and the document types (``TYPES`` most frequent) are bounded.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread

CODES, MIN_COUNT, BUCKETS = 1 << 22, 5, 1 << 18
CALIBRATION, TYPES, MAX_AREAS = 50_000, 1000, 62
ITERATIONS, ALPHA, SHARE, SHARPNESS = 8, 0.5, 0.2, 10.0
# Behind a sign and white space, behind a wide sign, at a blank line; led by one set of characters, which the search looks for quickly.
SENTENCE = re.compile(r"[.!?。！？\n](?:(?<=[.!?])\s+|(?<=[。！？])|(?<=\n)\s*\n)")
# Runs of anything but white space, digits, punctuation and signs; marks belong to their letters.
WORD = re.compile(r"[^\s\d!-/:-@\[-`{-~\u00A1-\u00BF\u00D7\u00F7\u0964\u0965\u2000-\u206F\u2190-\u2BFF\u3000-\u3020\u30FB\uFE30-\uFE4F\uFF01-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65]{2,}")
UNSPACED = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF]")


def words_of(text: str) -> list[str]:
    """Lower-cased words; of scripts without spaces all pairs of neighbouring characters."""
    words = WORD.findall(text.lower())
    if text.isascii() or not UNSPACED.search(text):
        return words
    return [x for w in words for x in ([w[i : i + 2] for i in range(len(w) - 1)] if UNSPACED.search(w) else [w])]


def code_of(word: str) -> int:
    return zlib.crc32(word.encode()) & (CODES - 1)


class _Codes(dict):
    """Codes of words, kept."""

    def __missing__(self, word: str) -> int:
        self[word] = code = code_of(word)
        return code


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Codes()
    for batch in batches:
        codes, sizes = [], []
        for text in batch.column("content").to_pylist():
            flat, lens = [], []
            for s in SENTENCE.split(text):
                words = words_of(s)
                if words:
                    flat.extend(map(known.__getitem__, words))
                    lens.append(len(words))
            codes.append(np.array(flat, np.uint32).tobytes())
            sizes.append(np.array(lens, np.uint32).tobytes())
            if len(known) > 500_000:
                known.clear()
        yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("id"), pa.array(codes, pa.binary()), pa.array(sizes, pa.binary())], names=["document_id", "id", "codes", "sizes"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CODES, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint32), minlength=CODES)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])


def _sentences(batch: pa.RecordBatch, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words with a live code, the sentence of each, in order, and the row of each sentence with such a word."""
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint32).astype(np.intp)
    raw = batch.column("sizes").to_pylist()
    sizes = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
    kept = live[codes]
    sentence = np.repeat(np.arange(len(sizes)), sizes)[kept]
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    rows = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])[sentence[first]]
    return codes[kept] & (BUCKETS - 1), np.repeat(np.arange(len(first)), np.diff(first, append=len(sentence))), rows


def _by_area(weights: np.ndarray | None) -> np.ndarray | None:
    return None if weights is None else np.ascontiguousarray(weights.T, np.float64)


def _posterior(weights: np.ndarray, codes: np.ndarray, sentence: np.ndarray, prior: np.ndarray | None) -> np.ndarray:
    """Areas x sentences, from areas x buckets and the words in the order of their sentences."""
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    score = np.stack([np.add.reduceat(w.take(codes), first) for w in weights])
    if prior is not None:
        score += np.log(prior).T
    score -= score.max(0)
    p = np.exp(score, out=score)
    p /= p.sum(0)
    return p


def complement_weights(counts: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Words x areas: minus the log rate of the word in all other areas, centred, times the word's worth.

    The worth is the squared share of the greatest divergence that the word's
    areas have from all words' areas (``SHARPNESS`` sets its scale): words of no area in particular, also those
    of a language that few labelled documents are in, count next to nothing.
    """
    k = counts.shape[1]
    other = counts.sum(1, keepdims=True) - counts + alpha
    w = -np.log(other / other.sum(0, keepdims=True))
    base = (counts.sum(0) + 1) / (counts.sum() + k)
    share = (counts + 2.0 * base) / (counts.sum(1, keepdims=True) + 2.0)
    worth = np.clip((share * np.log(share / base)).sum(1, keepdims=True) / np.log(k) if k > 1 else np.ones((len(counts), 1)), 0, 1) ** 2
    return (SHARPNESS * (w - w.mean(1, keepdims=True)) * worth).astype(np.float32)


def _bits(masks: np.ndarray, k: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(k)) & 1).astype(float)


def _priors(labels: np.ndarray, hints: np.ndarray, types: np.ndarray, k: int, trust: float) -> np.ndarray:
    """Rows x areas from bit masks of labels and of the category, and the factors of the type: labels rule, the category adds its worth."""
    lab = _bits(labels, k)
    p = (np.full(lab.shape, 1.0 / k) + trust * _bits(hints, k)) * types
    has = labels > 0
    p[has] = lab[has] + 0.02
    return p / p.sum(1, keepdims=True)


def _step(shared, k: int, folds: bool = False):
    """Sums of the posteriors by word; with ``folds`` also those of the labelled documents of either half (fold 0 and 1; -1 holds all)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, trust, right, types, bits = pickle.loads(shared.value)
        live = np.unpackbits(bits, count=CODES).astype(bool)
        weights = _by_area(weights)
        sums = {f: np.zeros((k, BUCKETS)) for f in ((-1, 0, 1) if folds else (-1,))}
        for batch in batches:
            codes, sentence, rows = _sentences(batch, live)
            if not len(codes):
                continue
            labels, hints, fold, kind = (batch.column(c).to_numpy() for c in ("labels", "hints", "fold", "kind"))
            prior = _priors(labels, hints, types[kind], k, trust)[rows]
            if weights is None:
                # first round: labelled documents, and those with a category by its worth
                weight = np.where(labels > 0, 1.0, np.where(hints > 0, right, 0.0))[rows]
                p = np.ascontiguousarray((prior * weight[:, None]).T)
            else:
                p = _posterior(weights, codes, sentence, prior)
            for f, into in sums.items():
                word = slice(None) if f < 0 else ((labels > 0) & (fold == f))[rows][sentence]
                c, of = codes[word], sentence[word]
                if len(c):
                    for z in range(k):
                        into[z] += np.bincount(c, p[z].take(of), BUCKETS)
        for f, got in sums.items():
            seen = np.flatnonzero(got.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), f, np.int32)), pa.array(seen.astype(np.int32))] + [pa.array(got[z, seen]) for z in range(k)], names=["fold", "word", *[f"z{z}" for z in range(k)]])

    return step


def _shares(shared, k: int):
    """Sums over the sentences of a row by the model of all documents, and of labelled ones by the model without their half."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, _, _, _, bits = pickle.loads(shared.value)
        models = {f: _by_area(w) for f, w in models.items()}
        live = np.unpackbits(bits, count=CODES).astype(bool)
        for batch in batches:
            codes, sentence, rows = _sentences(batch, live)
            if not len(codes):
                continue
            labels, fold = (batch.column(c).to_numpy() for c in ("labels", "fold"))
            n = np.bincount(rows, minlength=batch.num_rows)
            for f, weights in models.items():
                mine = np.ones(len(rows), bool) if f < 0 else ((labels > 0) & (fold == f))[rows]
                if not mine.any():
                    continue
                word, number = mine[sentence], np.cumsum(mine) - 1
                # the document's own labels are left out here: its share must come from its sentences
                p = _posterior(weights, codes[word], number[sentence[word]], None)
                sums = np.stack([np.bincount(rows[mine], p[z], batch.num_rows) for z in range(k)], axis=1)
                have = np.unique(rows[mine])
                yield pa.RecordBatch.from_arrays([batch.column("document_id").take(pa.array(have)), pa.array(np.full(len(have), f >= 0)), pa.array(n[have])] + [pa.array(sums[have, z]) for z in range(k)], names=["document_id", "held", "n", *[f"z{z}" for z in range(k)]])

    return shares


def category_hint(category: Column, areas: list) -> Column:
    """Bit mask of the areas that a category names: by code or name, in any case, as head of a path, cut short by a letter or two."""
    head = F.lower(F.trim(F.split_part(category, F.lit(">"), F.lit(1))))
    mask = F.lit(0)
    for i, a in enumerate(areas):
        names = [x.lower() for x in (a.area_code, a.name_en, a.name_ko) if x]
        hit = head.isin(names)
        for x in names:
            if len(x) > 4:
                hit = hit | ((F.length(head) >= max(4, len(x) - 2)) & F.lit(x).startswith(head))
        mask = mask + F.when(hit, 1 << i).otherwise(0)
    return F.coalesce(mask, F.lit(0)).cast("bigint")


def fit_curve(x: np.ndarray, y: np.ndarray, area: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Slope and one offset an area of a logistic curve over log shares; offsets are drawn towards their mean."""
    f = np.log(x + 0.01)
    slope, offset = 4.0, np.full(k, 7.0)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(slope * f + offset[area], -30, 30)))
        g, h = p - y, p * (1 - p) + 1e-6
        slope -= 0.5 * ((g * f).sum() + 0.1 * (slope - 4.0)) / ((h * f * f).sum() + 0.1)
        pull = 5.0
        mean = offset.mean()
        for z in range(k):
            at = area == z
            offset[z] -= 0.5 * (g[at].sum() + pull * (offset[z] - mean)) / (h[at].sum() + pull)
    return slope, offset


def subject_posteriors(documents: DataFrame, blocks: DataFrame, labels: DataFrame, areas: DataFrame, iterations: int = ITERATIONS) -> tuple[DataFrame, list[str]]:
    """(document_id, posteriors array<double>, shares array<double>) of every document, and the areas in their order.

    Repeated documents and blocks count once, of a document delivered several
    times the last delivery's category and type. Labels of unknown areas are ignored. A
    document without a word gets its category's areas, else the most frequent one.
    Without areas nothing is assigned; more than ``MAX_AREAS`` areas are an error.
    """
    spark = documents.sparkSession
    area_rows = areas.filter("area_code is not null").dropDuplicates(["area_code"]).orderBy("area_code").limit(MAX_AREAS + 1).collect()
    codes, k = [a.area_code for a in area_rows], len(area_rows)
    if k > MAX_AREAS:
        raise ValueError(f"more than {MAX_AREAS} areas")
    kind = F.col("doc_type") if "doc_type" in documents.columns else F.lit(None).cast("string")
    at = F.coalesce("created_at", F.lit("1900-01-01").cast("timestamp"))
    docs = documents.filter("document_id is not null").groupBy("document_id").agg(F.max_by("domain_category", at).alias("category"), F.lower(F.trim(F.max_by(kind, at))).alias("type"))
    if not k:
        nothing = F.array().cast("array<double>")
        return docs.select("document_id", nothing.alias("posteriors"), nothing.alias("shares")), []
    index = F.create_map(*[F.lit(x) for i, c in enumerate(codes) for x in (c, 1 << i)])
    lab = labels.filter(F.col("area_code").isin(codes)).groupBy("document_id").agg(F.bit_or(index[F.col("area_code")]).cast("bigint").alias("labels"))
    fold = F.pmod(F.xxhash64("document_id", F.lit(5)), F.lit(2)).cast("int")
    docs = materialize(docs.withColumn("hints", category_hint(F.col("category"), area_rows)).join(lab, "document_id", "left").select("document_id", "type", "hints", F.coalesce("labels", F.lit(0)).alias("labels"), fold.alias("fold")))
    # what the labelled documents of a type deal with, against all labelled ones; other types tell nothing
    each = [F.count_if(F.col("labels").bitwiseAND(F.lit(1 << z)) > 0).alias(f"z{z}") for z in range(k)]
    seen = docs.filter("labels > 0 and type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n"), *each).orderBy(F.desc("n"), "type").limit(TYPES).collect()
    base = (sum((np.array(r[2:], float) for r in seen), np.zeros(k)) + 1.0) / (sum(r.n for r in seen) + 1.0)
    types = np.ones((len(seen) + 1, k))
    for i, r in enumerate(seen):
        types[i + 1] = (np.array(r[2:]) + 20 * base) / (r.n + 20) / base
    number = spark.createDataFrame([(r.type, i + 1) for i, r in enumerate(seen)], "type string, kind int")
    docs = docs.join(F.broadcast(number), "type", "left").na.fill(0, ["kind"])  # TYPES rows at most
    text = blocks.filter("block_type = 'text' and document_id is not null and id is not null and content is not null").select("document_id", "id", "content")
    coded = spread(text, "id").mapInArrow(_encode, "document_id string, id bigint, codes binary, sizes binary")
    coded = coded.groupBy("document_id", "id").agg(F.min(F.struct("codes", "sizes")).alias("c"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    coded = materialize(coded.join(docs, "document_id", "left").select("document_id", "c.codes", "c.sizes", zero("labels").cast("bigint").alias("labels"), zero("hints").cast("bigint").alias("hints"), zero("fold"), zero("kind")))
    most = 2 * spark.sparkContext.defaultParallelism
    coded = coded.coalesce(most)  # a task sends a row a bucket, however much it read
    often = coded.select("codes").mapInArrow(_count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    live = np.zeros(CODES, bool)
    live[often.select("code").toArrow().column("code").to_numpy()] = True  # CODES rows at most
    bits = np.packbits(live)
    # worth of a category: how often it names a label of the labelled documents, against how often it would by chance
    hit = docs.filter("labels > 0 and hints > 0").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("labels").bitwiseAND(F.col("hints")) > 0, 1)).alias("hit")).first()
    right = ((hit.hit or 0) + 1) / (hit.n + 2)
    trust = max(0.0, (right - 1 / max(1, k)) / max(1e-3, 1 - right))
    weights = None
    columns = ", ".join(f"z{z} double" for z in range(k))

    def run(f, schema: str, model, **how) -> DataFrame:
        shared = spark.sparkContext.broadcast(pickle.dumps((model, trust, right, types, bits)))
        return coded.mapInArrow(f(shared, k, **how), schema)

    def counted(**how) -> dict[int, np.ndarray]:
        """Buckets x areas of each fold; at most ``BUCKETS`` rows a fold reach the driver."""
        sums = run(_step, f"fold int, word int, {columns}", weights, **how).groupBy("fold", "word").agg(*[F.sum(f"z{z}").alias(f"z{z}") for z in range(k)]).toArrow()
        out = {f: np.zeros((BUCKETS, k)) for f in (-1, 0, 1)}
        of, word = sums.column("fold").to_numpy(), sums.column("word").to_numpy()
        for f in out:
            for z in range(k):
                out[f][word[of == f], z] = sums.column(f"z{z}").to_numpy()[of == f]
        return out

    for _ in range(iterations - 1):
        weights = complement_weights(counted()[-1])
    counts = counted(folds=True)
    models = {f: complement_weights(counts[-1] - counts[f] if f >= 0 else counts[-1]) for f in counts}
    counts = counts[-1]
    total = run(_shares, f"document_id string, held boolean, n bigint, {columns}", models).groupBy("document_id", "held").agg(F.sum("n").alias("n"), *[F.sum(f"z{z}").alias(f"z{z}") for z in range(k)])
    both = materialize(total.select("document_id", "held", F.array(*[F.col(f"z{z}") / F.col("n") for z in range(k)]).alias("shares")))
    shares = both.filter("not held").drop("held")
    sample = both.filter("held").join(docs.filter("labels > 0"), "document_id").orderBy(F.xxhash64("document_id")).limit(CALIBRATION).select("shares", "labels").collect()
    x = np.array([r.shares for r in sample]).reshape(-1, k)
    y = (np.array([r.labels for r in sample], np.int64)[:, None] >> np.arange(k)) & 1
    slope, offset = fit_curve(x.ravel(), y.ravel().astype(float), np.tile(np.arange(k), len(x)), k) if len(x) else (4.0, np.full(k, -4.0 * np.log(SHARE + 0.01)))
    frequent = int(counts.sum(0).argmax())
    offsets = F.array(*[F.lit(float(o)) for o in offset])
    posterior = F.zip_with("shares", offsets, lambda s, o: 1 / (1 + F.exp(-(F.lit(float(slope)) * F.log(s + 0.01) + o))))
    hints = F.array(*[F.when(F.col("hints").bitwiseAND(F.lit(1 << z)) > 0, F.lit(right)).when((F.col("hints") == 0) & F.lit(z == frequent), F.lit(0.1)).otherwise(F.lit(0.0)) for z in range(k)])
    out = docs.join(shares.withColumn("posteriors", posterior), "document_id", "left")
    return out.select("document_id", F.coalesce("posteriors", hints).alias("posteriors"), "shares"), codes


def subject_areas(documents: DataFrame, blocks: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(document_id, area_code, posterior): the areas above one half, at least the likeliest of each document."""
    scored, codes = subject_posteriors(documents, blocks, labels, areas)
    if not codes:
        return scored.limit(0).select("document_id", F.lit("").alias("area_code"), F.lit(0.0).alias("posterior"))
    each = scored.select("document_id", F.array_max("posteriors").alias("best"), F.posexplode("posteriors").alias("z", "posterior"))
    kept = each.filter((F.col("posterior") >= 0.5) | (F.col("posterior") == F.col("best")))
    names = F.array(*[F.lit(c) for c in codes])
    out = kept.select("document_id", F.get(names, F.col("z")).alias("area_code"), "posterior", (F.col("posterior") >= 0.5).alias("sure"))
    # of several areas tied below one half the first counts
    return out.groupBy("document_id", "sure").agg(F.min(F.struct("area_code", "posterior")).alias("least"), F.collect_list(F.struct("area_code", "posterior")).alias("all")).select(
        "document_id", F.explode(F.when(F.col("sure"), F.col("all")).otherwise(F.array("least"))).alias("a")
    ).select("document_id", "a.area_code", "a.posterior")


def _tables(spark, sf_dir: str):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return read("parser_documents"), read("parser_blocks"), read("subject_labels"), read("subject_areas")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return subject_areas(*_tables(spark, sf_dir)).select("document_id", "area_code").distinct()


def p3_shares(spark, sf_dir: str) -> DataFrame:
    """Per area the documents that deal with it, their share of the catalogue, and the mean share of sentences."""
    documents, blocks, labels, areas = _tables(spark, sf_dir)
    scored, codes = subject_posteriors(documents, blocks, labels, areas)
    if not codes:
        return areas.limit(0).select("area_code", F.lit(0).cast("bigint").alias("documents"), F.lit(0.0).alias("mean_sentence_share"), F.lit(0.0).alias("catalogue_share"))
    scored = materialize(scored)
    each = scored.select("document_id", F.array_max("posteriors").alias("best"), F.posexplode(F.arrays_zip("posteriors", F.coalesce("shares", F.array(*[F.lit(0.0) for _ in codes])).alias("shares"))).alias("z", "s"))
    n = scored.count()
    names = F.array(*[F.lit(c) for c in codes])
    by = each.groupBy(F.get(names, F.col("z")).alias("area_code")).agg(F.count(F.when((F.col("s.posteriors") >= 0.5) | (F.col("s.posteriors") == F.col("best")), 1)).alias("documents"), F.round(F.avg("s.shares"), 6).alias("mean_sentence_share"))
    return by.withColumn("catalogue_share", F.round(F.col("documents") / F.lit(float(max(1, n))), 6))
