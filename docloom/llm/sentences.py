"""Sentence units of texts in many languages and scripts.

Method: unsupervised statistics per language by log-likelihood ratios. The language
of a block comes from its script, of Latin script from the words that texts of each
language label hold more often than others do. One pass counts every token of all texts: how often it occurs, with a final period, first
in a paragraph, last in a paragraph, and which tokens follow it after a period.
From these come, per language,

* abbreviations: types that take a period far more often than chance (ratio
  test) and whose period is far less often followed by what starts sentences
  than other periods are (ratio test);
* collocations: pairs (abbreviation or number, next token) that occur together
  more often than chance;
* numbers: the languages in which a period behind a number is followed by what
  starts sentences as often as other periods are; elsewhere it marks an ordinal;
* closers: last characters of words whose words take a sentence sign or end a
  paragraph more often than not, in scripts without capitals;
* sentence starters and enders: the log-ratio of a token's rate at paragraph
  starts (ends) to its rate anywhere; tokens too rare for a rate of their own
  share that of their shape.

A second pass over the texts then classifies each period, and each line break
after which no sign says whether the sentence goes on. Scripts without spaces or
periods are cut at their own signs, there the characters that start sentences
decide behind quotations; Thai is cut at those of its spaces that look like the
ends and starts of its lines.

Scale: the passes are maps over rows; only token counts are shuffled. The model
keeps tokens of a share of at least ``MIN_SHARE`` of a language, at most 1e5 a
language, so that its size is bounded for any corpus; it is broadcast. What stands
around a sign is looked at within ``REACH`` characters, so that cutting takes time
in proportion to the text, also where a text has no white space.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread

MIN_COUNT, MIN_SHARE, REACH = 8, 1e-5, 256
ODDS = 2.0

BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
MARK = re.compile(r"[^\S\n]*(?:#{1,6}|[-*•‣–]|\d{1,3}(?:\.\d{1,3})*[.)]|\d{1,2}(?:\.\d{1,2})+)[^\S\n]+")
OPENER = re.compile(r"[“„«「『‘\"(（\[]")
SPAN = re.compile(
    r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「(?:[^「」]|「[^「」]*」)*」|『[^『』]*』|(?<!\w)‘[^‘’]*’(?![A-Za-zÀ-ɏ])|(?<![^\s(（])\"[^\"]*\"|\((?:[^()]|\([^()]*\))*\)|（[^（）]*）|\[[^\[\]]*\]"
)
SIGN = re.compile(r"[.!?]+|[。！？｡]+|…+|[।॥]+|\n")
# A run of signs of any kind: searched for faster than SIGN, which then takes runs of several characters apart.
SIGNS = re.compile(r"[.!?。！？｡…।॥\n]+")
NEXT = re.compile(r"\s*(\S+)")
CLOSING = frozenset("”»」』’)）]\"")
# What follows a sentence sign or begins a block, in scripts without spaces.
STARTS = re.compile(r"(?:^|[。！？])[\s「『（“‘]*([^\s「『（“‘])")
THAI_SPACE = re.compile(r"(?<=\S)[^\S\n]+(?=\S)")
INNER_END = re.compile(r"[.!?。！？｡।…][\s”“»」』’\")）\]]*$")
STRIP = "“”„\"«»「」『』‘’'()（）[]{}.,;:!?…。，、；：！？।॥"
NUMBER = re.compile(r"^[.,:/-]*\d[\d.,:/-]*$")
INITIALS = re.compile(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]{1,2}")

# A few frequent words that tell Latin-script languages apart, for texts without a language label.
LATIN_WORDS = {
    "en": {"the", "of", "and", "in", "were", "was", "by", "to", "for", "is", "at", "that", "with", "as", "on", "after", "who", "before"},
    "de": {"der", "die", "und", "in", "wurde", "wurden", "im", "von", "zu", "den", "ist", "hat", "nach", "gilt", "lag", "bei", "durch", "für", "gemäß", "laut", "seit", "wer", "am", "mit"},
    "fr": {"le", "la", "de", "et", "du", "des", "les", "à", "en", "un", "une", "sur", "est", "par", "pour", "dans", "selon", "qui", "après", "avec"},
}
LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ]+")
# Letters that are not of one byte, or become so in lower case; and the one-byte letters in lower case, all else as blanks.
LATIN_REST = re.compile("[\u0100-\u024f\u1e9e\u212a\u212b\u2c7e\u2c7f]")
LATIN_BYTES = bytes(ord(chr(b).lower()) if LATIN_WORD.match(chr(b)) else 32 for b in range(256))
LABEL = re.compile(r"^[a-z]{2,3}$")
# The ranges of letters that tell the other scripts; Han last, as Japanese has it too.
SCRIPTS = [
    ("ko", re.compile(r"[ᄀ-ᇿ가-힣]+")),
    ("ja", re.compile(r"[ぁ-ヿ]+")),
    ("th", re.compile(r"[฀-๿]+")),
    ("hi", re.compile(r"[ऀ-ॿ]+")),
    ("zh", re.compile(r"[㐀-鿿]+")),
]
OTHER_SCRIPT = re.compile(r"[\u0370-\u1fff\u2c00-\ud7ff\uf900-\ufdff]")


def latin_bytes(text: str) -> bytes | None:
    """The text's Latin words in lower case, with blanks between them; none if letters take more than a byte."""
    return None if not text.isascii() and LATIN_REST.search(text) else text.encode("latin-1", "replace").translate(LATIN_BYTES)


def latin_words(text: str) -> list[str]:
    """What ``LATIN_WORD`` finds in the text in lower case; by bytes, which is faster, where they do."""
    plain = latin_bytes(text)
    return LATIN_WORD.findall(text.lower()) if plain is None else plain.decode("latin-1").split()


class Languages:
    """Tells the language of a block by its script, of Latin script by its words (word -> log odds of each language)."""

    def __init__(self, names: list[str], words: dict[str, tuple[float, ...]]) -> None:
        self.names, self.words = names, words
        self.plain = {w.encode("latin-1"): odds for w, odds in words.items() if not LATIN_REST.search(w)}

    @staticmethod
    def seeds() -> Languages:
        names = sorted(LATIN_WORDS)
        return Languages(names, {w: tuple(ODDS * (w in LATIN_WORDS[n]) for n in names) for w in set().union(*LATIN_WORDS.values())})

    def of(self, block: str, base: Callable[[], str] | None = None) -> str:
        if not block.isascii() and OTHER_SCRIPT.search(block):
            least = 0.12 * len(block)
            for lang, pattern in SCRIPTS:
                if pattern.search(block) and sum(map(len, pattern.findall(block))) > least:
                    return lang
        plain = latin_bytes(block)
        known = [*filter(None, map(self.words.get, LATIN_WORD.findall(block.lower())) if plain is None else map(self.plain.get, plain.split()))]
        if known and len(self.names) > 1:
            sums = [sum(x) for x in zip(*known)]
            best, second = sorted(sums, reverse=True)[:2]
            if best - second >= 1:
                return self.names[sums.index(best)]
        return base() if base else self.names[0] if self.names else "en"

    def latin(self, text: str) -> str:
        """The Latin-script language of a whole text, for blocks too short to tell."""
        lang = self.of(text)
        return lang if lang in self.names else self.names[0] if self.names else "en"


def _label_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Latin words of the texts of each label; the empty word counts all letters, ``~`` the Latin ones."""
    counts: dict = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words = latin_words(text)
            counts[lang].update(words)
            counts[lang][""] += len(text)
            counts[lang]["~"] += sum(map(len, words))
        if sum(map(len, counts.values())) > 500_000:
            yield flush()
    yield flush()


def learn_languages(texts: DataFrame) -> Languages:
    """The Latin-script languages among the labels (lang, text), most frequent first, and the words that tell them apart.

    Labels are unreliable: they count in lower case up to a hyphen, as codes of two
    or three letters, if most letters of their texts are Latin and they hold a
    thousandth of all Latin letters. Without such labels a few seed words serve.
    """
    label = F.lower(F.regexp_extract("lang", "^([A-Za-z]+)", 1))
    rows = texts.select(label.alias("lang"), "text").filter(f"lang rlike '{LABEL.pattern}' and lang <> 'und' and text is not null")
    counts = materialize(rows.mapInArrow(_label_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    sizes = counts.filter("word in ('', '~')").groupBy("lang").agg(F.sum(F.when(F.col("word") == "", F.col("n"))).alias("chars"), F.sum(F.when(F.col("word") == "~", F.col("n"))).alias("latin"))
    rows = sizes.filter("latin * 2 > chars").orderBy(F.desc("latin"), "lang").limit(1000).collect()  # two or three letters: 18 252 labels at most
    names = [r.lang for r in rows if r.latin * 1000 >= sum(x.latin for x in rows)]
    if len(names) < 2:
        return Languages.seeds()
    mine = counts.filter(F.col("lang").isin(names) & (F.col("word") != "") & (F.col("word") != "~"))
    total = {r.lang: r.n for r in mine.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    wide = mine.groupBy("word").agg(F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("lang") == n, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, n in enumerate(names)])
    rate = [F.log((F.col(f"n{i}") + 0.5) / (total[n] + 1.0)) for i, n in enumerate(names)]
    mean = sum(rate[1:], rate[0]) / len(names)
    odds = wide.filter((F.col("all") >= MIN_COUNT) & (F.col("all") >= MIN_SHARE * sum(total.values()))).select("word", F.array(*[r - mean for r in rate]).alias("odds"))
    telling = odds.filter(F.array_max("odds") - F.array_min("odds") >= ODDS)
    return Languages(names, {r.word: tuple(r.odds) for r in telling.collect()})  # at most 1 / MIN_SHARE words


def core(token: str) -> str:
    """The token without outer punctuation, numbers as one type; inner periods stay."""
    word = token.strip(STRIP)
    return "##" if not word[-1:].isalpha() and NUMBER.match(word) else word


class _Cores(dict):
    """The cores of tokens that come again."""

    def __missing__(self, token: str) -> str:
        self[token] = c = core(token)
        return c


def shape(word: str) -> str:
    if not word:
        return "~none"
    c = word[0]
    if c.isdigit():
        return "~digit"
    if c.isupper():
        return "~upper"
    if c.islower():
        return "~lower" if word.islower() or not any(x.isupper() for x in word) else "~mixed"
    return "~" + word[-1]


def blocks_of(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines."""
    out, at = [], 0
    for m in BLANK.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def _count(languages: Languages, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token and pair counts of the partition."""
    tokens, characters, first, last, pairs = (defaultdict(Counter) for _ in range(5))

    def flush() -> pa.RecordBatch:
        outer = _Cores()
        columns: list[list] = [[] for _ in range(8)]

        def put(lang: str, heads: list[str], nexts: list[str], counts: list) -> None:
            for column, values in zip(columns, ([lang] * len(heads), heads, nexts, [shape(b or a) for a, b in zip(heads, nexts)], *counts)):
                column += values

        for lang, counter in characters.items():
            for c, n in counter.items():
                if not c.isspace():
                    tokens[lang]["s:" + c] += n
        for lang, counter in tokens.items():
            number, dots, begin, end = ({} for _ in range(4))
            for t, n in counter.items():
                c = core(t)
                number[c] = number.get(c, 0) + n
                if c == t:
                    continue  # without outer punctuation, so without a sign
                bare = t.rstrip("”“»」』’\"')）]")
                if bare.endswith("."):
                    if not bare.endswith(".."):
                        dots[c] = dots.get(c, 0) + n
                elif bare.endswith(("!", "?", "।", "॥")):
                    end[c] = end.get(c, 0) + n
            for found, counts in ((begin, first), (end, last)):
                for t, n in counts[lang].items():
                    c = outer[t]
                    number.setdefault(c, 0)
                    found[c] = found.get(c, 0) + n
            put(lang, [*number], [""] * len(number), [number.values(), *(map(x.get, number, repeat(0)) for x in (dots, begin, end))])
        for lang, counter in pairs.items():
            both: dict[tuple[str, str], int] = {}
            for (a, b), n in counter.items():
                key = outer[a], outer[b]
                both[key] = both.get(key, 0) + n
            none = [0] * len(both)
            put(lang, [a for a, _ in both], [b for _, b in both], [[*both.values()], none, none, none])
        for d in (tokens, characters, first, last, pairs):
            d.clear()
        kinds = [pa.string()] * 4 + [pa.int64()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "token", "next", "shape", "n", "dot", "first", "last"])

    size = 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            base = cache(partial(languages.latin, text))
            for s, e in blocks_of(text):
                block = text[s:e]
                lang = languages.of(block, base)
                if lang in ("zh", "ja"):
                    characters[lang].update(block)
                    first[lang].update(["s:" + c for c in STARTS.findall(block)])
                    size += len(block)
                    continue
                if lang == "th":
                    for line in block.split("\n"):
                        chunks = line.split()
                        if chunks:
                            tokens[lang].update(["e:" + c[-4:] for c in chunks])
                            tokens[lang].update(["s:" + c[:4] for c in chunks])
                            first[lang]["s:" + chunks[0][:4]] += 1
                            last[lang]["e:" + chunks[-1][-4:]] += 1
                    continue
                m = MARK.match(block)
                words = block[m.end() if m else 0 :].split()
                if not words:
                    continue
                size += len(words)
                tokens[lang].update(words)
                if not m:
                    first[lang][words[0]] += 1
                last[lang][words[-1]] += 1
                if "." in block:
                    pairs[lang].update([(a, b) for a, b in zip(words, words[1:]) if a[-1] == "." and a[-2:] != ".."])
        if size > 2_000_000:
            yield flush()
            size = 0
    yield flush()


def _llr(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio of two binomial rates."""
    part = lambda k, n, p: k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    return 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))


def learn(texts: DataFrame) -> dict:
    """The model of all languages: ``start`` and ``end`` log-ratios, ``abbreviations``, ``collocations``, ``numbers`` and ``closers``.

    ``texts`` has (text), and (lang) where texts have labels. Every text is counted.
    """
    languages = learn_languages(texts) if "lang" in texts.columns else Languages.seeds()
    shared = texts.sparkSession.sparkContext.broadcast(pickle.dumps((languages.names, languages.words)))
    counted = spread(texts.select("text").filter("text is not null"), "text").mapInArrow(lambda batches: _count(Languages(*pickle.loads(shared.value)), batches), "lang string, token string, next string, shape string, n bigint, dot bigint, first bigint, last bigint")
    counts = materialize(counted.groupBy("lang", "token", "next", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "dot", "first", "last")]))
    often = materialize(counts.filter(f"n >= {min(MIN_COUNT, 5)} or dot >= 3"))  # a small part of all counts, read instead of them below
    types = counts.filter("next = ''").drop("next")
    frequent = often.filter("next = ''").drop("next")
    pairs = counts.filter("next <> '' and lang not in ('th', 'zh', 'ja')").select("lang", "token", "next", "shape", "n")
    total = types.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("dot").alias("all_dot"), F.sum("first").alias("all_first"), F.sum("last").alias("all_last"))
    total = materialize(total)  # a row a language
    own = (F.col("n") >= MIN_COUNT) & (F.col("n") >= F.col("all_n") * MIN_SHARE)
    joined = types.join(F.broadcast(total), "lang")
    # Thai keeps starts and ends apart by its prefix; a frequent token has its own rate, the others that of their shape
    rates = joined.withColumn("key", F.when(own, F.col("token")).otherwise(F.col("shape"))).groupBy("lang", "key", "all_n", "all_first", "all_last").agg(*[F.sum(c).alias(c) for c in ("n", "dot", "first", "last")])
    anywhere = F.log((F.col("n") + 1.0) / (F.col("all_n") + 2.0))
    rates = materialize(rates.withColumn("start", F.log((F.col("first") + 0.5) / (F.col("all_first") + 1.0)) - anywhere).withColumn("end", F.log((F.col("last") + 0.5) / (F.col("all_last") + 1.0)) - anywhere))
    model: dict = {"start": defaultdict(dict), "end": defaultdict(dict), "abbreviations": defaultdict(set), "collocations": defaultdict(set), "closers": defaultdict(set), "numbers": set(), "languages": (languages.names, languages.words)}
    for r in rates.select("lang", "key", "start", "end").collect():  # at most 1 / MIN_SHARE rows a language
        model["start"][r.lang][r.key] = r.start
        model["end"][r.lang][r.key] = r.end
    d = lambda c: F.col(c).cast("double")
    # what follows a type's periods, as far as it looks like a start
    scores = rates.select("lang", "key", "start")
    # at most 1 / MIN_SHARE tokens a language
    known = frequent.join(F.broadcast(total), "lang").filter(own).select("lang", F.col("token").alias("next"), F.lit(True).alias("own"))
    follow = pairs.join(F.broadcast(known), ["lang", "next"], "left").withColumn("key", F.when(F.col("own"), F.col("next")).otherwise(F.col("shape"))).join(F.broadcast(scores), ["lang", "key"], "left")
    after = materialize(follow.groupBy("lang", "token").agg(F.sum("n").alias("followed"), F.coalesce(F.sum(F.when(F.col("start") > 0, F.col("n"))), F.lit(0)).alias("starts")))
    base = after.groupBy("lang").agg(F.sum("followed").alias("all_followed"), F.sum("starts").alias("all_starts"))
    numbers = after.filter("token = '##'").join(F.broadcast(base), "lang").join(F.broadcast(total), "lang")
    fewer = _llr(d("starts"), d("followed"), d("all_starts") - d("starts") + 0.5, d("all_followed") - d("followed") + 1.0)
    for r in numbers.filter((F.col("followed") >= MIN_COUNT) & ((fewer <= 7.88) | (F.col("starts") * d("all_followed") >= F.col("followed") * d("all_starts")))).select("lang").collect():
        model["numbers"].add(r.lang)
    # one row a character: scripts without capitals have some thousands
    last = types.filter("token <> '' and lang not in ('th', 'zh', 'ja') and shape not in ('~upper', '~lower', '~mixed', '~digit')").withColumn("c", F.substring("token", -1, 1)).groupBy("lang", "c").agg(F.sum("n").alias("n"), F.greatest(F.sum("dot"), F.sum("last")).alias("dot"))
    last = last.join(F.broadcast(total), "lang").filter((F.col("dot") >= MIN_COUNT) & (F.col("dot") * 2 > F.col("n")))
    for r in last.filter(_llr(d("dot"), F.greatest(d("n"), d("dot")), d("all_dot") - d("dot"), d("all_n") - d("n")) > 7.88).select("lang", "c").collect():
        model["closers"][r.lang].add(r.c)
    cand = frequent.filter("dot >= 3 and dot * 2 > n").join(after, ["lang", "token"], "left").join(F.broadcast(total), "lang").join(F.broadcast(base), "lang").na.fill(0)
    cand = cand.withColumn("ended", F.greatest(F.col("dot") - F.col("followed"), F.lit(0)) + F.col("starts"))
    takes = _llr(d("dot"), F.greatest(d("n"), d("dot")), d("all_dot") - d("dot"), d("all_n") - d("n"))
    # the longer a word, the more evidence it takes
    longer = F.exp(-F.greatest(F.length("token") - 8, F.lit(0)) / 2.0)
    ends = _llr(d("ended"), d("dot"), d("all_starts") + 0.5, d("all_followed") + 1.0)
    abbr = cand.filter((F.col("dot") * 2 > F.col("n")) & (takes * longer > 7.88) & (F.col("ended") < 0.4 * F.col("dot")) & ((ends * longer > 7.88) | ((F.col("dot") < MIN_COUNT) & (longer == 1))) & (F.col("dot") >= 3))
    for r in abbr.filter(F.col("dot") >= F.col("all_dot") * MIN_SHARE).select("lang", "token").collect():
        model["abbreviations"][r.lang].add(r.token)
    # collocations after numbers and abbreviations, as a day and its month
    five = frequent.filter("n >= 5")
    one = five.select("lang", F.col("token").alias("next"), F.col("n").alias("n2"))
    pair = often.filter("next <> '' and n >= 5 and lang not in ('th', 'zh', 'ja')").select("lang", "token", "next", "n").join(one, ["lang", "next"]).join(five.select("lang", "token", "dot"), ["lang", "token"]).join(F.broadcast(total), "lang")
    together = _llr(d("n"), F.greatest(d("dot"), d("n")), F.greatest(d("n2") - d("n"), F.lit(0.0)), d("all_n") - d("dot"))
    for r in pair.filter((together > 7.88) & (F.col("n") * d("all_n") > d("dot") * d("n2")) & (F.col("n") >= F.col("all_dot") * MIN_SHARE)).select("lang", "token", "next").collect():
        model["collocations"][r.lang].add((r.token, r.next))
    return {k: dict(v) if isinstance(v, defaultdict) else v for k, v in model.items()}


class Classifier:
    """Cuts texts by a learnt model."""

    LINE_PRIOR = -2.0

    def __init__(self, model: dict) -> None:
        self.model, self.languages = model, Languages(*model["languages"])
        self.cased = {*self.languages.names, "en"}

    def start(self, lang: str, token: str) -> float:
        table = self.model["start"].get(lang, {})
        c = core(token)
        return table.get(c, table.get(shape(c), 0.0))

    def end(self, lang: str, token: str) -> float:
        table = self.model["end"].get(lang, {})
        c = core(token)
        return table.get(c, table.get(shape(c), 0.0))

    def _period(self, block: str, lang: str, s: int, e: int) -> bool:
        """Does the sign block[s:e], of periods alone, end a sentence?"""
        follows = NEXT.match(block, e, e + REACH)
        if not follows:
            return False
        nxt = follows[1]
        spaced = follows.start(1) > e
        if e - s > 1:
            return bool(spaced and lang in self.model["start"] and lang != "ko" and nxt[:1].isupper() and self.start(lang, nxt) > 0)
        word = word_before(block, max(0, s - REACH), s)
        c = core(word)
        if lang in ("hi", "th", "zh", "ja"):
            return False  # a period is no sentence sign of these scripts
        if not spaced:
            if not c or len(c) < 2 or "." in c or not word[-1:].isalpha() and word[-1:] not in "”’»)\"）":
                return False
            n = block[e]
            if lang == "ko" or "가" <= n <= "힣":
                return "가" <= word[-1] <= "힣" and (n.isalpha() or n in "“‘\"「(")
            return (word[-1].islower() or not word[-1].isalpha()) and (n in "“„«\"「" or n.isupper() and block[e + 1 : e + 2].islower() or unicode_letter(n)) and c not in self.model["abbreviations"].get(lang, ())
        clean = nxt.lstrip(STRIP)
        lower = clean[:1].islower() and not any(x.isupper() for x in clean)
        if not c:
            return not lower
        abbreviations = self.model["abbreviations"].get(lang, ())
        if word[-1:] in ")）]”»":
            return not lower
        if c == "##":
            if lower or (core(word), core(nxt)) in self.model["collocations"].get(lang, ()) and self.start(lang, nxt) <= 0:
                return False
            if clean[:1].isdigit():
                return lang in self.model["numbers"] and not nxt.endswith((".", ")")) and len(word.strip(STRIP)) > 2
            return lang in self.model["numbers"] or self.start(lang, nxt) > 0
        if len(c) == 1 and c.isupper() and len(clean.rstrip(STRIP)) == 1:
            return False  # initials in a row
        if c in abbreviations or (len(c) == 1 and c.isupper()) or ("." in c and INITIALS.fullmatch(c) is not None):
            return not lower and not clean[:1].isdigit() and self.start(lang, nxt) > 0
        if lower:
            return self.start(lang, nxt) > 0
        return True

    def _line(self, block: str, lang: str, start: int, at: int, marked: bool) -> bool:
        """Does the line break at ``at`` end the unit that began at ``start``?"""
        after = block[at + 1 : at + REACH]
        if marked or lang in ("zh", "ja", "th") or after[:1].isspace() or MARK.match(after):
            return True
        before = block[max(start, at - REACH) : at].rsplit(None, 1)
        nxt = after.split(None, 1)[0] if after.strip() else ""
        if not before or not nxt:
            return True
        word = before[-1]
        if word[-1] in ",;:–-(" or nxt[0] in ";,:)–":
            return False
        if lang in self.cased:
            clean = nxt.lstrip(STRIP)
            if clean[:1].islower() and not any(x.isupper() for x in clean):
                return False
        a, b = self.end(lang, word), self.start(lang, nxt)
        if lang == "ko":
            # a heading's last word, or that of a sentence
            return b > -4 and (a > -self.LINE_PRIOR or a > 0 and core(word)[-1:] in self.model["closers"].get(lang, ()) or a > 1.5 and b > 0)
        if lang == "hi":
            return a > 0.5 and b > -2 and a + b + self.LINE_PRIOR > -2
        return b > 0 and a + b + self.LINE_PRIOR > 0

    def _spans(self, block: str, lang: str) -> list[tuple[int, int]]:
        out, opener = [], OPENER.search(block)
        while opener:
            m = SPAN.match(block, opener.start())
            if m:
                out.append(m.span())
            opener = OPENER.search(block, m.end() if m else opener.end())
        return out

    def units(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        base = cache(partial(self.languages.latin, text))
        for bs, be in blocks_of(text):
            block = text[bs:be]
            lang = self.languages.of(block, base)
            at = 0
            for cut in [*self._cuts(block, lang), len(block)]:
                piece = block[at:cut].lstrip()
                if piece:
                    left = bs + cut - len(piece)
                    out.append((left, left + len(piece.rstrip())))
                at = cut
        return out

    def _cuts(self, block: str, lang: str) -> list[int]:
        spans = self._spans(block, lang)
        events = []
        for m in SIGNS.finditer(block):
            s, e = m.span()
            if e - s == 1:
                events.append((s, e, 0))
            else:
                events += [(x.start(), x.end(), 0) for x in SIGN.finditer(block, s, e)]
        if spans or lang == "th":
            events += [(s, e, 1) for s, e in spans]
            if lang == "th":
                events += [(m.start(), m.end(), 2) for m in THAI_SPACE.finditer(block)]
            events.sort(key=lambda x: (x[0], -x[1]))
        cuts: list[int] = []
        unit, marked, inside = 0, bool(MARK.match(block)), 0
        for s, e, kind in events:
            if s < inside:
                # a mark at the start of a line ends even an open bracket or quotation
                continue
            cut = -1
            if kind == 1:
                inside = e
                if not marked and INNER_END.search(block[s + 1 : e]) and self._after_span(block, lang, s, e, unit):
                    cut = e
            elif kind == 2:
                if not marked and self._thai(block, s, e):
                    cut = e
            elif block[s] == "\n":
                if self._line(block, lang, unit, s, marked):
                    cut = e
            elif not marked:
                c = block[s]
                if c == ".":
                    if self._period(block, lang, s, e):
                        cut = e
                elif c == "…":
                    rest = block[e : e + REACH]
                    if rest[:1].isspace() and lang in self.cased and rest.strip()[:1].isupper() and self.start(lang, rest.split()[0]) > 0:
                        cut = e
                elif c in "!?":
                    rest = block[e : e + REACH].lstrip()
                    if not (rest[:1].islower() or rest[:1] in ",;:)]”»’"):
                        cut = e
                else:
                    cut = e
            if cut > 0:
                # closing signs that stand right behind belong to the unit
                while cut < len(block) and block[cut] in CLOSING and not any(a == cut for a, _ in spans):
                    cut += 1
                cuts.append(cut)
                unit = cut
                marked = block[cut - 1] == "\n" and bool(MARK.match(block, cut))
        return cuts

    def _after_span(self, block: str, lang: str, s: int, e: int, unit: int) -> bool:
        """Does a quotation or bracket that holds a sentence end also end the unit around it?"""
        if block[s] in "([（" and block[unit:s].strip():
            return False
        rest = block[e : e + REACH]
        if not rest.strip():
            return False
        nxt = rest.split(None, 1)[0]
        if not rest[0].isspace():
            if lang == "zh" or lang == "ja" and block[s] in "（(":
                clean = rest.lstrip("“「『‘（(")
                return clean[:1] not in STRIP and self.model["start"].get(lang, {}).get("s:" + clean[:1], 0.0) > -3
            return False
        if rest.lstrip()[0] in ",;:.!?–-":
            return False
        if lang in self.cased:
            clean = nxt.lstrip(STRIP)
            return not (clean[:1].islower() and not any(x.isupper() for x in clean))
        if lang == "hi":
            return nxt[0] in "“‘\"(" or self.start(lang, nxt) > 0
        return True

    def _thai(self, block: str, s: int, e: int) -> bool:
        # four characters on either side are all that the model knows
        before, after = block[max(0, s - 4) : s].split()[-1], block[e : e + 4].split(None, 1)[0]
        if before[-1:] in "”»":
            return after[:1] not in ",;:"
        a = self.model["end"].get("th", {}).get("e:" + before[-4:], -3.0)
        b = self.model["start"].get("th", {}).get("s:" + after[:4], -0.5)
        return a > 0.7 and b > -3


def word_before(block: str, least: int, at: int) -> str:
    """What stands before ``at`` without white space, from ``least`` on."""
    word = block[max(least, block.rfind(" ", least, at) + 1) : at]
    return word.rsplit(None, 1)[-1] if word and not word[-1].isspace() else ""


def unicode_letter(c: str) -> bool:
    """A letter of a script without case."""
    return c.isalpha() and not c.islower() and not c.isupper()


def sentence_units(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start_pos, end_pos) of every sentence unit, in code points.

    ``texts`` has (key, text) and may have (lang), a label that need not be right.
    Null, empty and blank texts have no unit. Repeated rows give their units once;
    of several texts under one key all units are given. All units of a text together
    hold all its characters that are not white space.
    """
    rows = spread(texts.select(key, "text", *[c for c in ("lang",) if c in texts.columns and c != key]).filter(F.col("text").isNotNull() & F.col(key).isNotNull()), key)
    shared = texts.sparkSession.sparkContext.broadcast(pickle.dumps(learn(rows)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(pickle.loads(shared.value))
        for batch in batches:
            found = [classifier.units(t) for t in batch.column("text").to_pylist()]
            n = np.array([len(u) for u in found], np.int64)
            flat = np.fromiter((x for u in found for unit in u for x in unit), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=[key, "start_pos", "end_pos"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "text").mapInArrow(cut, f"{key} {kind}, start_pos bigint, end_pos bigint").distinct()


def p8_found(spark, sf_dir: str) -> DataFrame:
    return sentence_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))
