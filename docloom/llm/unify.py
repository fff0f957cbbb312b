"""One consistent form for text that looks the same.

Method: compatibility normalisation in composed form (NFKC), full case folding,
white space of every kind mapped to the ordinary space, and removal of
default-ignorable characters that the word's own script does not need; letters
of another script that stand for Latin ones inside a word become Latin. Only
texts that hold a character that a rule may change reach Python, each distinct text once.

Scale: the search for characters is a JVM regular expression in the scan, a
narrow one for the kinds and a wide one for the form; the distinct texts that
pass it are shuffled, and a text repeated in a third of all rows is handled once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import normalize_title

from .common import spread

# Letters of Cyrillic and Greek and the Latin letters that they look like.
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ё": "ë", "ӏ": "l", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ӏ": "I", "Ү": "Y", "З": "3",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
# Of these only the shapes that equal a Latin letter beyond doubt make a whole word suspicious.
WHOLE = frozenset("аеорсухѕіјһԁԛԝАВЕКМНОРСТХЅІЈоνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "ο")

INVISIBLE = regex.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\uFFF0-\uFFF8\U0001BCA0-\U0001BCA3\U0001D173-\U0001D17A\U000E0000-\U000E0FFF]")
_JOINED = r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Nko}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Tibetan}\p{Myanmar}]"
# What a word's own script needs: joiners between joining letters, breaks in scripts without spaces, joiners and selectors of pictographs, jamo fillers beside jamo.
NEEDED = regex.compile(
    rf"(?<={_JOINED})[‌‍](?={_JOINED}|$|\P{{L}})|(?<=[\p{{Khmer}}\p{{Thai}}\p{{Lao}}\p{{Myanmar}}])​(?=[\p{{Khmer}}\p{{Thai}}\p{{Lao}}\p{{Myanmar}}])"
    r"|(?<=[\p{Extended_Pictographic}️])[‍️]|ᅟ(?=[ᅠ-ᆧ])|(?<=[ᄀ-ᅟ])ᅠ|(?<=\p{Mongolian})[᠋-᠏]|[‪-‮⁦-⁩‎‏؜](?=.*[\p{Arabic}\p{Hebrew}])"
)
SPACE = regex.compile(r"[\u0009\u000B\u000C\u0085   -     　]")
ODD_SPACE = regex.compile(r"[   -   　]")
FORM = regex.compile(r"[０-９Ａ-Ｚａ-ｚｦ-ￜﬀ-ﬆﬓ-ﬗיִ-ﷻﹰ-ﻼ]")
CLUSTER = regex.compile(r"[^\p{M}\s][\p{M}]+|[ᄀ-ᅟ][ᅠ-ᆧ][ᆨ-ᇿ]?|[가-힣][ᆨ-ᇿ]")
WORDS = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}]+")
FOREIGN = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
LATIN = regex.compile(r"\p{Latin}")

# Java: a character that one of the rules could change.
SUSPICIOUS = (
    r"[\p{M}ᄀ-ᇿ０-９Ａ-Ｚａ-ｚｦ-ￜﬀ-ﷻﹰ-﻿   -‏‪-  -⁯　"
    r"­͏؜឴឵᠋-᠏ㅤ︀-️\p{IsGreek}\p{IsCyrillic}\x{FFF0}-\x{FFF8}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
)


# Java: a character outside the ranges that no rule touches; cheap, and false for most texts.
UNUSUAL = r"[^\x00-\x7E가-힣À-ɏ一-鿿ぁ-ゖァ-ヿ–—‘’“”„«»…、。「」（）：]"


# Java: a character outside those that ``plain_form`` brings into the one form as ``canonical`` does, whatever stands beside them.
CHANGEABLE = (
    r"[^\x00-\x7E\x85\u00A1-\u00A7\u00A9\u00AB\u00AC\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u012F\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u01CD-\u01F0\u01F4-\u024F"
    r"\u0621-\u063A\u0641-\u064A\u1E9E\u2010\u2012-\u2016\u2018-\u2023\u20AC\u2190-\u21FF\u3001-\u301F\u3041-\u3096\u30A1-\u30FE\u4E00-\u9FFF\uAC00-\uD7A3]"
)


def suspicious(text: Column) -> Column:
    """Whether one of the kinds may occur."""
    return text.rlike(UNUSUAL) & text.rlike(SUSPICIOUS)


def changeable(text: Column) -> Column:
    """Whether ``plain_form`` may not be the one form."""
    return text.rlike(CHANGEABLE)


def strip_invisible(text: str) -> str:
    """Without default-ignorable characters, but for those that their script needs."""
    if not INVISIBLE.search(text):
        return text
    needed = {m.start() for m in NEEDED.finditer(text)}
    return INVISIBLE.sub(lambda m: m.group() if m.start() in needed else "", text)


def lookalike_words(text: str) -> list[tuple[int, int]]:
    """Spans of words in which letters of another script stand for Latin ones.

    A word that mixes Latin with foreign letters of a Latin shape is one, unless
    it also holds foreign letters without a Latin shape. A word of such shapes
    alone is one, unless the word beside it is a genuine one of that script.
    """
    if not FOREIGN.search(text):
        return []
    words = [(m.start(), m.end(), m.group()) for m in WORDS.finditer(text)]
    kinds = []
    for _, _, w in words:
        foreign = FOREIGN.findall(w)
        if not foreign:
            kinds.append("latin")
        elif LATIN.search(w):
            kinds.append("mixed" if any(c in LOOKALIKE for c in foreign) and (all(c in LOOKALIKE for c in foreign) or len(foreign) * 2 <= len(w)) else "genuine")
        else:
            kinds.append("whole" if all(c in WHOLE for c in foreign) else "genuine")
    out = []
    for i, (s, e, _) in enumerate(words):
        beside = kinds[max(0, i - 1) : i] + kinds[i + 1 : i + 2]
        if kinds[i] == "mixed" or kinds[i] == "whole" and "genuine" not in beside:
            out.append((s, e))
    return out


def canonical(text: str, fold: bool = True) -> str:
    """The one form. Without ``fold`` letters keep their case."""
    text = unicodedata.normalize("NFKC", strip_invisible(text))
    text = strip_invisible(text)
    spans = lookalike_words(text)
    for s, e in reversed(spans):
        text = text[:s] + "".join(LOOKALIKE.get(c, c) for c in text[s:e]) + text[e:]
    text = SPACE.sub(" ", text)
    return unicodedata.normalize("NFKC", text.casefold()) if fold else text


def kinds_of(text: str) -> list[str]:
    """Which of form, composed, invisible, space and lookalike occur."""
    out = []
    bare = strip_invisible(text)
    if FORM.search(bare):
        out.append("form")
    if any(len(unicodedata.normalize("NFC", m.group())) < len(m.group()) for m in CLUSTER.finditer(bare)):
        out.append("composed")
    if bare != text:
        out.append("invisible")
    if ODD_SPACE.search(text):
        out.append("space")
    if FOREIGN.search(bare) and lookalike_words(unicodedata.normalize("NFKC", bare)):
        out.append("lookalike")
    return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("text"), pa.array([canonical(t) for t in texts], pa.string()), pa.array([kinds_of(t) for t in texts], pa.list_(pa.string()))],
            names=["text", "form", "kinds"],
        )


def plain_form(text: Column) -> Column:
    """The form of a text without changeable characters: case folding and white space need no Python."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "ß|ẞ", "ss"), r"[\t\x{0B}\f\x{85}]", " "))


def unified(texts: DataFrame, gate=changeable) -> tuple[DataFrame, DataFrame]:
    """``texts`` (tbl, id, text), and (text, form, kinds) of its distinct texts that pass the gate."""
    texts = texts.select("tbl", "id", "text").filter("text is not null")
    odd = texts.filter(gate(F.col("text"))).select("text").distinct()
    return texts, odd.mapInArrow(_each, "text string, form string, kinds array<string>")


def found_kinds(texts: DataFrame) -> DataFrame:
    """(table_name, record_id, kind), one row per record and kind.

    Null ids and texts give no row; repeated rows count once; of several texts
    under one id all kinds are given.
    """
    rows, forms = unified(texts, suspicious)
    odd = rows.filter("id is not null").filter(suspicious(F.col("text")))
    hit = odd.join(forms.filter(F.size("kinds") > 0).select("text", "kinds"), "text")
    return hit.select(F.col("tbl").alias("table_name"), F.col("id").alias("record_id"), F.explode("kinds").alias("kind")).distinct()


def one_form(texts: DataFrame) -> DataFrame:
    """(table_name, record_id, form): every distinct record with a text, in its one form."""
    rows, forms = unified(texts)
    odd = changeable(F.col("text"))
    easy = rows.filter(~odd).select("tbl", "id", plain_form(F.col("text")).alias("form"))
    hard = rows.filter(odd).join(forms.select("text", "form"), "text").select("tbl", "id", "form")
    return easy.unionByName(hard).select(F.col("tbl").alias("table_name"), F.col("id").alias("record_id"), "form").distinct()


def catalogue_texts(spark, sf_dir: str) -> DataFrame:
    """(tbl, id, text) of the titles and of text and table content."""
    toc = spark.read.parquet(f"{sf_dir}/toc_nodes.parquet").select(F.lit("toc_nodes").alias("tbl"), F.col("node_id").alias("id"), F.col("title").alias("text"))
    blocks = spark.read.parquet(f"{sf_dir}/parser_blocks.parquet").filter("block_type in ('text', 'table')").select(F.lit("parser_blocks").alias("tbl"), "id", F.col("content").alias("text"))
    return spread(toc.unionByName(blocks).filter("text is not null"), "id")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return found_kinds(catalogue_texts(spark, sf_dir))


def p5_forms(spark, sf_dir: str) -> DataFrame:
    """The one form of every title and content, as a digest with its length."""
    return one_form(catalogue_texts(spark, sf_dir)).select("table_name", "record_id", F.md5("form").alias("form_md5"), F.length("form").alias("form_chars"))


def p5_titles_matched(spark, sf_dir: str) -> DataFrame:
    """Per document the distinct toc titles, those that equal a section title of the document as they are, in the one form, and in the letters and digits of that form."""
    toc = spark.read.parquet(f"{sf_dir}/toc_nodes.parquet").select("document_id", "title")
    sec = spark.read.parquet(f"{sf_dir}/parser_sections.parquet").select("document_id", "title")
    both = toc.withColumn("tbl", F.lit("toc")).unionByName(sec.withColumn("tbl", F.lit("sec"))).filter("title is not null and document_id is not null").distinct()
    _, forms = unified(both.select("tbl", F.lit(0).alias("id"), F.col("title").alias("text")))
    both = both.join(forms.select(F.col("text").alias("title"), "form"), "title", "left").withColumn("form", F.coalesce("form", plain_form(F.col("title"))))
    both = both.withColumn("bare", normalize_title(F.col("form")))
    sec = both.filter("tbl = 'sec'")
    left = both.filter("tbl = 'toc'").join(sec.select("document_id", "title", F.lit(1).alias("same")), ["document_id", "title"], "left")
    left = left.join(sec.select("document_id", "form", F.lit(1).alias("alike")).distinct(), ["document_id", "form"], "left")
    left = left.join(sec.filter("bare <> ''").select("document_id", "bare", F.lit(1).alias("near")).distinct(), ["document_id", "bare"], "left")
    return left.groupBy("document_id").agg(F.count(F.lit(1)).alias("titles"), F.count("same").alias("equal_as_is"), F.count("alike").alias("equal_in_form"), F.count(F.coalesce("alike", "near")).alias("equal_in_letters"))
