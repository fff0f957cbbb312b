"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions, whether they need conversion or are images, and their media types.
EXTENSIONS = {
    ".pdf": (False, False, "application/pdf"),
    ".hwp": (True, False, "application/x-hwp"),
    ".hwpx": (True, False, "application/hwp+zip"),
    ".docx": (True, False, "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ".pptx": (False, False, "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ".md": (False, False, "text/markdown"),
    ".csv": (False, False, "text/csv"),
    ".xlsx": (False, False, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ".jpg": (False, True, "image/jpeg"),
    ".jpeg": (False, True, "image/jpeg"),
    ".png": (False, True, "image/png"),
    ".bmp": (False, True, "image/bmp"),
    ".tiff": (False, True, "image/tiff"),
    ".tif": (False, True, "image/tiff"),
    ".webp": (False, True, "image/webp"),
}
# Section names that say nothing about a document.
GENERIC_SECTIONS = ["문서 헤더", "헤더", "개요", "서론", "목차", "서문", "소개", "본문", "introduction", "header", "overview", "preface", "contents", "table of contents"]

HANGUL = "[가-힣]"
IDEOGRAPH = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^./]+$", "")


def token_estimate(text: Column) -> Column:
    """Half a token a Hangul syllable, a quarter any other character, cut to a whole number."""
    hangul = F.regexp_count(text, F.lit(HANGUL))
    return F.floor(hangul / 2 + (F.char_length(text) - hangul) / 4).cast("bigint")


def token_estimate_lang(text: Column) -> Column:
    """The estimate above where Hangul makes up more than a tenth, else 1.3 tokens a word."""
    hangul = F.regexp_count(text, F.lit(HANGUL))
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(hangul > 0.1 * F.greatest(F.char_length(text), F.lit(1)), token_estimate(text)).otherwise(F.floor(words * 1.3 + 1e-9).cast("bigint"))


def lower_all(text: Column) -> Column:
    """Lower case without regard to a letter's place in its word."""
    return F.lower(F.translate(text, "Σ", "σ"))


def normalize_title(text: Column) -> Column:
    return lower_all(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))


def analyze(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(lower_all(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


# Endings that the stemmed analysis takes off English words, and particles that it takes off Korean ones.
ENGLISH_ENDING = r"^([a-z]{3,}?)(?:ingly|edly|ings|ing|ed|ies|es|s)$"
KOREAN_PARTICLE = r"^([가-힣]{2,}?)(?:으로|에서|에게|까지|부터|은|는|이|가|을|를|의|에|로|와|과|도)$"


def stemmed(tokens: Column) -> Column:
    """Tokens without English endings and Korean particles; other scripts and short words stay as they are."""
    stem = lambda w, p: F.coalesce(F.nullif(F.regexp_extract(w, p, 1), F.lit("")), w)
    return F.transform(tokens, lambda w: stem(stem(w, ENGLISH_ENDING), KOREAN_PARTICLE))


def normalize_space(text: Column) -> Column:
    """Private-use characters and entities gone, every run of white space one space."""
    return F.trim(F.regexp_replace(clean(text), r"[\s\x{A0}\x{3000}]+", " "))


def sentences(text: Column, shortest: int = 10) -> Column:
    """Cut behind terminators followed by white space; pieces of at least ``shortest`` characters."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.char_length(s) >= shortest)


def has_ideograph(text: Column) -> Column:
    return text.rlike(IDEOGRAPH)


def clean(text: Column) -> Column:
    """Entities, repeated image marks, spaces before punctuation, long runs of line breaks."""
    for a, b in ((r"&lt;", "<"), (r"&gt;", ">"), (r"&amp;", "&"), (r"(<!-- image -->\n*){2,}", "<!-- image -->\n\n"), (r"\s+\.(\s)", ".$1"), (r"\s+,(\s)", ",$1"), (r"\n{4,}", "\n\n\n"), (r"[\x{f000}-\x{f0ff}]", "")):
        text = F.regexp_replace(text, a, b)
    return text


def json_slice(text: Column) -> Column:
    """From the first opening to the last closing brace, if that is JSON."""
    cut = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(cut).isNotNull(), cut)


def heading_level(style: Column) -> Column:
    n = F.coalesce(F.nullif(F.regexp_extract(style, r"^[Hh]eading\s+(\d)", 1), F.lit("")), F.nullif(F.regexp_extract(style, r"^제목\s*(\d)", 1), F.lit("")))
    return F.least(n.cast("int"), F.lit(3))


def classify_depth(title: Column) -> Column:
    """1 for titles behind a square or diamond, 2 behind ``n. ``, else 3."""
    t = F.trim(title)
    return F.when(t.rlike("^[□■◆]"), 1).when(t.rlike(r"^\d+\.\s"), 2).otherwise(3)


def document_name(paths: Column, source_path: Column) -> Column:
    """Top segment of the first section path that says something, else the file's stem. ``paths`` is in order."""
    tops = F.transform(paths, lambda p: F.trim(F.split_part(p, F.lit(">"), F.lit(1))))
    good = F.filter(tops, lambda t: (t != "") & ~F.lower(t).isin(GENERIC_SECTIONS))
    return F.coalesce(F.get(good, F.lit(0)), stem(source_path))


def citation(name: Column, first: Column, last: Column) -> Column:
    return F.when(first.isNull(), name).when(first == last, F.concat(name, F.lit(", p."), first.cast("string"))).otherwise(F.concat(name, F.lit(", pp."), first.cast("string"), F.lit("-"), last.cast("string")))


def contextual_prefix(domain: Column, document: Column, major: Column, title: Column, proposition: Column) -> Column:
    section = F.when(F.coalesce(major, F.lit("")) == "", title).otherwise(F.concat(major, F.lit(" > "), title))
    return F.concat(F.lit("["), F.coalesce(domain, F.lit("")), F.lit("]\n["), F.coalesce(document, F.lit("")), F.lit("]\n[section: "), F.coalesce(section, F.lit("")), F.lit("]\n"), proposition)


def object_key(prefix: str, day: Column, path: Column) -> Column:
    return F.concat(F.lit(prefix + "/"), F.date_format(day, "yyyyMMdd"), F.lit("/"), stem(path), F.lit("_"), F.substring(F.md5(file_name(path)), 1, 8), extension(path))
