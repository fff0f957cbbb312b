"""Repair of text from scanned pages.

Method: anagram hashing. The hash of a word is the sum of a power of its
characters' code points, so that replacing characters changes it by a fixed
difference, wherever in the word they stand. Rare words of scanned pages are
joined in SQL with the known words of the collection over the differences of
confusions, one or two a word (the second is taken back from the known word's side); candidates are checked by replacing the characters,
and ranked by the evidence for the confusion and the frequency of the word. The
confusions are learnt: long rare words are joined with common ones that share their
first or last half, and what differs is counted; a few that scanners are known for
start with a little evidence. A correction is ``RATIO`` times as frequent as the rare
word or more; with two confusions, it is a common word. Edge lines that repeat the name of document, section or
issuing body, and page numbers in step with the page, are removed; words broken at a
line end are put together where hyphens and word counts speak for it.

A word is known if clean pages hold it ``MIN_KNOWN`` times and not far more rarely
than scanned ones do, whatever the size of the collection.

Scale: counting words is a map with partial counts. Words are looked up by joins on
the word or its hash; the words of a share of ``COMMON`` or more, 1 / ``COMMON`` at
most, are also sent to the tasks, which leave them out of the join. Everything about
a document goes by equi-joins on document and line key or page, never by a group of
all its pages; the order of its paragraphs goes over ranges of its pages.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.sections import ranges

from .common import materialize, spread

MIN_KNOWN, RATIO, CLEAN_RATE, COMMON = 4, 20, 0.2, 1e-5
# Confusions: least words and least share of the evidence of a learnt one, least length (in parts) of words to learn from.
EVIDENCE, EVIDENCE_SHARE, LEARN_FROM = 5, 1e-3, 10
MIN_LINES = 6.0

# What scanners are known to read wrongly, and what stood there; Korean by the parts of its syllables. They start with a little evidence.
CONFUSIONS = [
    ("c", "e"), ("f", "t"), ("l", "i"), ("i", "l"), ("0", "o"), ("ri", "n"), ("5", "s"), ("ii", "u"), ("cl", "d"), ("1", "l"), ("1", "i"), ("rn", "m"), ("b", "h"), ("q", "g"), ("6", "b"), ("vv", "w"), ("r", "v"), ("9", "g"), ("8", "b"), ("2", "z"),
    ("e", "c"), ("h", "b"), ("t", "f"), ("m", "rn"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("li", "h"), ("in", "m"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("e", "é"), ("6", "é"),
    ("ᅡ", "ᅵ"), ("ᅦ", "ᅢ"), ("ᄆ", "ᄇ"), ("ᅵ", "ᅥ"), ("ᅵ", "ᅡ"), ("ᅵᆨ", "ᅴ"), ("ᅥ", "ᅵ"), ("ᅱ", "ᅯ"), ("ᅩ", "ᅳ"), ("ᅩ", "ᅭ"), ("ᆷ", "ᆼ"), ("ᅮ", "ᅲ"), ("ᆸ", "ᆷ"), ("파", "과"), ("ᅢ", "ᅦ"), ("ᄇ", "ᄆ"), ("ᅯ", "ᅱ"), ("ᆼ", "ᆷ"),
]
# Letters read for digits.
DIGITS = str.maketrans({"l": "1", "i": "1", "I": "1", "|": "1", "o": "0", "O": "0", "b": "6", "B": "8", "z": "2", "Z": "2", "s": "5", "S": "5", "g": "9", "q": "9"})

PUNCTUATION = ".,;:!?()[]{}\"“”„‘’«»‹›、。（）「」|·…"
HYPHEN = "-¬‐­"
NUMBER_MISREAD = regex.compile(r"^(?=.*\d)[\dlIoObBzZsSgqi|]+(?:[.,:/][\dlIoObBzZsSgqi|]+)*$")
KOREAN_NUMBER = regex.compile(r"^([\dlIoObBzZsSgqi|]*\d[\dlIoObBzZsSgqi|]*)(\p{Hangul}+)$")
HEAD_NUMBER = r"[\[(（<{\-–—~·•*=\s]*(?:(?:page|seite|p|s|pag|pg|第|nr|no)\.?\s*)?([\dlIOoSBZb|]{1,4})(?:\s*(?:/|of|von|sur|de|aus|\|)\s*[\dlIOoSBZb|]{1,4})?\s*(?:쪽|페이지|면|ページ|頁|页)?[\])）>}\-–—~·•*=\s]*"
ONLY_NUMBER = regex.compile(rf"^{HEAD_NUMBER}$", regex.IGNORECASE)
NUMBER_FIRST = regex.compile(rf"^{HEAD_NUMBER}(?:\s*[|·•]\s*|\s{{2,}})(\S.*)$", regex.IGNORECASE)
NUMBER_LAST = regex.compile(rf"^(.*?\S)(?:\s*[|·•]\s*|\s{{2,}}){HEAD_NUMBER}$", regex.IGNORECASE)
ROMAN = regex.compile(r"^[\[(（\-–—\s]*(m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3}))[\])）\-–—.\s]*$", regex.IGNORECASE)


def parts(word: str) -> str:
    """Lower-cased, Korean syllables as their parts, other letters composed."""
    return "".join(unicodedata.normalize("NFD", c) if "가" <= c <= "힣" else c for c in unicodedata.normalize("NFC", word.lower()))


def anagram_hash(word: str) -> int:
    return sum(ord(c) ** 3 for c in word)


def bare(token: str) -> str:
    return token.strip(PUNCTUATION).lower()


def _counted(counters: tuple[Counter, ...]) -> pa.RecordBatch:
    rows: Counter = Counter()
    for i, counter in enumerate(counters):
        for token, n in counter.items():
            w = bare(token)
            if w and not any(c.isdigit() for c in w):
                rows[(w, i)] += n
        counter.clear()
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int32()), pa.array(list(rows.values()), pa.int64())], names=["word", "kind", "n"])


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: all words."""
    every: Counter = Counter()
    for batch in batches:
        for text in batch.column("content").to_pylist():
            every.update(text.split())
        if len(every) > 500_000:
            yield _counted((every,))
    yield _counted((every,))


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: all words, kind 1: those inside lines; the ends of scanned lines may be broken words."""
    every, inner = Counter(), Counter()
    for batch in batches:
        for text, copies in zip(batch.column("content").to_pylist(), batch.column("copies").to_pylist()):
            for _ in range(copies):
                every.update(text.split())
            for line in text.split("\n"):
                inner.update(line.split()[1:-1])
        if len(every) > 500_000:
            yield _counted((every, inner))
    yield _counted((every, inner))


def word_counts(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(word, clean, noisy): how often other pages and how often the lines of ``pages``, the scanned ones, hold a word. Repeated rows of other pages count as they come."""
    texts = spread(blocks.select("content").filter("content is not null"), "content")
    schema = "word string, kind int, n bigint"
    everything = texts.mapInArrow(_all_words, schema)
    noisy = spread(pages.select("content", "copies"), "content").mapInArrow(_page_words, schema)
    both = everything.unionByName(noisy.select("word", (F.col("kind") + 1).alias("kind"), "n"))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return both.groupBy("word").agg((n(0) - n(1)).alias("clean"), n(2).alias("noisy"))


def known_words(counts: DataFrame) -> tuple[DataFrame, set[str]]:
    """(word, clean) of the known words, and the most common of them, 1 / ``COMMON`` at most."""
    total = counts.agg(F.sum("clean").alias("clean"), F.sum("noisy").alias("noisy")).first()
    clean, noisy = max(1, total.clean or 0), max(1, total.noisy or 0)
    known = counts.filter((F.col("clean") >= MIN_KNOWN) & (F.col("clean") * F.lit(float(noisy)) >= CLEAN_RATE * F.col("noisy") * F.lit(float(clean)))).select("word", "clean")
    return known, {r.word for r in known.filter(F.col("clean") >= COMMON * clean).select("word").collect()}


def scanned_pages(blocks: DataFrame) -> DataFrame:
    """(document_id, id, page, section_id, content, copies) of the scanned documents, one row per block, with the number of its rows.

    A document is scanned if its text blocks, as far as they name a page, have
    their own pages and hold ``MIN_LINES`` line breaks or more on average.
    """
    text = blocks.filter("block_type = 'text' and content is not null and id is not null and document_id is not null")
    breaks = F.length("content") - F.length(F.replace("content", F.lit("\n")))
    # repeated rows would distort the means, so one row per block first; no text is shuffled for it
    light = text.select("document_id", "id", "page", breaks.alias("breaks")).groupBy("document_id", "id").agg(F.max("page").alias("page"), F.max("breaks").alias("breaks"))
    paged = light.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sum("breaks").alias("breaks"))
    docs = paged.groupBy("document_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("page").isNotNull(), F.col("n"))).alias("paged"), F.count("page").alias("pages"), F.sum("breaks").alias("breaks"))
    docs = docs.filter((F.col("breaks") >= MIN_LINES * F.col("n")) & (F.col("pages") >= 0.75 * F.coalesce("paged", F.lit(0)))).select("document_id")
    rows = text.select("document_id", "id", "page", "section_id", "content").join(docs, "document_id", "left_semi")
    return rows.groupBy("id").agg(*[F.min(c).alias(c) for c in ("document_id", "page", "section_id", "content")], F.count(F.lit(1)).alias("copies"))


def norm(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def keys(n: str) -> list[str]:
    """Start, end and, in longer lines, middle of a normalised line: misread characters seldom leave none of them whole."""
    k = max(1, min(8, len(n) // 2))
    m = (len(n) - k) // 2
    return ["<" + n[:k], ">" + n[-k:]] + (["=" + n[m : m + k]] if len(n) >= 24 else [])


def edge_lines(lines: list[str]) -> list[int]:
    full = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({*full[:2], *full[-2:]})


def read_edge(line: str) -> tuple[str, int | None]:
    """The line without a page number, and the number (-1: unreadable), None if it has none."""
    x = line.strip()
    m = ONLY_NUMBER.match(x)
    if m:
        digits = m.group(1).translate(DIGITS)
        return "", int(digits) if digits.isdigit() else -1
    m = NUMBER_FIRST.match(x)
    if m:
        digits = m.group(1).translate(DIGITS)
        return m.group(2), int(digits) if digits.isdigit() else -1
    m = NUMBER_LAST.match(x)
    if m:
        digits = m.group(2).translate(DIGITS)
        return m.group(1), int(digits) if digits.isdigit() else -1
    m = ROMAN.match(x)
    if m and m.group(1):
        value, last = 0, 0
        for c in reversed(m.group(1).lower()):
            v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c]
            value, last = (value - v, last) if v < last else (value + v, v)
        return "", value
    return x, None


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, bid, page, text in zip(*[batch.column(c).to_pylist() for c in ("document_id", "id", "page", "content")]):
            lines = text.split("\n")
            edge = edge_lines(lines)
            for i in edge:
                rest, number = read_edge(lines[i])
                n = norm(rest)
                top = i in edge[:2] and i <= edge[1 if len(edge) > 1 else 0]
                rows.append((doc, bid, page, i, top, number, n, keys(n), number is not None and bool(n)))
        cols = list(zip(*rows)) if rows else [[] for _ in range(9)]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["document_id", "id", "page", "line_no", "top", "number", "norm", "keys", "joint"])


def _inner(longest: int):
    """Normalised lines inside the pages, and second copies of an edge line: where headings stand. Lines beyond the longest name are none."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, norms = [], []
            for doc, text in zip(batch.column("document_id").to_pylist(), batch.column("content").to_pylist()):
                lines = text.split("\n")
                edge, seen = set(edge_lines(lines)), set()
                for i, x in enumerate(lines):
                    if 3 <= len(x.strip()) <= 4 * longest:
                        n = norm(x)
                        if len(n) <= longest:
                            if i not in edge or n in seen:
                                docs.append(doc), norms.append(n)
                            seen.add(n)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(norms, pa.string())], names=["document_id", "norm"])

    return inner


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [norm(t) for t in batch.column("title").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("kind"), pa.array(n, pa.string()), pa.array([keys(x) for x in n], pa.list_(pa.string()))], names=["document_id", "kind", "name", "keys"])


def furniture(pages: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, line_no, header, number) of the edge lines that are no part of the text.

    ``sections`` and ``documents`` have (document_id, title).
    """
    edges = materialize(pages.mapInArrow(_edges, "document_id string, id bigint, page int, line_no int, top boolean, number int, norm string, keys array<string>, joint boolean"))
    scanned = pages.select("document_id").distinct()
    named = documents.select("document_id", F.lit("document").alias("kind"), "title").unionByName(sections.select("document_id", F.lit("section").alias("kind"), "title"))
    named = named.filter("title is not null and trim(title) <> ''").join(scanned, "document_id", "left_semi").distinct()
    names = materialize(named.mapInArrow(_norms, "document_id string, kind string, name string, keys array<string>").filter("length(name) >= 3"))
    full = edges.filter("length(norm) >= 3")
    # the name of an issuing body is in no table: what returns on other pages in the same form
    keyed = full.select("document_id", "id", "norm", F.explode("keys").alias("key"))
    back = keyed.groupBy("document_id", "key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("document_id", "key")
    back = keyed.join(back, ["document_id", "key"], "left_semi").select("document_id", "key", F.lit("repeated").alias("kind"), F.col("norm").alias("name")).distinct()
    wanted = names.select("document_id", "kind", "name", F.explode("keys").alias("key")).unionByName(back.select("document_id", "kind", "name", "key"))
    most = F.greatest(F.lit(1), F.floor(F.length("name") * 0.2))
    near = keyed.join(wanted, ["document_id", "key"]).filter((F.abs(F.length("norm") - F.length("name")) <= most) & (F.levenshtein("norm", "name") <= most)).distinct()
    near = materialize(near)  # read three times below
    # a line that "returns" must be near a line of another page; its own text is nothing
    rep = near.filter("kind = 'repeated'").select("document_id", "name", "norm", "id").distinct()
    again = rep.groupBy("document_id", "name").agg(F.count_distinct("id").alias("n")).filter("n > 1")
    rep = rep.join(again.select("document_id", "name"), ["document_id", "name"], "left_semi").select("document_id", "norm", F.lit("repeated").alias("kind"), "name")
    match = near.filter("kind <> 'repeated'").select("document_id", "norm", "kind", "name").unionByName(rep).distinct()
    best = match.groupBy("document_id", "norm").agg(F.max(F.when(F.col("kind") == "document", 1)).alias("is_doc"), F.max(F.when(F.col("kind") == "repeated", 1)).alias("is_rep"), F.min(F.when(F.col("kind") == "section", F.col("name"))).alias("section"))
    lines = full.join(best, ["document_id", "norm"])
    # the heading of a section stands once inside the text; if it does not, it is the first edge line of that name
    longest = names.agg(F.max(F.length("name")).alias("n")).first().n or 0
    inside = pages.mapInArrow(_inner(longest), "document_id string, norm string").distinct()
    inside = inside.join(names.filter("kind = 'section'").select("document_id", F.col("name").alias("norm")), ["document_id", "norm"], "left_semi")
    lines = materialize(lines.join(inside.select("document_id", F.col("norm").alias("section"), F.lit(True).alias("stands")), ["document_id", "section"], "left"))
    alone = lines.filter("section is not null and is_doc is null and not joint and stands is null").groupBy("document_id", "section").agg(F.min(F.struct(F.coalesce("page", F.lit(1 << 30)), "id", "line_no")).alias("at"))
    alone = alone.select(F.col("at.id").alias("id"), F.col("at.line_no").alias("line_no"), F.lit(True).alias("heading"))
    # below a header a section's title is its heading
    above = lines.filter("top").groupBy("id").agg(F.min("line_no").alias("first_header"))
    lines = lines.join(alone, ["id", "line_no"], "left").join(above, "id", "left")
    second = F.col("section").isNotNull() & F.col("is_doc").isNull() & F.col("top") & (F.col("line_no") > F.col("first_header"))
    bottom_section = ~F.col("top") & F.col("is_doc").isNull() & F.col("is_rep").isNull()
    header = lines.filter(~(F.coalesce("heading", F.lit(False)) | (second & ~F.col("joint")) | (bottom_section & ~F.col("joint")))).select("id", "line_no", F.lit(True).alias("header"))
    header = materialize(header.distinct())
    # page numbers keep one distance to the page
    numbered = edges.filter("number is not null")
    steps = numbered.filter("page is not null and number >= 0").groupBy("document_id", (F.col("number") - F.col("page")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    step = steps.groupBy("document_id").agg(F.max_by("step", F.struct("n", -F.abs("step"))).alias("step"))
    marked = numbered.join(step, "document_id", "left").join(header, ["id", "line_no"], "left")
    number = marked.filter((F.col("number") - F.col("page") == F.col("step")) | (F.col("number") == -1) | F.col("page").isNull() | (F.col("joint") & F.col("header"))).select("id", "line_no", F.lit(True).alias("number"))
    return header.join(number.distinct(), ["id", "line_no"], "full").select("id", "line_no", F.coalesce("header", F.lit(False)).alias("header"), F.coalesce("number", F.lit(False)).alias("number"))


def fix_number(token: str) -> str | None:
    """A number with letters in it, with its digits; None for anything else."""
    m = KOREAN_NUMBER.match(token)
    head, tail = (m.group(1), m.group(2)) if m else (token, "")
    if not NUMBER_MISREAD.match(head) or not any(c.isalpha() or c == "|" for c in head):
        return None
    digits, letters = sum(c.isdigit() for c in head), sum(c.isalpha() or c == "|" for c in head)
    if digits < letters or len(head) < 3 or regex.fullmatch(r"\d+[a-z]", head) and head[-1] not in "lobzs":
        return None
    return head.translate(DIGITS) + tail


def line_end(left: str, right: str) -> tuple[bool, str, str] | None:
    """(hyphen, head, tail) of a word that the end of a line may have broken: behind a hyphen, or inside Korean; None for all others."""
    if not left or not right:
        return None
    hyphen = left[-1] in HYPHEN
    head, tail = left.rstrip(HYPHEN).lstrip(PUNCTUATION).lower(), right.strip(PUNCTUATION + HYPHEN).lower()
    if not head or not tail or not tail[0].isalpha():
        return None
    if hyphen:
        return (True, head, tail) if left.rstrip(HYPHEN)[-1:].isalpha() and len(left) > 1 else None
    if left[-1] in PUNCTUATION or not ("가" <= head[-1] <= "힣") or not ("가" <= tail[0] <= "힣"):
        return None
    return False, head, tail


EVENT = "document_id string, page int, block_id bigint, line_no int, kind string, word string, head string, tail string, before int, after int"
EVENT_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())


def _events(shared):
    """Per page: numbers put right (``misread``), possible broken words (``hyphen``, ``bare``), words that are not common (``token``), and its first and last word.

    ``before`` and ``after`` of a token name the line whose end it may be a piece of.
    """

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pickle.loads(shared.value)
        for batch in batches:
            rows = []
            for doc, bid, page, text, gone in zip(*[batch.column(c).to_pylist() for c in ("document_id", "id", "page", "content", "gone")]):
                gone = set(gone or ())
                body = [(i, x.split()) for i, x in enumerate(text.split("\n")) if i not in gone and x.strip()]
                pair: dict[tuple[int, int], int] = {}
                tail: dict[tuple[int, int], int] = {}
                for (i, a), (j, b) in zip(body, body[1:]):
                    end = line_end(a[-1], b[0])
                    if end is not None:
                        pair[(i, len(a) - 1)] = tail[(j, 0)] = i
                        rows.append((doc, page, bid, i, "hyphen" if end[0] else "bare", None, end[1], end[2], None, None))
                if body:
                    rows.append((doc, page, bid, body[0][0], "first", body[0][1][0], None, None, None, None))
                    rows.append((doc, page, bid, body[-1][0], "last", body[-1][1][-1], None, None, None, None))
                for i, words in body:
                    for k, token in enumerate(words):
                        w = bare(token)
                        if not w or w in common:
                            continue
                        at = (tail.get((i, k)), pair.get((i, k)))
                        number = fix_number(token.strip(PUNCTUATION))
                        if number is not None:
                            rows.append((doc, page, bid, i, "misread", number.lower(), None, None, *at))
                        elif len(w) > 1 and any(c.isalpha() for c in w):
                            rows.append((doc, page, bid, i, "token", w, None, None, *at))
            rows = list(dict.fromkeys(rows))
            cols = list(zip(*rows)) if rows else [[] for _ in EVENT_KINDS]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, EVENT_KINDS)], names=[c.split()[0] for c in EVENT.split(", ")])

    return events


def _over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last word of a page with the first of the next, where that may be a broken word."""
    for batch in batches:
        ends = [line_end(a, b) for a, b in zip(batch.column("word").to_pylist(), batch.column("next").to_pylist())]
        keep = pa.array([e is not None for e in ends], pa.bool_())
        ends = [e for e in ends if e is not None]
        kind = pa.array(["hyphen" if e[0] else "bare" for e in ends], pa.string())
        yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(keep) for c in ("block_id", "line_no", "next_block")], kind, pa.array([e[1] for e in ends], pa.string()), pa.array([e[2] for e in ends], pa.string())], names=["block_id", "line_no", "next_block", "kind", "head", "tail"])


def broken_words(ends: DataFrame, known: DataFrame) -> DataFrame:
    """(block_id, line_no, next_block, kind, word): ``broken_word`` where counts speak for it, ``lookup`` behind a hyphen where the whole word is unknown.

    ``ends`` has (block_id, line_no, next_block, kind, head, tail). Behind a hyphen the
    more frequent of the joined and the hyphenated word counts; Korean is joined
    where the whole is five times as frequent as the rarer piece.
    """
    linked = F.concat(F.substring_index("head", " ", -1), F.lit("-"), "tail")
    e = ends.select("block_id", "line_no", "next_block", "kind", F.concat("head", "tail").alias("whole"), F.when(F.col("kind") == "hyphen", linked).alias("linked"), F.when(F.col("kind") == "bare", F.col("head")).alias("head"), F.when(F.col("kind") == "bare", F.col("tail")).alias("tail"))
    for c in ("whole", "linked", "head", "tail"):
        e = e.join(known.select(F.col("word").alias(c), F.col("clean").alias(f"n_{c}")), c, "left")
    e = e.na.fill(0, ["n_whole", "n_linked", "n_head", "n_tail"])
    sure = (F.col("n_whole") > 0) | (F.col("n_linked") > 0)
    better = F.when(F.col("n_whole") >= F.col("n_linked"), F.col("whole")).otherwise(F.col("linked"))
    korean = (F.col("n_whole") > 0) & (F.least("n_head", "n_tail") * 5 < F.col("n_whole"))
    kind = F.when((F.col("kind") == "hyphen") & sure, "broken_word").when(F.col("kind") == "hyphen", "lookup").when(korean, "broken_word")
    word = F.when((F.col("kind") == "hyphen") & sure, better).otherwise(F.col("whole"))
    return e.select("block_id", "line_no", "next_block", kind.alias("kind"), word.alias("word")).filter("kind is not null")


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long words with their first and last half as keys; known ones with those of the lengths that a misreading may have."""
    for batch in batches:
        rows = []
        for w, p, known, n in zip(*[batch.column(c).to_pylist() for c in ("word", "parts", "known", "clean")]):
            for h in {(m - 1) // 2 for m in ((len(p) - 1, len(p), len(p) + 1) if known else (len(p),))}:
                rows += [(w, p, known, n, "<" + p[:h]), (w, p, known, n, ">" + p[len(p) - h :])]
        cols = list(zip(*rows)) if rows else [[] for _ in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()))], names=["word", "parts", "known", "clean", "key"])


def residue(wrong: str, right: str) -> tuple[str, str]:
    """What differs between two words once the common start and end are gone."""
    a = 0
    while a < min(len(wrong), len(right)) and wrong[a] == right[a]:
        a += 1
    b = 0
    while b < min(len(wrong), len(right)) - a and wrong[-1 - b] == right[-1 - b]:
        b += 1
    return wrong[a : len(wrong) - b], right[a : len(right) - b]


def _residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [residue(a, b) for a, b in zip(batch.column("parts").to_pylist(), batch.column("right_parts").to_pylist())]
        keep = pa.array([1 <= len(x) <= 2 and 1 <= len(y) <= 2 for x, y in got], pa.bool_())
        got = [g for g, k in zip(got, keep.to_pylist()) if k]
        yield pa.RecordBatch.from_arrays([batch.column("word").filter(keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["word", "wrong", "right"])


def learnt_confusions(rare: DataFrame, common: DataFrame) -> list[tuple[str, str, float]]:
    """(wrong, right, evidence), most evidence first: what rare words have where common ones of the same first or last half differ.

    A word with several such partners counts in parts. Those of a share of ``EVIDENCE_SHARE`` are kept, 1 / ``EVIDENCE_SHARE`` at most.
    """
    schema = "word string, parts string, hash bigint, clean bigint"
    long = lambda df: df.select("word", "clean").mapInArrow(_with_counts, schema).filter(F.length("parts") >= LEARN_FROM)
    halves = lambda df, k: long(df).withColumn("known", F.lit(k)).select("word", "parts", "known", "clean").mapInArrow(_halves, "word string, parts string, known boolean, clean bigint, key string")
    right = halves(common, True).select("key", F.col("parts").alias("right_parts"), F.col("clean").alias("right_n"))
    pair = halves(rare, False).join(right, "key").filter((F.abs(F.length("parts") - F.length("right_parts")) <= 1) & (F.col("right_n") > RATIO * F.col("clean")))
    found = pair.select("word", "parts", "right_parts").distinct().mapInArrow(_residues, "word string, wrong string, right string").distinct()
    each = found.groupBy("word").agg((1.0 / F.count(F.lit(1))).alias("part"), F.collect_list(F.struct("wrong", "right")).alias("c")).select("part", F.explode("c").alias("c"))
    often = materialize(each.groupBy("c.wrong", "c.right").agg(F.sum("part").alias("n")).filter(F.col("n") >= EVIDENCE))
    total = often.agg(F.sum("n").alias("n")).first().n or 0.0
    rows = often.filter(F.col("n") >= EVIDENCE_SHARE * total).collect()
    seen = {(w, r): 2.0 * 0.93**i for i, (w, r) in enumerate(CONFUSIONS)}
    for r in rows:
        seen[(r.wrong, r.right)] = seen.get((r.wrong, r.right), 0.0) + r.n
    return sorted(((w, r, n) for (w, r), n in seen.items()), key=lambda x: (-x[2], x[0], x[1]))


def replaced(word: str, wrong: str, right: str) -> list[str]:
    """The word with the characters replaced at each place where they stand."""
    return [word[:i] + right + word[i + len(wrong) :] for i in range(len(word)) if word.startswith(wrong, i)]


def _tries(table: list[tuple[str, str, float]], back: bool):
    """The hashes that a word would have without a confusion that it may hold, or (``back``) before the last one was put right."""
    by: dict[str, list[int]] = {}
    for i, (wrong, right, _) in enumerate(table):
        by.setdefault(right if back else wrong, []).append(i)
    diff = [(anagram_hash(w) - anagram_hash(r)) if back else (anagram_hash(r) - anagram_hash(w)) for w, r, _ in table]
    lengths = sorted({len(x) for x in by})

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w, p, h, n in zip(*[batch.column(c).to_pylist() for c in ("word", "parts", "hash", "clean")]):
                rows += [(w, p, n, h + diff[i], i) for i in {i for k in lengths for at in range(len(p) - k + 1) for i in by.get(p[at : at + k], ())}]
            cols = list(zip(*rows)) if rows else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()))], names=["word", "parts", "clean", "hash", "c"])

    return tries


def _checked(table: list[tuple[str, str, float]]):
    """Hits of equal hash that the replacements, the second of which may be -1, really turn into the known word, with their score.

    Both confusions of two stand in the word as it is.
    """
    most = max(n for _, _, n in table)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for p, r, n, i, j in zip(*[batch.column(c).to_pylist() for c in ("parts", "right_parts", "right_n", "c1", "c2")]):
                good = (j < 0 or table[j][0] in p) and any(r == f if j < 0 else r in replaced(f, *table[j][:2]) for f in replaced(p, *table[i][:2]))
                weight = table[i][2] / most * (1.0 if j < 0 else table[j][2] / most)
                score.append(n * weight if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("right"), pa.array(score, pa.float64())], names=["word", "right", "score"])

    return checked


def corrections(rare: DataFrame, counts: DataFrame, known: DataFrame) -> DataFrame:
    """(word, right): the known word that a rare one is most likely a misreading of.

    ``rare`` has (word), ``counts`` (word, clean, noisy), ``known`` (word, clean).
    A word may hold one confusion, one of eight parts or more two; of several
    candidates the one with the most evidence times frequency wins, ties by the word.
    """
    hashed = rare.select("word").distinct().join(counts, "word", "left").na.fill(0).select("word", F.greatest("clean", F.lit(0)).alias("clean"))
    total = known.agg(F.sum("clean").alias("n")).first().n or 0
    common = known.filter(F.col("clean") >= COMMON * total)  # 1 / COMMON words at most
    table = learnt_confusions(hashed, common)
    schema, tried = "word string, parts string, hash bigint, clean bigint", "word string, parts string, clean bigint, hash bigint, c int"
    hashed = materialize(hashed.mapInArrow(_with_counts, schema).filter(F.length("word") >= 2))
    named = lambda df: df.select(F.col("word").alias("right"), F.col("parts").alias("right_parts"), "hash", F.col("clean").alias("right_n"), "c2")
    parted = lambda df: df.select("word", "clean").mapInArrow(_with_counts, schema)

    def best(words: DataFrame, right: DataFrame) -> DataFrame:
        hit = words.mapInArrow(_tries(table, False), tried).withColumnRenamed("c", "c1").join(right, "hash").filter(F.col("right_n") >= RATIO * (F.col("clean") + 1))
        good = hit.select("word", "right", "parts", "right_parts", "right_n", "c1", "c2").mapInArrow(_checked(table), "word string, right string, score double").filter("score is not null")
        return good.groupBy("word").agg(F.max_by("right", F.struct("score", "right")).alias("right"))

    one = materialize(best(hashed, named(materialize(parted(known.filter(F.col("clean") >= RATIO))).withColumn("c2", F.lit(-1)))))
    # any two confusions: the rare word without one meets the common word with the other
    before = materialize(parted(common).mapInArrow(_tries(table, True), tried).withColumnRenamed("c", "c2"))
    two = best(hashed.filter(F.length("parts") >= 8).join(one, "word", "left_anti"), named(before))
    return one.unionByName(two)


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = [parts(w) for w in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(p, pa.string()), pa.array([anagram_hash(x) for x in p], pa.int64()), batch.column("clean").cast(pa.int64())], names=["word", "parts", "hash", "clean"])


def analysed(blocks: DataFrame, sections: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """pages, furniture, events and corrections of the scanned documents."""
    pages = materialize(scanned_pages(blocks))
    counts = materialize(word_counts(blocks.filter("block_type = 'text'"), pages))
    known, common = known_words(counts)
    known = materialize(known)
    shared = blocks.sparkSession.sparkContext.broadcast(pickle.dumps(common))
    gone = materialize(furniture(spread(pages, "id"), sections, documents))
    flags = gone.groupBy("id").agg(F.collect_list("line_no").alias("gone"))  # at most four lines a page
    work = pages.join(flags, "id", "left").select("document_id", "id", "page", "content", "gone")
    events = materialize(work.mapInArrow(_events(shared), EVENT))
    first = events.filter("kind = 'first' and page is not null").groupBy("document_id", "page").agg(F.min(F.struct("block_id", "word")).alias("f")).select("document_id", "page", F.col("f.word").alias("next"), F.col("f.block_id").alias("next_block"))
    last = events.filter("kind = 'last' and page is not null").select("document_id", (F.col("page") + 1).alias("page"), "block_id", "line_no", "word")
    over = last.join(first, ["document_id", "page"]).select("block_id", "line_no", "word", "next", "next_block").mapInArrow(_over, "block_id bigint, line_no int, next_block bigint, kind string, head string, tail string")
    inside = events.filter("kind in ('hyphen', 'bare')").select("block_id", "line_no", F.lit(None).cast("bigint").alias("next_block"), "kind", "head", "tail")
    broken = materialize(broken_words(inside.unionByName(over), known))
    # pieces of broken words are no words
    pieces = broken.filter("next_block is null").select("block_id", F.col("line_no").alias("at"))
    loose = events.filter("kind in ('token', 'misread')").select("block_id", "line_no", "kind", "word", "before", "after")
    edge = loose.filter("before is not null or after is not null")
    for side in ("before", "after"):
        edge = edge.join(pieces.select("block_id", F.col("at").alias(side)), ["block_id", side], "left_anti")
    words = loose.filter("before is null and after is null").unionByName(edge.select(*loose.columns)).select("block_id", "line_no", "kind", "word")
    words = words.filter("kind = 'misread'").unionByName(words.filter("kind = 'token'").join(known.select("word"), "word", "left_anti").select("block_id", "line_no", "kind", "word"))
    events = materialize(words.unionByName(broken.select("block_id", "line_no", "kind", "word")).distinct())
    fixes = materialize(corrections(events.filter("kind in ('token', 'lookup')"), counts, known))
    return {"pages": pages, "gone": gone, "events": events, "fixes": fixes, "over": broken.filter("next_block is not null")}


def damaged_lines(blocks: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """(block_id, line_no, kind, word): every damaged line with what it should hold.

    Repeated rows count once; null contents and pages of documents that are not
    scanned give none.
    """
    a = analysed(blocks, sections, documents)
    edge = a["gone"].select(F.col("id").alias("block_id"), "line_no", F.explode(F.array_compact(F.array(F.when(F.col("header"), F.lit("running_header")), F.when(F.col("number"), F.lit("page_number"))))).alias("kind"), F.lit("").alias("word"))
    sure = a["events"].filter("kind in ('broken_word', 'misread')")
    looked = a["events"].filter("kind in ('token', 'lookup')").join(a["fixes"], "word").select("block_id", "line_no", F.when(F.col("kind") == "token", "misread").otherwise("broken_word").alias("kind"), F.col("right").alias("word"))
    return edge.unionByName(sure.select("block_id", "line_no", "kind", "word")).unionByName(looked).distinct()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of each page: edge lines gone, words corrected and put together, lines joined."""
    for batch in batches:
        rows = []
        for doc, bid, page, text, gone, fixes, broken, taken in zip(*[batch.column(c).to_pylist() for c in ("document_id", "id", "page", "content", "gone", "fixes", "broken", "taken")]):
            right = {f["word"]: f["right"] for f in fixes or ()}
            whole = {b["line_no"]: b["word"] for b in broken or ()}
            gone, paragraphs, fresh, drop = set(gone or ()), [], True, bool(taken)
            for i, line in enumerate(text.split("\n")):
                if i in gone:
                    continue
                words = line.split()
                if not words:
                    fresh = True
                    continue
                if (fresh or line[:2].isspace()) and not drop:
                    paragraphs.append([])
                fresh = False
                if drop:
                    # the word stands in the line before; what follows it there comes with it
                    rest = words[0][len(words[0].rstrip(PUNCTUATION)) :]
                    words, drop = words[1:], False
                    if not paragraphs:
                        paragraphs.append([])
                    elif rest and paragraphs[-1]:
                        paragraphs[-1][-1] += rest
                elif paragraphs[-1] and len(paragraphs[-1][-1]) > 1 and paragraphs[-1][-1][-1] in HYPHEN and paragraphs[-1][-1][-2].isalpha() and words[0][0].islower():
                    # a broken word that no count speaks for, such as a name
                    words[0] = paragraphs[-1].pop()[:-1] + words[0]
                out = []
                for k, token in enumerate(words):
                    if i in whole and k == len(words) - 1:
                        w = whole[i]
                        out.append(w[:1].upper() + w[1:] if token[:1].isupper() else w)
                        drop = True
                        continue
                    w = bare(token)
                    new = right.get(w) or fix_number(token.strip(PUNCTUATION))
                    if new:
                        a = token.lower().find(w)
                        out.append(token[:a] + (new[:1].upper() + new[1:] if w[:1] != token[a : a + 1] else new) + token[a + len(w) :])
                    else:
                        out.append(token)
                paragraphs[-1] += out
            texts = [" ".join(x) for x in paragraphs if x]
            rows += [(doc, bid, page, n, t, not t.endswith((".", "!", "?", "。", ":", ")", "”", "»"))) for n, t in enumerate(texts)]
        cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["document_id", "id", "page", "n", "text", "open"])


def paragraphs(blocks: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, para_no, first_page, text): the repaired paragraphs of the scanned documents, whole over page ends.

    A page's first paragraph goes on with the one before unless that ended as a
    sentence does. Pages without a number come last, in the order of their ids.
    """
    a = analysed(blocks, sections, documents)
    looked = a["events"].filter("kind in ('token', 'lookup')").join(a["fixes"], "word")
    # what a page's own lines need: bounded by the page
    fixes = looked.filter("kind = 'token'").groupBy(F.col("block_id").alias("id")).agg(F.collect_set(F.struct("word", "right")).alias("fixes"))
    whole = a["events"].filter("kind = 'broken_word'").select("block_id", "line_no", "word").unionByName(looked.filter("kind = 'lookup'").select("block_id", "line_no", F.col("right").alias("word")))
    broken = whole.groupBy(F.col("block_id").alias("id")).agg(F.collect_set(F.struct("line_no", "word")).alias("broken"))
    sure = whole.select("block_id", "line_no").distinct()
    taken = a["over"].join(sure, ["block_id", "line_no"], "left_semi").select(F.col("next_block").alias("id"), F.lit(True).alias("taken")).distinct()
    flags = a["gone"].groupBy("id").agg(F.collect_list("line_no").alias("gone"))
    work = a["pages"].join(flags, "id", "left").join(fixes, "id", "left").join(broken, "id", "left").join(taken, "id", "left")
    parts = materialize(work.select("document_id", "id", "page", "content", "gone", "fixes", "broken", "taken").mapInArrow(_repair, "document_id string, id bigint, page int, n int, text string, open boolean"))
    # the order of a document's parts without their texts, over ranges of its pages
    light = ranges(parts.select("document_id", "page", "id", "n", "open"), "document_id", "page", nulls_first=False)
    order = (F.asc_nulls_last("page"), "id", "n")
    w, over = Window.partitionBy("document_id", "_range").orderBy(*order), Window.partitionBy("document_id").orderBy("_range")
    ends = light.groupBy("document_id", "_range").agg(F.max_by("open", F.struct(F.coalesce("page", F.lit((1 << 31) - 1)), "id", "n")).alias("end"))
    ends = ends.withColumn("end", F.lag("end").over(over))  # a row a range
    light = light.join(ends, ["document_id", "_range"], "left").withColumn("goes_on", (F.col("n") == 0) & F.coalesce(F.lag("open").over(w), "end", F.lit(False)))
    fresh = F.when(F.col("goes_on"), 0).otherwise(1)
    sums = light.groupBy("document_id", "_range").agg(F.sum(fresh).alias("s"))
    before = sums.withColumn("before", F.sum("s").over(over) - F.col("s")).drop("s")
    numbered = light.withColumn("run", F.sum(fresh).over(w)).join(before, ["document_id", "_range"], "left").select("document_id", "id", "n", (F.col("run") + F.col("before") - 1).alias("para_no"))
    texts = parts.join(numbered, ["document_id", "id", "n"])
    items = F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit((1 << 31) - 1)).alias("p"), "id", "n", "text")))
    return texts.groupBy("document_id", "para_no").agg(F.min("page").alias("first_page"), F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text"))


def tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    blocks = spark.read.parquet(f"{sf_dir}/parser_blocks.parquet")
    sections = spark.read.parquet(f"{sf_dir}/parser_sections.parquet").select("document_id", "title")
    titles = spark.read.parquet(f"{sf_dir}/doc_index.parquet").select("document_id", "title")
    return blocks, sections, titles


def p2_found(spark, sf_dir: str) -> DataFrame:
    return damaged_lines(*tables(spark, sf_dir))


def p2_paragraphs(spark, sf_dir: str) -> DataFrame:
    return paragraphs(*tables(spark, sf_dir))
