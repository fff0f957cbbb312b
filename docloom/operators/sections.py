"""Splitting texts into sections, trees of titles, chunks and packs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import normalize_title, token_estimate

# What looks like a section heading, opens a bibliography, and ends one.
HEADING = r"(?i)^(\d+\.(?:\d+\.)*\s+\S|\d+\)\s+\S|[IVXLC]+\.\s+\S|제\s*\d+\s*[장절항편]|Chapter\s+\d|(?:Abstract|초록|요약|서론|결론|서문|부록|Appendix)$|(?:Acknowledgments?|감사의\s*글?)$|(?:References?|참고\s*문헌|Bibliography)$|(?:Introduction|Conclusions?|Methods?|Results?|Discussion|Background)$|(?:Related\s+Work|Experiments?|Evaluation|Future\s+Work)$)"
BIBLIOGRAPHY = r"(?i)(?:References?|참고\s*문헌|Bibliography)"
RESET = r"(?i)^(?:Abstract|초록|요약|서론|결론|서문|부록|Appendix|Acknowledgments?|감사의\s*글?|Introduction|Conclusions?|Methods?|Results?|Discussion|Background|Related\s+Work|Experiments?|Evaluation|Future\s+Work|제\s*\d+\s*[장절항편]|Chapter\s+\d)$"
PREAMBLE = "서두"


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line)"""
    return df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def by_group(rows: DataFrame, key: list[str], order: list[str], value: str, sep: str = "\n") -> DataFrame:
    """Values of a group in order, joined."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(items, lambda s: s["_v"]), sep).alias(value))


def heading_sections(df: DataFrame, key: str) -> DataFrame:
    """(key, section_no, title, content): Markdown headings start sections; those without a body vanish."""
    l = lines(df, key)
    title = F.regexp_extract("line", r"^#{1,6}\s+(.+)", 1)
    w = Window.partitionBy(key).orderBy("pos")
    l = l.withColumn("title", F.trim(title)).withColumn("section_no", F.sum(F.when(title != "", 1).otherwise(0)).over(w))
    heads = l.filter("title <> ''").select(key, "section_no", "title")
    body = by_group(l.filter("title = ''"), [key, "section_no"], ["pos"], "line").withColumn("content", F.regexp_replace("line", r"^\s+|\s+$", "")).filter("content <> ''")
    return body.join(heads, [key, "section_no"], "left").select(key, "section_no", F.coalesce("title", F.lit(PREAMBLE)).alias("title"), "content")


HOT_ROWS, MAX_HOT = 2000, 1000


def ranges(df: DataFrame, part: str, lead: str, nulls_first: bool = True) -> DataFrame:
    """Adds ``_range``: the parts of more than ``HOT_ROWS`` rows, the ``MAX_HOT`` largest at most, are cut into ranges of ``lead``; 0 in all others.

    A part that is not among them holds less than a thousandth of all rows, so no
    task gets more than a small share. Nulls of ``lead`` come first, or last.
    """
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.min(lead).alias("_lo"), F.max(lead).alias("_hi"))
    hot = sizes.filter((F.col("_n") > HOT_ROWS) & F.col(part).isNotNull()).orderBy(F.desc("_n")).limit(MAX_HOT).collect()
    if not hot:
        return df.withColumn("_range", F.lit(0).cast("bigint"))
    few = F.broadcast(df.sparkSession.createDataFrame(hot, sizes.schema))  # MAX_HOT rows at most
    at = F.floor((F.col(lead) - F.col("_lo")) * F.ceil(F.col("_n") / HOT_ROWS) / (F.col("_hi") - F.col("_lo") + 1))
    return df.join(few, part, "left").withColumn("_range", F.when(F.col("_n").isNull(), 0).when(F.col(lead).isNull(), -1 if nulls_first else 1 << 40).otherwise(at).cast("bigint")).drop("_n", "_lo", "_hi")


def running_sum(df: DataFrame, part: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row of its part. ``order`` tells rows apart and begins with a number.

    Two levels: inside a range of a hot part, and over the sums of the ranges
    before it, so that no part is one sorted group however many rows it has.
    """
    d = ranges(df.withColumn("_v", value.cast("bigint")), part, order[0])
    by = d.groupBy(part, "_range").agg(F.sum("_v").alias("_s"))
    # a row a range
    before = by.withColumn("_before", F.sum("_s").over(Window.partitionBy(part).orderBy("_range")) - F.col("_s")).drop("_s")
    run = d.withColumn(name, F.sum("_v").over(Window.partitionBy(part, "_range").orderBy(*order)))
    return run.join(before, [part, "_range"], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_v", "_range", "_before")


def islands(df: DataFrame, part: list[str], order: list[str], breaks: Column, split: bool = False) -> DataFrame:
    """Adds ``island``: the number of rows up to this one where ``breaks`` holds. With ``split`` hot parts go over ranges of the first, numeric order column."""
    one = F.when(breaks, 1).otherwise(0)
    if split:
        return running_sum(df, part[0], order, one, "island")
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("island", F.sum(one).over(w).cast("bigint"))


def bibliography_mode(l: DataFrame, key: str) -> DataFrame:
    """Adds ``demoted``: heading lines behind a references heading, until a heading that resets it."""
    heading = F.trim("line").rlike(HEADING)
    kind = F.when(heading & F.trim("line").rlike(RESET) & ~F.trim("line").rlike(BIBLIOGRAPHY), "reset").when(heading & F.trim("line").rlike(BIBLIOGRAPHY), "biblio")
    w = Window.partitionBy(key).orderBy("pos")
    state = F.last(kind, ignorenulls=True).over(w)
    return l.withColumn("heading", heading).withColumn("kind", kind).withColumn("demoted", heading & (F.coalesce(state, F.lit("")) == "biblio") & F.coalesce(kind != "biblio", F.lit(True)))


def tree_parents(nodes: DataFrame, part: str) -> DataFrame:
    """Adds ``parent_pos``: the nearest earlier entry of a smaller level (levels 1 to 3)."""
    w = Window.partitionBy(part).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda level: F.max(F.when(F.col("level") <= level, F.col("ord"))).over(w)
    return nodes.withColumn("parent_pos", F.when(F.col("level") == 1, F.lit(None)).when(F.col("level") == 2, last(1)).otherwise(last(2)))


def greedy_packs(limit: int, sizes: Column, ok: Column | None = None) -> Column:
    """Pack number of each item of an ordered array: a pack that holds an ``ok`` item (without ``ok`` any that is not empty) closes when the next item would exceed the limit."""
    items = F.transform(sizes, lambda n: F.struct(n.alias("n"), (n > 0).alias("ok"))) if ok is None else F.zip_with(sizes, ok, lambda n, o: F.struct(n.alias("n"), o.alias("ok")))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("ok"), F.lit(0).cast("bigint").alias("no"), F.array().cast("array<bigint>").alias("packs"))

    def step(s: Column, e: Column) -> Column:
        full = s["ok"] & (s["used"] + e["n"] > limit)
        no = F.when(full, s["no"] + 1).otherwise(s["no"])
        return F.struct(F.when(full, e["n"]).otherwise(s["used"] + e["n"]).alias("used"), F.when(full, e["ok"]).otherwise(s["ok"] | e["ok"]).alias("ok"), no.alias("no"), F.concat(s["packs"], F.array(no)).alias("packs"))

    return F.aggregate(items, start, step, lambda s: s["packs"])


def paragraphs(text: Column, shortest: int = 10) -> Column:
    """Pieces between blank lines of at least ``shortest`` characters that are no table and no comment."""
    pieces = F.transform(F.split(text, r"\n\s*\n"), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: (F.char_length(s) >= shortest) & ~s.startswith("|") & ~s.startswith("<!--"))


def contents_entries(df: DataFrame, key: str, text: str = "text", most: int = 120) -> DataFrame:
    """(key, pos, depth, major, title) of the contents table below a contents heading of Markdown texts; texts without one give no row.

    At most ``most`` lines below the heading are read, up to the next heading that
    does not itself name the contents. A square marks a major entry, a number an
    entry below the major one above it; leader dots and page numbers fall away.
    """
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda l: l.rlike(r"^#+\s*목\s*차")), True)
    l = df.filter(F.col(text).isNotNull()).select(key, lines.alias("l"), at.alias("at")).filter("at > 0").select(key, F.posexplode(F.slice("l", F.col("at").cast("int") + 1, most)).alias("pos", "line"))
    l = l.withColumn("line", F.trim("line"))
    w = Window.partitionBy(key).orderBy("pos")  # at most 120 lines
    l = l.withColumn("over", F.max(F.when(F.col("line").rlike(r"^#+\s+") & ~F.col("line").contains("목"), 1).otherwise(0)).over(w)).filter("over = 0")
    row = r"^\|\s*(.+?)\s*\|\s*(.+?)\s*\|"
    l = l.withColumn("a", F.trim(F.regexp_extract("line", row, 1))).withColumn("b", F.trim(F.regexp_extract("line", row, 2))).filter("a <> '' and not a rlike '^[-| ]*$'")
    top = F.when(F.col("a") == "□", F.trim(F.regexp_replace("b", r"[·…\s]+$", "")))
    l = l.withColumn("top", F.when(F.char_length(top) > 2, top)).withColumn("major", F.last("top", ignorenulls=True).over(w))
    number = F.regexp_extract("a", r"^(\d+)\.?\s*$", 1)
    below = F.when((number != "") & F.col("major").isNotNull(), F.concat(number, F.lit(". "), F.trim(F.regexp_replace("b", r"[·…]+.*$", ""))))
    return l.withColumn("title", F.coalesce("top", below)).filter("title is not null").select(key, "pos", F.when(F.col("top").isNotNull(), 1).otherwise(2).alias("depth"), "major", "title")


def monotone_match(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """(document_id, ord, pos): toc entries found in headings, each behind the one before.

    Groups are single documents; an entry is looked for only after the last one was found.
    """

    def match(key, toc: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        toc, heads, out, i = toc.sort_values(["ord", "core"]), heads.sort_values(["pos", "title"]), [], 0
        cores = [(o, c[:15]) for o, c in zip(toc["ord"], toc["core"])]
        for pos, title in zip(heads["pos"], heads["title"]):
            if i < len(cores) and len(cores[i][1]) >= 3 and cores[i][1] in title:
                out.append((key[0], cores[i][0], pos))
                i += 1
        return pd.DataFrame(out, columns=["document_id", "ord", "pos"])

    return entries.groupBy("document_id").cogroup(headings.groupBy("document_id")).applyInPandas(match, "document_id string, ord int, pos int")
