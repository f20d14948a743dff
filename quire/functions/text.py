"""Text out of Markdown, HTML and PageXML, and text into tables."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def tidy(text: Column) -> Column:
    """Double spaces, spaces before closing signs and after an opening bracket go."""
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.regexp_replace(text, r" ([,.;:)])", "$1")
    return F.regexp_replace(text, r"([(]) ", "$1")


def lines_of(text: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    trimmed = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def markdown_text(text: Column) -> Column:
    """Plain text of Markdown with tables: marks of headings, lists, quotes, emphasis, links, code and table rules go. Null gives ''."""
    t = F.coalesce(text, F.lit(""))
    for pattern, by in (
        (r"(?m)^[ \t]*```.*$", ""), (r"!\[([^\]]*)\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*:?-*:?[ \t]*$", ""),
        (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""), (r"(?m)[ \t]+#+[ \t]*$", ""), (r"(?m)^[ \t]*>[ \t]?", ""), (r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", ""), (r"(?m)^[ \t]*(?:[-*_][ \t]*){3,}$", ""),
        (r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2"), (r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?!\w)", "$1"), (r"`([^`]*)`", "$1"), (r"(?m)^[ \t]*\||\|[ \t]*$", ""), (r"[ \t]*\|[ \t]*", "\n"),
    ):
        t = F.regexp_replace(t, pattern, by)
    return lines_of(t)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """The visible text of HTML, a line for each block; scripts, styles and comments don't show. Null gives ''."""
    return pages.map(lambda x: "" if x is None else _visible(x, False))


@F.pandas_udf(StringType())
def html_markdown(pages: pd.Series) -> pd.Series:
    """Markdown of an HTML report: headings, lists, emphasis, links, tables; embedded images are left out. Null gives ''."""
    return pages.map(lambda x: "" if x is None else _visible(x, True))


_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "blockquote", "pre", "figure", "title"}
_HIDDEN = {"script", "style", "template", "noscript"}


class _Reader(HTMLParser):
    """Made once: a class for each page would stay, with the page's text, until cycles are collected."""

    hidden, link = 0, ""

    def __init__(self, marks: bool):
        super().__init__(convert_charrefs=True)
        self.marks, self.out = marks, []

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCKS:
            self.out.append("\n")
        if self.marks and not self.hidden:
            if tag[0] == "h" and tag[1:].isdigit():
                self.out.append("#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("- ")
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "code":
                self.out.append("`")
            elif tag in ("td", "th"):
                self.out.append("| ")
            elif tag == "a":
                self.link = dict(attrs).get("href") or ""
                self.out.append("[")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if self.marks and not self.hidden:
            self.out.append({"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "td": " ", "th": " "}.get(tag, ""))
            if tag == "tr":
                self.out.append("|")
            if tag == "a":
                self.out.append(f"]({self.link})")
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(" ".join(data.split("\n")))


def _visible(page: str, marks: bool) -> str:
    reader = _Reader(marks)
    reader.feed(page)
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.out).split("\n"))
    return "\n".join(line for line in lines if line)


def small_batches(spark, rows: int = 500) -> None:
    """Fewer rows in an Arrow batch than the default 10,000, so that a worker holds a few whole pages and their texts at a time; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@F.pandas_udf(StringType())
def pagexml_text(documents: pd.Series) -> pd.Series:
    """Of each TextLine the first TextEquiv's Unicode text that isn't empty, trimmed, a line each. Null, empty or broken XML gives ''."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rpartition("}")[2]

    def one(xml):
        if not xml:
            return ""
        try:
            root = ET.fromstring(xml)
        except ET.ParseError:
            return ""
        lines = []
        for line in (e for e in root.iter() if local(e) == "TextLine"):
            texts = (u.text for q in line if local(q) == "TextEquiv" for u in q if local(u) == "Unicode" and u.text)
            lines.append(next(texts, "").strip())
        return "\n".join(x for x in lines if x)

    return documents.map(one)


#: Sources of a page's text, by name.
EXTRACTORS = {"plain": lambda c: F.coalesce(c, F.lit("")), "markdown": markdown_text, "html": html_text, "pagexml": pagexml_text}


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """One row, one column (table): the rows in this order as a Markdown table. For report tables, whose rows are few."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "|".join(["---"] * len(df.columns)) + "|"
    rows = df.select(F.struct(*order, cells.alias("_line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("r", lambda x: x["_line"]), "\n")).alias("table"))
