"""Printed tables from word boxes: geometry and text in one pass.

Pages come as words with their places (paper, page, top, x0, x1, text).  Words of one height are a line, so text and geometry are never matched
against each other; captions, panels, blocks and rows are found in the lines as in ``exhibits``.  Then places decide what text cannot:

* columns: the spans of a block's numbers, swept from left to right; a column begins where a number starts right of all spans before;
* names: header words with small gaps between them are one name, and each column takes, from each header line, the name over its
  middle, else the nearest one on either side;
* sections: a line without numbers heads the rows that are indented more than it is.

A page is one row of arrays until its cells are: its words, then its lines, then a row for each block.  A row with fewer numbers than there are columns keeps
them under their columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import scoring
from quillon.operators.exhibits import EXHIBIT, blocks_in, has, panels_in, richest

#: fixed value: widest gap within a name
GAP = 4.0
#: how far a middle may lie outside a name that is still over it, and how much more an indented line is indented
SLACK = 1.0


def pages_of(words: DataFrame) -> DataFrame:
    """(paper, page, words): a page's word boxes (top, x0, x1, text) as an array."""
    return words.groupBy("paper", "page").agg(F.collect_list(F.struct("top", "x0", "x1", "text")).alias("words"))


def lines_of(pages: DataFrame) -> DataFrame:
    """(paper, page, panelled, lines, boxes): texts of the lines from the top of each page, and their words from left to right."""
    each = pages.select("paper", "page", F.filter("words", lambda b: b.isNotNull() & (F.trim(b["text"]) != "")).alias("words"))
    # whole numbers need not be rounded
    rounded = F.transform("words", lambda b: F.struct(F.round(b["top"], 1).alias("top"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["text"].alias("text")))
    whole = ~F.exists("words", lambda b: F.rint(b["top"]) != b["top"])
    each = each.withColumn("words", F.sort_array(F.when(F.coalesce(whole, F.lit(False)), F.col("words")).otherwise(rounded)))
    first = F.transform("words", lambda b, k: F.when((k == 0) | ~b["top"].eqNullSafe(F.get("words", k - 1)["top"]), k))
    each = each.withColumn("begin", F.filter(first, lambda k: k.isNotNull()))
    end = lambda k: F.coalesce(F.get("begin", k + 1), F.size("words"))
    # in a lambda, ``slice`` would copy the whole array
    each = each.withColumn("boxes", F.transform("begin", lambda b, k: F.transform(F.sequence(b, end(k) - 1), lambda j: F.get("words", j))))
    each = each.withColumn("lines", F.transform("boxes", lambda line: F.array_join(line["text"], " ")))
    return each.select("paper", "page", F.exists("lines", lambda t: has("Panel", t)).alias("panelled"), "lines", "boxes")


def blocks_of(panels: DataFrame) -> DataFrame:
    """One row for each block with data: ``numbers`` (k, x0, x1, token) in the ``rows`` and ``sections`` k, and ``heads``.

    heads are the words of the lines above the block's data; lines above the panels serve all of them.  A section begins at a line without numbers and ends at
    one with numbers that is not indented more.
    """
    size, text, boxes = lambda i: F.get("sizes", i), lambda i: F.get("texts", i), lambda i: F.get("boxes", i)
    each = blocks_in(panels).filter("top is not null")
    above = lambda lines: F.filter(lines, lambda i: (size(i) < 0) & (i < F.col("top")))
    heads = F.when(F.col("panel") == "", above("at")).otherwise(F.concat(above("shared"), above("at")))
    named = F.filter("at", lambda i: (i > F.col("top")) & (size(i) < 0) & (size(i) >= -6) & text(i).rlike("[A-Za-z]{2}"))
    each = each.withColumns({"heads": F.transform(heads, boxes), "named": named, "data": F.filter("at", lambda i: size(i) > 0)})
    edge = lambda i: F.get(boxes(i), F.lit(0))["x0"]
    ended = lambda h, i: F.exists("data", lambda d: (d > h) & (d <= i) & F.coalesce(edge(d) <= edge(h) + SLACK, F.lit(False)))
    under = lambda h, i: F.when(h.isNull() | ended(h, i), F.lit("")).otherwise(F.trim(text(h)))
    section = lambda i: once(F.try_element_at(F.filter("named", lambda h: h < i), F.lit(-1)), lambda h: under(h, i))
    # the label's words come first; the numbers are the last boxes of their line
    number = lambda b, k: F.struct(k.alias("k"), b["x0"].alias("x0"), b["x1"].alias("x1"), scoring.clean(b["text"]).alias("token"))
    place = lambda i, k: F.transform(F.sequence(F.size(boxes(i)) - size(i), F.size(boxes(i)) - 1), lambda j: once(F.get(boxes(i), j), lambda b: number(b, k)))
    numbers = F.filter(F.flatten(F.transform("data", place)), lambda x: scoring.is_cell(x["token"]))
    rows = F.transform("data", lambda i: scoring.label_of(text(i), F.get("rests", i)))
    return each.select(*EXHIBIT, "kind", "label", "title", "panel", "heads", numbers.alias("numbers"), rows.alias("rows"), F.when(F.size("named") > 0, F.transform("data", section)).alias("sections"))


def spans_of(numbers: Column) -> Column:
    """Columns (x0, x1) of a block, by a sweep over the spans of its numbers: one begins where a number starts right of all before."""
    sweep = F.sort_array(F.transform(numbers, lambda b: F.struct(b["x0"].cast("double").alias("x0"), b["x1"].cast("double").alias("x1"))))

    def step(found: Column, b: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        wider = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(F.struct(last["x0"].alias("x0"), b["x1"].alias("x1"))))
        return F.when((F.size(found) == 0) | (b["x0"] > last["x1"]), F.concat(found, F.array(b))).when(b["x1"] > last["x1"], wider).otherwise(found)

    return F.aggregate(sweep, F.array().cast("array<struct<x0:double,x1:double>>"), step)


def names_of(boxes: Column, gap: float = GAP) -> Column:
    """Names (x, x0, x1, name) on a header line, by their middles: words with small gaps between them are one name."""
    words = F.transform(boxes, lambda b: F.struct(b["x0"].cast("double").alias("x0"), b["x1"].cast("double").alias("x1"), b["x1"].cast("double").alias("end"), b["text"].alias("name")))

    def step(found: Column, b: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        longer = F.struct(F.least(last["x0"], b["x0"]).alias("x0"), F.greatest(last["x1"], b["x1"]).alias("x1"), b["x1"].alias("end"), F.concat(last["name"], F.lit(" "), b["name"]).alias("name"))
        return F.when((F.size(found) == 0) | (b["x0"] - last["end"] > gap), F.concat(found, F.array(b))).otherwise(F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(longer)))

    groups = F.aggregate(words, F.array().cast("array<struct<x0:double,x1:double,end:double,name:string>>"), step)
    return F.sort_array(F.transform(groups, lambda g: F.struct(((g["x0"] + g["x1"]) / 2).alias("x"), g["x0"].alias("x0"), g["x1"].alias("x1"), g["name"].alias("name"))))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often it is named."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def picked(names: Column, x: Column) -> Column:
    """The name over a middle, else the nearest one."""
    over = lambda g: F.coalesce((g["x0"] - SLACK <= x) & (x <= g["x1"] + SLACK), F.lit(False))
    nearer = lambda a, b: F.when(over(a), a["name"]).when(over(b), b["name"]).when(b.isNull() | (x - a["x"] <= b["x"] - x), a["name"]).otherwise(b["name"])
    around = F.struct(F.try_element_at(F.filter(names, lambda g: g["x"] <= x), F.lit(-1)).alias("a"), F.get(F.filter(names, lambda g: g["x"] > x), F.lit(0)).alias("b"))
    return once(around, lambda g: nearer(g["a"], g["b"]))


def with_columns(blocks: DataFrame) -> DataFrame:
    """Blocks with ``cols``: each column's names from all header lines, top line first, equal ones once; ``numbers`` are (k, j, token) in column j.

    A header line of one name says nothing about several columns and is passed over.
    """
    found = blocks.withColumn("spans", spans_of(F.col("numbers"))).withColumn("heads", F.transform("heads", lambda h: names_of(h)))
    found = found.withColumn("heads", F.filter("heads", lambda h: (F.size(h) > 1) | ((F.size("spans") == 1) & (F.size(h) == 1))))
    name = lambda s: once((s["x0"] + s["x1"]) / 2, lambda x: F.array_join(F.array_distinct(F.transform("heads", lambda h: picked(h, x))), "/"))
    cols = F.transform("spans", lambda s, j: F.when(F.size("heads") > 0, name(s)).otherwise(F.concat(F.lit("c"), j + 1)))
    # columns begin at their first number, from left to right
    placed = F.transform("numbers", lambda b: F.struct(b["k"].alias("k"), (F.size(F.filter("spans", lambda s: s["x0"] <= b["x0"])) - 1).alias("j"), b["token"].alias("token")))
    return found.withColumn("cols", cols).withColumn("numbers", placed).drop("heads", "spans")


def harvest(words: DataFrame) -> DataFrame:
    """(paper, CELLS of ``exhibits``) of word boxes."""
    return harvest_pages(pages_of(words))


def harvest_pages(pages: DataFrame) -> DataFrame:
    """``harvest`` of ``pages_of`` word boxes."""
    panels = panels_in(lines_of(pages), "boxes", shared=lambda size, text: size < 0)
    blocks = with_columns(richest(blocks_of(panels)))
    some = lambda c: F.nullif(c, F.lit(""))
    above = F.concat_ws("/", F.concat(F.substring("kind", 1, 1), "label"), some("panel"))
    # an inner one would have numbers made once more, to count them first
    each = blocks.select("paper", "exhibit", F.lower("kind").alias("kind"), "title", F.col("page").cast("int").alias("page"), "panel", above.alias("above"), "rows", "sections", "cols", F.inline_outer("numbers")).filter("k is not null")
    each = each.withColumns({"row": F.get("rows", "k"), "section": F.coalesce(F.get("sections", "k"), F.lit("")), "col": F.get("cols", "j")})
    cell = F.concat_ws("/", "above", some("section"), some("row"), "col")
    return each.select("paper", cell.alias("cell"), "exhibit", "kind", "title", "page", "panel", "section", "row", "col", scoring.cell_parts(F.col("token")).alias("c")).select("paper", "cell", "exhibit", "kind", "title", "page", "panel", "section", "row", "col", "c.value", "c.raw", "c.percent", "c.stars", "c.parenthesised")
