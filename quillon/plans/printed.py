"""Queries over printed tables: pages made of the rows of orders, as text and as word boxes of varying layout, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import boxes as B
from quillon.operators import exhibits as X
from quillon.plans.registry import query
from quillon.plans.shared import spread
from quillon.sources import views as V

ROWS = ("quantity", "price", "total")
#: lines of orders in a task: pages are made and read where the one shuffle puts them
LINES = 250_000


def cells(spark, folder) -> DataFrame:
    """(paper, j, n, line, q, p, t, late): the lines of each order, as columns of its table."""
    w = Window.partitionBy("paper")
    # named before they are dealt: what is read from a page then stays where its paper is
    li = spread(V.table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "paper"), LINES, "paper")
    j = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return li.select("paper", j.alias("j"), F.count(F.lit(1)).over(w).alias("n"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), (F.col("l_tax") * 100).alias("t"), (F.col("l_returnflag") == "R").alias("late"), (F.col("l_discount") > 0.05).alias("star"))


_CELLS = "t AS (SELECT l_orderkey AS paper, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS j, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linenumber AS line, l_quantity AS q, l_extendedprice AS p, l_tax * 100 AS t, l_returnflag = 'R' AS late, l_discount > 0.05 AS star FROM lineitem)"


def printed(x: Column | str) -> Column:
    return F.format_string("%.2f", F.col(x) if isinstance(x, str) else x)


def boxed(spark, folder) -> DataFrame:
    """(paper, page, words): word boxes of a page for each order.

    Columns are 60 to 80 wide and numbers are set about their middle or to the right; names are two words, and every other page has a line above them
    with names over two columns; two rows are indented below a section, one of them only has numbers in some columns.
    """
    t = cells(spark, folder)
    spacing, left = 60 + 10 * (F.col("paper") % 3), 100 + F.col("paper") % 7
    # numbers are printed once, as their width places them
    texts = {"quantity": printed("q"), "price": F.concat(printed("p"), F.when(F.col("star"), "*").otherwise("")), "tax": F.concat(printed("t"), F.lit("%")), "returned": F.when(F.col("late"), F.concat(F.lit("("), printed(F.col("line") + 0.25), F.lit(")"))), "total": printed(F.col("q") * 2)}
    t = t.withColumns(texts).withColumn("c", (left + F.col("j") * spacing).cast("double")).withColumn("spacing", spacing)
    word = lambda top, x0, x1, text: F.struct(F.lit(top).cast("double").alias("top"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), text.alias("text"))
    c, wide = F.col("c"), F.col("paper") % 3 == 1

    def number(top, name):
        text, size = F.col(name), F.length(name) * 5
        return word(top, F.when(wide, c + 14 - size).otherwise(c - size / 2), F.when(wide, c + 14).otherwise(c + size / 2), text)

    pair = F.col("j") - F.col("j") % 2
    middle = c + F.when(pair + 1 < F.col("n"), F.col("spacing") / 2).otherwise(F.lit(0.0))
    over = [F.when((F.col("paper") % 2 == 0) & (F.col("j") % 2 == 0), word(20, middle + a, middle + b, x)) for a, b, x in ((-8, -4, F.lit("k")), (-2, 2, F.lit("=")), (4, 8, (pair / 2 + 1).cast("int").cast("string")))]
    names = [word(30, c - 14, c - 2, F.concat(F.lit("m"), "line")), word(30, c + 1, c + 14, F.lit("cost"))]
    data = [number(40, "quantity"), number(50, "price"), number(70, "tax"), F.when(F.col("late"), number(80, "returned")), number(90, "total")]
    once = F.col("j") == 0
    caption = [word(10, F.lit(10 + 30 * k), F.lit(35 + 30 * k), x) for k, x in enumerate((F.lit("Table"), F.concat((F.col("paper") % 9 + 1).cast("string"), F.lit(".")), F.lit("Charges"), F.lit("by"), F.lit("line")))]
    labels = [word(top, F.lit(x), F.lit(x + 40), F.lit(text)) for top, x, text in ((40, 10, "quantity"), (50, 10, "price"), (60, 10, "Charges"), (70, 20, "tax"), (80, 20, "returned"), (90, 10, "total"), (100, 10, "Notes:"), (100, 60, "none"))]
    every = F.array(*over, *names, *data, *[F.when(once, w) for w in (*caption, *labels)])
    return t.select("paper", every.alias("w")).groupBy("paper").agg(F.flatten(F.collect_list("w")).alias("words")).select("paper", F.lit(1).alias("page"), "words")


_HEAD = "'T' || (paper % 9 + 1) || '/'"
_COL = "CASE WHEN paper % 2 = 0 AND (n > 2 OR n = 1) THEN 'k = ' || (j // 2 + 1) || '/' ELSE '' END || 'm' || line || ' cost'"


@query(
    f"WITH {_CELLS} SELECT paper, {_HEAD} || a || {_COL} AS cell, v AS value, percent, stars, parens AS parenthesised FROM ("
    + " UNION ALL ".join(
        f"SELECT paper, j, n, line, '{a}' AS a, printf('%.2f', {v})::DOUBLE AS v, {pc} AS percent, {st} AS stars, {pa} AS parens FROM t{w}"
        for a, v, pc, st, pa, w in [("quantity/", "q::DOUBLE", "false", "0", "false", ""), ("price/", "p::DOUBLE", "false", "star::INTEGER", "false", ""), ("Charges/tax/", "t::DOUBLE", "true", "0", "false", ""), ("Charges/returned/", "line + 0.25::DOUBLE", "false", "0", "true", " WHERE late"), ("total/", "q::DOUBLE * 2", "false", "0", "false", "")]
    )
    + ")"
)
def boxed_cells(spark, folder):
    """Cells of pages of word boxes, addressed by place."""
    return B.harvest_pages(boxed(spark, folder)).select("paper", "cell", "value", "percent", "stars", "parenthesised")


def texts(spark, folder) -> DataFrame:
    """(paper, page, text): the same tables as text, without what only places can tell."""
    li = spread(V.table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "paper"), LINES, "paper")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("q"), (F.col("l_discount") > 0.05).alias("star"))
    t = li.groupBy("paper").agg(F.array_sort(F.collect_list(row)).alias("r"))
    fields = {
        "name": lambda x: F.concat(F.lit("m"), x["l_linenumber"]), "quantity": lambda x: printed(x["q"]),
        "price": lambda x: F.concat(printed(x["l_extendedprice"]), F.when(x["star"], "*").otherwise("")), "total": lambda x: F.concat(F.lit("("), printed(x["q"] * 2), F.lit(")")),
    }
    line = lambda label, field: F.concat(F.lit(label), F.array_join(F.transform("r", fields[field]), " "))
    body = [F.concat(F.lit("some text before\nTable "), F.col("paper") % 9 + 1, F.lit(". Charges by line")), line("", "name"), *[line(f"{x} ", x) for x in ROWS], F.lit("Notes: none\nquantity 1.00")]
    return t.select("paper", F.lit(1).alias("page"), F.concat_ws("\n", *body).alias("text"))


@query(
    f"WITH {_CELLS} SELECT paper, {_HEAD} || a || CASE WHEN n > 1 THEN 'm' || line ELSE 'c1' END AS cell, v AS value, false AS percent, stars, parens AS parenthesised FROM ("
    + " UNION ALL ".join(f"SELECT paper, n, line, '{a}/' AS a, printf('%.2f', {v})::DOUBLE AS v, {st} AS stars, {pa} AS parens FROM t" for a, v, st, pa in [("quantity", "q::DOUBLE", "0", "false"), ("price", "p::DOUBLE", "star::INTEGER", "false"), ("total", "q::DOUBLE * 2", "0", "true")])
    + ")"
)
def exhibit_cells(spark, folder):
    """Cells of tables in page text."""
    return X.harvest(texts(spark, folder)).select("paper", "cell", "value", "percent", "stars", "parenthesised")
