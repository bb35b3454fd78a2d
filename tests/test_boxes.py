"""Tables read from word boxes: layouts that text alone cannot tell."""

from quillon.operators import boxes

WORDS = "paper long, page int, top double, x0 double, x1 double, text string"


def page(spark, lines, paper=1, number=1):
    """lines: (top, [(x0, text), ...]); a character is 5 wide."""
    return spark.createDataFrame([(paper, number, float(top), float(x), float(x + 5 * len(t)), t) for top, words in lines for x, t in words], WORDS)


def cells(frame):
    return {r.cell: r.value for r in boxes.harvest(frame).collect()}


def test_names_of_two_words_and_names_over_two_columns(spark):
    got = cells(page(spark, [
        (10, [(0, "Table"), (30, "3:"), (50, "Losses")]),
        (20, [(110, "k"), (117, "="), (124, "1"), (230, "k"), (237, "="), (244, "2")]),
        (30, [(90, "MSE"), (140, "MCS"), (157, "p-value"), (210, "MSE"), (260, "MCS"), (277, "p-value")]),
        (40, [(0, "Linear"), (32, "model"), (85, "1.25"), (150, "0.31"), (205, "1.50"), (270, "0.99")]),
        (50, [(0, "CSR"), (85, "1.20"), (150, "1.00*"), (205, "1.10"), (270, "(0.5)")]),
        (60, [(0, "Notes:"), (40, "none"), (85, "9.99")]),
    ]))
    assert got == {
        "T3/Linear model/k = 1/MSE": 1.25, "T3/Linear model/k = 1/MCS p-value": 0.31, "T3/Linear model/k = 2/MSE": 1.5, "T3/Linear model/k = 2/MCS p-value": 0.99,
        "T3/CSR/k = 1/MSE": 1.2, "T3/CSR/k = 1/MCS p-value": 1.0, "T3/CSR/k = 2/MSE": 1.1, "T3/CSR/k = 2/MCS p-value": 0.5,
    }


def test_sections_end_with_their_indent_and_short_rows_keep_their_columns(spark):
    got = cells(page(spark, [
        (10, [(0, "Table"), (30, "1.")]),
        (20, [(100, "aa"), (150, "bb"), (200, "cc")]),
        (30, [(0, "Hold"), (98, "1.1"), (148, "1.2"), (198, "1.3")]),
        (40, [(0, "Momentum")]),
        (50, [(12, "short"), (98, "2.1"), (198, "2.3")]),
        (60, [(12, "long"), (148, "3.2")]),
        (70, [(0, "Linear"), (98, "4.1"), (148, "4.2"), (198, "-4.3")]),
    ]))
    assert got == {"T1/Hold/aa": 1.1, "T1/Hold/bb": 1.2, "T1/Hold/cc": 1.3, "T1/Momentum/short/aa": 2.1, "T1/Momentum/short/cc": 2.3, "T1/Momentum/long/bb": 3.2, "T1/Linear/aa": 4.1, "T1/Linear/bb": 4.2, "T1/Linear/cc": -4.3}


def test_a_triangle_is_read_by_place(spark):
    got = cells(page(spark, [(10, [(0, "Table"), (30, "2.")]), (20, [(100, "x1"), (150, "x2"), (200, "x3")]), (30, [(0, "x1"), (98, "1.00"), (148, "0.10"), (198, "0.20")]), (40, [(0, "x2"), (148, "1.00"), (198, "0.30")]), (50, [(0, "x3"), (198, "1.00")])]))
    assert got == {"T2/x1/x1": 1.0, "T2/x1/x2": 0.1, "T2/x1/x3": 0.2, "T2/x2/x2": 1.0, "T2/x2/x3": 0.3, "T2/x3/x3": 1.0}


def test_panels_share_the_header_above_them(spark):
    got = cells(page(spark, [
        (10, [(0, "Table"), (30, "7.")]), (20, [(60, "of"), (100, "TW"), (150, "AV"), (200, "SD")]),
        (30, [(0, "Panel"), (30, "A:")]), (40, [(0, "one"), (98, "1.1"), (148, "1.2"), (198, "1.3")]),
        (50, [(0, "Panel"), (30, "B:")]), (60, [(0, "one"), (98, "2.1"), (148, "2.2"), (198, "2.3")]),
    ]))
    assert got == {f"T7/Panel {p}/one/{c}": v + k / 10 for p, v in (("A", 1), ("B", 2)) for k, c in ((1, "TW"), (2, "AV"), (3, "SD"))}


def test_wide_numbers_overlap_in_their_column_only(spark):
    got = cells(page(spark, [(10, [(0, "Table"), (30, "4.")]), (30, [(0, "a"), (100, "1.1"), (160, "2.2")]), (40, [(0, "b"), (85, "11111.1"), (150, "22222.2")])]))
    assert got == {"T4/a/c1": 1.1, "T4/a/c2": 2.2, "T4/b/c1": 11111.1, "T4/b/c2": 22222.2}


def test_nothing_and_odd_words(spark):
    empty = page(spark, [(10, [(0, "Table"), (30, "1.")])]).limit(0)
    assert boxes.harvest(empty).count() == 0
    odd = spark.createDataFrame([(1, 1, 10.0, 0.0, 20.0, "Table"), (1, 1, 10.0, 30.0, 35.0, "1."), (1, 1, 20.0, 0.0, 5.0, None), (1, 1, 20.0, 0.0, 5.0, " "), (1, 1, 30.0, 0.0, 20.0, "only"), (1, 1, 30.0, 90.0, 110.0, "5.5")], WORDS)
    assert cells(odd) == {"T1/only/c1": 5.5}
    twice = page(spark, [(10, [(0, "Table"), (30, "1.")]), (20, [(0, "a"), (90, "1.5")])], number=1).unionByName(page(spark, [(10, [(0, "Table"), (30, "1.")]), (20, [(0, "a"), (90, "1.5")]), (30, [(0, "b"), (90, "2.5")])], number=2))
    assert {(r.cell, r.page) for r in boxes.harvest(twice).collect()} == {("T1/a/c1", 2), ("T1/b/c1", 2)}  # the fuller copy


def plan_of(spark, name):
    from quillon.plans import registry, shared

    made = len(shared._folders)
    plan = registry.load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("Scan parquet"), len(shared._folders) - made


def test_pages_are_dealt_once_and_read_where_they_are(spark):
    assert plan_of(spark, "boxed_cells") == (1, 1, 0)


def test_text_pages_are_read_once(spark):
    assert plan_of(spark, "exhibit_cells") == (1, 1, 0)


def test_a_page_of_boxes_is_one_row_until_its_cells_are(spark):
    from quillon.plans import registry

    plan = registry.load()[0]["boxed_cells"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 4  # of an order's lines when pages are made, and of copies of an exhibit
    # a box of two numbers is no cell
    assert cells(page(spark, [(10, [(0, "Table"), (30, "1.")]), (20, [(90, "1.5 2.5")]), (30.04, [(0, "a"), (90, "3.5")]), (30.01, [(140, "4.5")])])) == {"T1/a/c1": 3.5, "T1/a/c2": 4.5}


def test_a_page_of_text_is_one_row_until_its_cells_are(spark):
    from quillon.operators import exhibits
    from quillon.plans import registry

    plan = registry.load()[0]["exhibit_cells"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2  # of copies of an exhibit
    text = "Table 1. A\nk = 1 k = 2\nPanel A: x\na 1.5 2.5\nPanel B\nb 3.5 4.5*\nlater\n\nc (5.5) 6%\nragged 1.5\nPanel A: x\nd 7.5 8.5\nNotes: z\ne 1.5 2.5\nFigure 1. f\ng 1.5\nTable 2\nh 12 9.5"
    found = exhibits.harvest(spark.createDataFrame([("p", 1, text), ("p", 2, "Table 2\nno numbers"), ("q", 1, None)], "paper string, page int, text string"))
    assert sorted((c.cell, c.value, c.stars, c.parenthesised) for c in found.collect()) == [
        ("T1/Panel A/a/k = 1", 1.5, 0, False), ("T1/Panel A/a/k = 2", 2.5, 0, False), ("T1/Panel A/d/k = 1", 7.5, 0, False), ("T1/Panel A/d/k = 2", 8.5, 0, False),
        ("T1/Panel B/b/k = 1", 3.5, 0, False), ("T1/Panel B/b/k = 2", 4.5, 1, False), ("T1/Panel B/later/c/k = 1", 5.5, 0, True), ("T1/Panel B/later/c/k = 2", 6.0, 0, False), ("T2/h 12/c1", 9.5, 0, False),
    ]
