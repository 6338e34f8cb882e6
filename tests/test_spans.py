"""Titles from spans of first pages."""

from quillspark.operators.spans import first_page_titles

SCHEMA = "pdf_id long, size double, text string, x double, y double, page_h double"


def title(spark, rows):
    got = first_page_titles(spark.createDataFrame([(1, *map(float, r[:1]), r[1], float(r[2]), float(r[3]), 800.0) for r in rows], SCHEMA)).collect()
    return got[0].title if got else None


def test_the_largest_size_that_makes_a_title(spark):
    rows = [(24, "Untitled", 0, 10), (18, "A long title of", 0, 50), (18.3, "the membrane", 5, 60), (18, "the membrane", 5, 62), (10, "body text that is much longer than a title", 0, 100), (18, "below the fold", 0, 700)]
    assert title(spark, rows) == "A long title of the membrane"


def test_flat_pages_go_by_blocks(spark):
    rows = [
        (10, "Department of Physics, University of Nowhere in the very long world of things", 0, 10), (10, "A title on", 0, 50), (10, "one line", 30, 52), (10, "and a second one", 0, 62), (10, "Jane Miller, a short block", 0, 120),
    ]
    assert title(spark, rows) == "A title on one line and a second one"


def test_a_line_is_compared_with_where_it_began(spark):
    # each span is 4 lower than the one before: the third is 8 below the first and begins a new line, not a new block
    rows = [(10, "first words of", 0, 100), (10, "a title", 1, 104), (10, "in steps", 2, 108)]
    assert title(spark, rows) == "first words of a title in steps"


def test_none(spark):
    assert title(spark, [(10, "x", 0, 1), (10, "short", 0, 1)]) is None
    assert first_page_titles(spark.createDataFrame([], SCHEMA)).count() == 0
