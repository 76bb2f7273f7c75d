"""Grids of several tiers: the text itself, and reading it back."""

from orderly.sources import writers

TIERS = [("words", "interval"), ("marks", "point"), ("empty", "interval"), ("none", "point")]


def made(spark, rows, spans):
    df = spark.createDataFrame(rows, "rec string, tier string, xmin double, xmax double, label string")
    return writers.tiered_grids(df, spark.createDataFrame(spans, "rec string, `from` double, `to` double"), "rec", TIERS)


def test_text_and_reading_back(spark):
    rows = [("a", "words", 1.0, 1.5, 'say "hi" [2]:'), ("a", "words", 1.5, 2.0, "two\nlines"), ("a", "marks", 0.5, 0.5, "y"), ("a", "marks", 0.5, 0.5, "x"), ("a", "marks", 3.0, 3.0, None), ("a", "other", 0.0, 1.0, "left out")]
    texts = {r.rec: r.text for r in made(spark, rows, [("a", 0.0, 3.0), ("b", 0.0, 1.0)]).collect()}
    assert texts["a"].split("\n")[:14] == [
        'File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0.000000000", "xmax = 3.000000000", "tiers? <exists>", "size = 4", "item []:",
        "    item [1]:", '        class = "IntervalTier"', '        name = "words"', "        xmin = 0.000000000", "        xmax = 3.000000000", "        intervals: size = 4",
    ]
    assert '            text = "say ""hi"" [2]:"' in texts["a"] and '            mark = "x; y"' in texts["a"]
    assert writers.grid_entries(texts["a"]) == [
        (1, "words", "interval", 0.0, 1.0, ""), (1, "words", "interval", 1.0, 1.5, 'say "hi" [2]:'), (1, "words", "interval", 1.5, 2.0, "two lines"), (1, "words", "interval", 2.0, 3.0, ""),
        (2, "marks", "point", 0.5, 0.5, "x; y"), (2, "marks", "point", 3.0, 3.0, ""), (3, "empty", "interval", 0.0, 3.0, ""),
    ]
    assert writers.grid_entries(texts["b"]) == [(1, "words", "interval", 0.0, 1.0, ""), (3, "empty", "interval", 0.0, 1.0, "")]


def test_the_short_form_is_read_too(spark):
    text = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n2.5\n<exists>\n2\n"IntervalTier"\n"w"\n0\n2.5\n1\n0\n2.5\n"TextTier"\n"TextTier"\n"p"\n0\n2.5\n1\n1.25\n"-3.5"'
    assert writers.grid_entries(text) == [(1, "w", "interval", 0.0, 2.5, "TextTier"), (2, "p", "point", 1.25, 1.25, "-3.5")]
    assert writers.grid_entries(None) == [] and writers.grid_entries("") == []


def test_no_grids(spark):
    assert made(spark, [], []).collect() == []
