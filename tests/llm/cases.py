"""Rows for the tests of all operators."""

LONG = " ".join(f"w{i % 97} x{i % 89}, Y{i % 83}." for i in range(20_000))
MIT = "Released under the MIT License."
BASE = "the quick brown fox jumps over the lazy dog and runs far away from all the noisy hens of our small farm today"
#: Nulls, empty and blank texts, repeated rows, repeated ids, ties, near copies, a very long text.
EDGE = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.upper()), (4, BASE + " again"), (5, "other " + BASE[4:]), (None, BASE), (None, None),
    (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "One  two"), (11, "two one"), (12, LONG), (13, LONG + " end"),
    (14, MIT + " " + BASE), (14, "an id for the second time, with a text of its own"), (15, "Été Straße ǅ İ   日本 \U0001F600 é"),
    (16, "<|endoftext|> it's <s> I'LL 12 \x00 \x1c"), (17, "GNU General Public License, version 3 cc-by MIT license mit license"),
]
#: Extra columns with names that the operators use themselves.
EXTRA = ["h", "n", "node", "bucket", "cell", "row", "id", "sha", "digest", "label", "score", "ids", "part", "words", "hits", "copy", "block"]


def make_docs(spark, rows):
    cols = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    full = [(i, t, None if k % 3 == 0 else "en", "s", None, *([None] * len(EXTRA))) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, cols)
