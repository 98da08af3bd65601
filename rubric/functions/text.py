"""Text column functions (T1-T8): pure Catalyst expressions, no Python UDF.

The rules were stated for Python's ``re``/``str``; the Java patterns below
reproduce them:

* Python's ``str.strip``/``split`` and ``\\s`` also treat U+001C..U+001F as
  space; Java's ``(?U)\\s`` does not, so the class adds them.
* Spark's ``trim`` only removes U+0020, hence ``strip`` trims an explicit set.
* Python's ``\\w`` is "letter, number or underscore" - ``\\p{L}\\p{N}_``.
* ``regexp_extract`` returns '' both for "no match" and for an empty match,
  so presence tests use ``rlike``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WS = r"\s\x1c-\x1f"
# Characters for which Python's str.isspace() is true (Unicode 15): the
# set str.strip() removes.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
SPLIT_RE = rf"(?U)[{WS}]+"
CLEAN_RE = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]+"

# tolerant extraction (T1): case-insensitive with Unicode case folding, dot
# matches newline, Unicode \s; the answer may run to the end of the text when
# its closing tag is missing.
THINK_RE = "(?siuU)" + fixed.THINK_PATTERN
ANSWER_RE = "(?siu)" + fixed.ANSWER_PATTERN
# strict extraction (T2): case-sensitive, both tags must close.
STRICT_THINK_RE = "(?s)" + fixed.STRICT_THINK_PATTERN
STRICT_ANSWER_RE = "(?s)" + fixed.STRICT_ANSWER_PATTERN
# any tag name, opening or closing
TAG_NAME_RE = r"</?([A-Za-z_][A-Za-z0-9_:-]*)[^<>]*>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: ``btrim`` with Python's whitespace set (no
    regex; Spark's plain ``trim`` removes only U+0020)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def clean_text(c) -> Column:
    """Lower case, then drop every char that is not word char or space."""
    return F.regexp_replace(F.lower(_col(c)), F.lit(CLEAN_RE), F.lit(""))


def tokens(c) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens."""
    return F.array_remove(F.split(_col(c), SPLIT_RE), "")


def n_words(c) -> Column:
    """Whitespace token count of the uncleaned text."""
    return F.size(tokens(c))


def extract_think(c) -> Column:
    """T1 think part: first closed think block, stripped, '' when absent."""
    return strip(F.regexp_extract(_col(c), THINK_RE, 1))


def extract_answer(c) -> Column:
    """T1 answer part: first answer block up to its closer or end of text."""
    return strip(F.regexp_extract(_col(c), ANSWER_RE, 1))


def extract_strict_cot(c) -> Column:
    """T2 CoT: strict think block; whole stripped text if neither tag pair."""
    c = _col(c)
    return (F.when(c.rlike(STRICT_THINK_RE), strip(F.regexp_extract(c, STRICT_THINK_RE, 1)))
            .when(c.rlike(STRICT_ANSWER_RE), F.lit(""))
            .otherwise(strip(c)))


def extract_strict_answer(c) -> Column:
    """T2 answer: strict answer block, '' when absent."""
    c = _col(c)
    return F.when(c.rlike(STRICT_ANSWER_RE),
                  strip(F.regexp_extract(c, STRICT_ANSWER_RE, 1))).otherwise(F.lit(""))


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


Groups = Mapping[str, Sequence[str]]


def _group_arrays(groups: Groups) -> list[tuple[str, Column]]:
    # one SQL array literal per group: a single call instead of one per word
    return [(name, F.expr("array(" + ", ".join(_sql_str(w) for w in words) + ")"))
            for name, words in groups.items()]


def synonym_group_name(clean_gold, groups: Groups = fixed.SYNONYM_GROUPS) -> Column:
    """T4: name of the synonym group holding the cleaned gold, else NULL.
    ``groups``: names and their (cleaned) words, tried in their order."""
    g = _col(clean_gold)
    expr = F.lit(None).cast("string") if not groups else None
    for name, arr in _group_arrays(groups):
        cond = F.array_contains(arr, g)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def synonym_group_words(clean_gold, groups: Groups = fixed.SYNONYM_GROUPS) -> Column:
    """T4: the word list of the cleaned gold's group (array) or NULL."""
    g = _col(clean_gold)
    expr = F.lit(None).cast("array<string>") if not groups else None
    for _, arr in _group_arrays(groups):
        cond = F.array_contains(arr, g)
        expr = F.when(cond, arr) if expr is None else expr.when(cond, arr)
    return expr


def match_prepared(pred_clean, pred_tokens, gold_clean, gold_group) -> Column:
    """T5 on already cleaned/tokenised inputs (lets a job compute each once).

    (a) equal after cleaning; (b) gold in a synonym group: true iff a word of
    the group is a whole word of the prediction, and false otherwise without
    trying (c); (c) gold equals one whitespace token of the prediction.
    """
    pc, pt, gc, gg = map(_col, (pred_clean, pred_tokens, gold_clean, gold_group))
    return (F.when(pc == gc, F.lit(True))
            .when(gg.isNotNull(), F.arrays_overlap(pt, gg))
            .otherwise(F.array_contains(pt, gc)))


def is_match(pred, gold, groups: Groups = fixed.SYNONYM_GROUPS) -> Column:
    """T5: does the prediction match the gold answer?"""
    pc = clean_text(pred)
    gc = clean_text(gold)
    return match_prepared(pc, tokens(pc), gc, synonym_group_words(gc, groups))


def tag_names(c) -> Column:
    """All tag names (lower case, distinct) used in the text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(c), F.lit(TAG_NAME_RE), 1),
                                        lambda t: F.lower(t)))


def has_tool_call(c) -> Column:
    """The completion holds a tool-call tag."""
    return _col(c).contains(fixed.TOOL_CALL_TAG)


def foreign_tags(c) -> Column:
    """Tag names other than the allowed ones, as a sorted array."""
    allowed = F.array(*[F.lit(t) for t in fixed.ALLOWED_TAGS])
    return F.array_sort(F.array_except(tag_names(c), allowed))


def violates_tag_policy(c) -> Column:
    """Tool call, or any tag other than think/answer."""
    return has_tool_call(c) | (F.size(foreign_tags(c)) > 0)
