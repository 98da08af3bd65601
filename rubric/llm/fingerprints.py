"""I-Match fingerprints with several randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band: neither
so common that they say nothing nor so rare that an edit loses them.  A
text's terms in one lexicon, distinct and sorted, are hashed to one value.
A fingerprint has such a value for each of many random subsets of the lexicon:
``LEXICAL`` draws, and of each the subsets that keep 1/4, 1/8 and so on, one
inside the other (``LEVELS``).  Two versions of a text agree in a subset if the
edit touched none of its terms, so the share of subsets that agree is a
likeness; small subsets suit long texts and large ones short texts.

The lexicon is a bit set over ``LEXICON`` hash classes of terms, counted over
all distinct texts, so its size doesn't grow with the vocabulary.  Terms that
share a class are in or out together.  With the same lexicon a text has the
same fingerprint in every table.

Fallback: some texts have hardly a term in the lexicon (short ones, those of a
large group of near copies, whose terms are too common, and all texts of a
table of less than 20).  So ``WHOLE`` more draws take subsets of all terms, and
two texts are compared by these where either has too few lexicon terms
(``SPARSE``).  A text without any term counts as a single term, itself.

Built-in functions only.  The fingerprint is written as SQL text: its many
nested functions would take seconds to build one call at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import ASCII_LOWER, ASCII_UPPER, project

#: Fixed value: what lies between terms (A-Z are lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hash classes of terms.
LEXICON = 1 << 18
#: Document frequencies of the lexicon's terms, as shares of the documents.
BAND = (0.0005, 0.05)
#: Subsets of a draw: level k keeps one in 2^(k + 2) terms.
LEVELS = 15
#: Levels that are filtered out of the one before in this list; those between are filtered out of these.
STEPS = (0, 3, 7)
#: Draws from the lexicon, draws from all terms, and both.
LEXICAL = 6
WHOLE = 2
DRAWS = LEXICAL + WHOLE
#: Texts with less than one lexicon term in so many terms have no values for the lexicon.
SPARSE = 8
#: Values are numbers below this, 0 for a subset without terms.
VALUES = 1 << 20
#: Random bits of a term in a draw, and draws that one 64-bit number serves.
BITS = LEVELS + 1
PER_NUMBER = 64 // BITS


def terms_sql(text: str) -> str:
    """The distinct terms of a text (SQL) as sorted 64-bit hashes."""
    found = f"filter(split(translate({text}, '{ASCII_UPPER}', '{ASCII_LOWER}'), r'{BETWEEN}'), w -> w != '')"
    return f"array_sort(array_distinct(transform({found}, w -> xxhash64(w))))"


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND, size: int = LEXICON, text_col: str = "text") -> list[int]:
    """The bit set, as size / 64 signed 64-bit numbers.

    A class is in if its document frequency (a distinct text counts once for
    each term it has there) is in the band, and at least 1.  Copies move as
    their classes, one for each task at most.
    """
    texts = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))
    classes = texts.select(F.xxhash64("text").alias("text_hash"), F.expr(
        f"transform({terms_sql('text')}, t -> cast(pmod(t, {size}) as int))").alias("classes")).dropDuplicates(["text_hash"])
    # Class -1 counts the texts.
    counts = classes.select(F.explode(F.concat(F.array(F.lit(-1)), "classes")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy(F.floor(F.col("class") / 64).cast("int").alias("at")).agg(
        F.collect_list(F.struct(F.pmod("class", F.lit(64)).alias("bit"), "n")).alias("counts")).collect()
    n_docs = next((r["counts"][0]["n"] for r in found if r["at"] < 0), 0)
    out = [0] * (size // 64)
    for r in found:
        if r["at"] >= 0:
            word = sum(1 << c["bit"] for c in r["counts"] if band[0] * n_docs <= c["n"] <= band[1] * n_docs)
            out[r["at"]] = word - (word >> 63 << 64)
    return out


def long_array(values: list[int]) -> Column:
    """The numbers as one array literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def let(name: str, value: str, use: str) -> str:
    """``bind`` in SQL."""
    return f"transform(array({value}), {name} -> {use})[0]"


def value_sql(some: str) -> str:
    """Of terms with their random numbers, bound to a name."""
    return f"if(size({some}) > 0, pmod(hash({some}.t), {VALUES - 1}) + 1, 0)"


def draw_sql(pairs: str, draw: int, whole: bool) -> str:
    """The values of a draw's subsets: each level is filtered out of one of
    the few levels of ``STEPS``, so all terms are looked at once."""
    number, shift, mask = f"r{draw // PER_NUMBER}", BITS * (draw % PER_NUMBER), (1 << BITS) - 1

    def random(p: str) -> str:
        return f"(shiftrightunsigned({p}.{number}, {shift}) & {mask})"

    def keep(level: int) -> int:
        return 1 << (LEVELS - 1 - level)

    def none(level: int) -> str:
        zeros = f"array_repeat(0, {LEVELS - level})"
        if not whole or level:
            return zeros
        least = f"array_min(transform({pairs}, p -> struct({random('p')} as r, p.t as t)))"
        return f"concat(array({let('one', f'array({least})', value_sql('one'))}), array_repeat(0, {LEVELS - 1}))"

    def step(of: str, level: int) -> str:
        upto = min((x for x in STEPS if x > level), default=LEVELS)
        name = f"c{level}"
        parts = [f"array({value_sql(name)})"]
        if upto > level + 1:
            limits = ", ".join(str(keep(k)) for k in range(level + 1, upto))
            inner = let("some", f"filter({name}, p -> {random('p')} < most)", value_sql("some"))
            parts.append(f"transform(array({limits}), most -> {inner})")
        if upto < LEVELS:
            parts.append(step(name, upto))
        return let(name, f"filter({of}, p -> {random('p')} < {keep(level)})",
                   f"if(size({name}) > 0, concat({', '.join(parts)}), {none(level)})")

    return step(pairs, 0)


def fingerprint(text: str, in_band: list[int], size: int = LEXICON) -> Column:
    """The values of the texts of a column, one for each subset, 0 for a
    subset that has none of its terms.  ``in_band``: ``lexicon``.  First come
    the draws from the lexicon, zeros if it has less than one in ``SPARSE`` of
    the text's terms; then those from all terms, whose first subsets have one
    term at least, that with the smallest number.  An empty text has zeros."""
    bits = f"cast(split('{','.join(map(str, in_band))}', ',') as array<bigint>)"

    def drawn(of: str, draws: int) -> str:
        numbers = ", ".join(f"xxhash64(t, {i}) as r{i}" for i in range(-(-draws // PER_NUMBER)))
        return f"transform({of}, t -> struct(t as t, {numbers}))"

    def part(of: str, draws: int, whole: bool, has: str) -> str:
        values = let("pairs", drawn(of, draws), f"concat({', '.join(draw_sql('pairs', d, whole) for d in range(draws))})")
        return f"if({has}, {values}, array_repeat(0, {draws * LEVELS}))"

    kept = f"filter(own, t -> getbit(get({bits}, cast(pmod(t, {size}) div 64 as int)), cast(pmod(t, 64) as int)) = 1)"
    lexical = let("known", kept, part("known", LEXICAL, False, f"size(known) > 0 and size(known) * {SPARSE} >= size(own)"))
    both = f"concat({lexical}, {part('own', WHOLE, True, 'size(own) > 0')})"
    own = let("found", terms_sql(f"`{text}`"), f"if(size(found) = 0 and `{text}` != '', array(xxhash64(`{text}`)), found)")
    return F.expr(let("own", own, both))


def likeness(a: Column, b: Column) -> Column:
    """Equal fingerprints: 1.  Else the share of agreeing subsets among those
    that have terms of either text: subsets of the lexicon, or where either
    text has no values for these, of all terms."""

    def share(both: Column) -> Column:
        any_term = F.filter(both, lambda p: (p["a"] != 0) | (p["b"] != 0))
        return F.size(F.filter(any_term, lambda p: p["a"] == p["b"])) / F.size(any_term)

    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    n = (F.size(a) * LEXICAL / DRAWS).cast("int")
    lexical = F.slice(both, F.lit(1), n)
    has = F.exists(lexical, lambda p: p["a"] != 0) & F.exists(lexical, lambda p: p["b"] != 0)
    return F.when(a == b, F.lit(1.0)).otherwise(
        bind(F.when(has, lexical).otherwise(F.slice(both, n + 1, F.size(a) - n)), share))


def as_string(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lower(F.right(F.concat(F.lit("0000"), F.hex(v)), F.lit(5)))), "")


def fingerprints(docs: DataFrame, in_band: list[int] | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text and ``values`` (see
    ``fingerprint``).  A null text counts as empty.  Without a lexicon it is
    that of ``docs``; fingerprints of several tables are comparable if made
    with the same one.  No shuffle but the lexicon's counts."""
    in_band = lexicon(docs, text_col=text_col) if in_band is None else in_band
    return project(docs, id_col, text_col).select("doc_id", "text", fingerprint("text", in_band).alias("values"))


def block_ends(rows: DataFrame, n: int) -> list[int]:
    """At most ``n`` ids that split the rows evenly; the largest is the last."""
    found = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n + 1)], 20 * n).alias("p"),
                        F.max("doc_id").alias("most")).first()
    return sorted({*(found["p"] or []), *([] if found["most"] is None else [found["most"]])})


def with_next(rows: DataFrame, columns: list[str], n_blocks: int | None = None) -> DataFrame:
    """``rows`` with ``next_<column>``: the values of the row with the next
    smaller doc_id, for the last row those of the first.

    Rows of one id follow each other in order of the hash of their text; null
    ids come last.  Ids are split into blocks (four for each shuffle
    partition), and the rows of a block's largest id are also sent to the
    block before it, where they only serve as followers; so rows move once
    and no task sees more than its blocks.
    """
    spark = rows.sparkSession
    n_blocks = n_blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = block_ends(rows, n_blocks)
    if not ends:  # no rows, or null ids only: one block
        ends = [0]
    width = max(1, int(len(ends) ** 0.5))
    groups = [ends[i:i + width] for i in range(0, len(ends), width)]
    nested = F.array(*[long_array(g) for g in groups])
    last = long_array([g[-1] for g in groups])
    # The block of an id is the number of block ends below it: first among groups of ends, then inside one.
    group = F.size(F.filter(last, lambda e: e < F.col("doc_id")))
    block = group * width + F.coalesce(F.size(F.filter(F.get(nested, group), lambda e: e < F.col("doc_id"))), F.lit(0))
    block = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(block).cast("int")
    # Descending ids: block 0 is the last one, and the block with the largest id follows it.
    is_end = F.array_contains(F.get(nested, group), F.col("doc_id"))
    before = F.pmod(F.col("block") + 1, F.lit(len(ends)))
    placed = rows.select("*", block.alias("block"), F.coalesce(is_end, F.lit(False)).alias("is_end")).select(
        "*", F.explode(F.when(F.col("is_end"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("copy"))
    placed = placed.withColumn("block", F.when(F.col("copy"), before).otherwise(F.col("block")))
    order = [F.col("copy").asc(), F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    w = Window.partitionBy("block").orderBy(*order)
    first = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.select("doc_id", *columns, "copy",
                        *[F.coalesce(F.lead(c).over(w), F.first(c).over(first)).alias(f"next_{c}") for c in columns])
    return out.where(~F.col("copy")).drop("copy")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_band: list[int] | None = None) -> DataFrame:
    """How the fingerprints hold when half of a text is replaced by the start
    of the next document's: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    One row per input row, in the order of ``with_next``; a null text counts as
    empty, repeated rows are documents of their own, an empty table gives no
    rows.  ``in_band``: a stored lexicon, by default that of ``docs``.
    """
    in_band = lexicon(docs, text_col=text_col) if in_band is None else in_band
    pairs = with_next(fingerprints(docs, in_band, id_col, text_col), ["text", "values"])
    changed = pairs.select("doc_id", "values", "next_values", F.length("text").cast("long").alias("n_chars"),
                           edited(F.col("text"), F.col("next_text")).alias("edited"))
    valued = changed.select("*", fingerprint("edited", in_band).alias("edited_values"))
    return valued.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                         as_string(F.col("values")).alias("fingerprint"),
                         as_string(F.col("edited_values")).alias("edited_fingerprint"),
                         likeness(F.col("values"), F.col("edited_values")).alias("near_edited"),
                         likeness(F.col("values"), F.col("next_values")).alias("near_next"))
