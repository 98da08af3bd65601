"""License scans with a positional rare-token index.

The index holds templates (license notices and phrases) as words.  Each
template is posted under its rarest words only: those with the highest
inverse document frequency, counted over all documents.  A file is scanned
for posted words; each hit votes for (template, place of the file's word
minus place of the template's word), so words that stand at the same
distances as in the template vote for one start.  Starts with enough votes
are verified: the template's mandatory key phrases must stand there word for
word.

Built-in functions only.  One narrow pass per scan, and one small aggregate
for the frequencies (as many groups as templates have words).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import lower_ascii, project

#: Fixed value: a word is a run of none of these characters (A-Z are lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A template is posted under this share of its words, ``MOST_ANCHORS`` at most.
ANCHOR_SHARE = 0.4
MOST_ANCHORS = 8
#: The share of a template's anchors that must agree on a start.
VOTES = 0.6


@dataclass(frozen=True)
class Template:
    """``text``: words as they stand in files; ``must``: the key phrases
    among them (the whole text if none is given); ``kind``: phrase or notice."""

    name: str
    label: str
    text: str
    must: tuple[str, ...] = ()
    kind: str = "notice"


def phrase(label: str, text: str) -> Template:
    return Template(f"phrase {text}", label, text, (), "phrase")


#: Sentences of public licenses and their SPDX names.
NOTICES = (
    Template("Apache 2.0 notice", "apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("GPL 2 notice", "gpl-2.0", "gnu general public license version 2", ("general public license", "version 2")),
    Template("GPL 3 notice", "gpl-3.0", "gnu general public license version 3", ("general public license", "version 3")),
    *[Template(f"GPL {n} header{', either' * bool(either)}", f"gpl-{n}.0",
               "under the terms of the gnu general public license as published by the free software foundation "
               f"{either}version {n} of the license",
               (f"gnu general public license as published by the free software foundation {either}version {n} of the license",))
      for n in (2, 3) for either in ("either ", "")],
    Template("LGPL notice", "lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("AGPL notice", "agpl", "gnu affero general public license", ("affero general public license",)),
    Template("MPL 2.0 notice", "mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    Template("CC BY-NC notice", "cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("CC BY-SA notice", "cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("CC BY-ND notice", "cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("CC0 notice", "cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    Template("MIT text", "mit-text",
             "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("BSD text", "bsd",
             "redistribution and use in source and binary forms with or without modification are permitted provided "
             "that the following conditions are met", ("source and binary forms", "conditions are met")),
    Template("ISC text", "isc",
             "permission to use copy modify and or distribute this software for any purpose with or without fee is "
             "hereby granted", ("for any purpose with or without fee",)),
    Template("Unlicense text", "unlicense",
             "this is free and unencumbered software released into the public domain",
             ("unencumbered software released into the public domain",)),
    Template("Rights reserved", "proprietary", "all rights reserved", ("all rights reserved",)),
)


def words(text: Column) -> Column:
    """Cut at what lies between words: an eighth of the time of ``regexp_extract_all``, which makes a match's objects for
    each word.  A text that begins or ends between words has an empty part there, one without words is an empty part."""
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def document_frequencies(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[str, int]:
    """Documents that hold each of the templates' words.  The result has one
    entry for each such word, so its size doesn't depend on the documents."""
    wanted = sorted({w for t in templates for w in t.text.split()})
    text = F.coalesce(docs[text_col], F.lit(""))
    found = docs.select(F.explode(F.array_intersect(words(text), F.array(*map(F.lit, wanted)))).alias("w"))
    return {w: 0 for w in wanted} | {r.w: r.n for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def anchors(template: Template, frequency: dict[str, int]) -> list[int]:
    """Places of the template's rarest words.  A phrase has one."""
    of = template.text.split()
    n = 1 if template.kind == "phrase" else max(1, min(MOST_ANCHORS, math.ceil(ANCHOR_SHARE * len(of))))
    return sorted(sorted(range(len(of)), key=lambda i: (frequency[of[i]], -len(of[i]), i))[:n])


def places(template: Template) -> list[tuple[int, list[str]]]:
    """(place in the template, words) of each key phrase."""
    of, out = template.text.split(), []
    for p in template.must or (template.text,):
        p = p.split()
        out.append((next(i for i in range(len(of)) if of[i:i + len(p)] == p), p))
    return out


def scan(docs: DataFrame, templates: list[Template], frequency: dict[str, int] | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words and ``matches``, an array of
    (template, label, kind, start, n_words, share) in order of template and
    start: where the template starts in the file's words, and the share of
    its anchors that voted for it.

    A null text counts as empty; files without words have no matches.
    """
    frequency = frequency or document_frequencies(docs, templates, text_col)
    postings: dict[str, list[tuple[int, int]]] = {}
    needed = []
    for k, t in enumerate(templates):
        of = anchors(t, frequency)
        needed.append((len(of), max(1, math.ceil(VOTES * len(of)))))
        for i in of:
            postings.setdefault(t.text.split()[i], []).append((k, i))
    posted = F.map_from_arrays(
        F.array(*map(F.lit, postings)),
        F.array(*[F.array(*[F.lit((k << 40) + (1 << 32) - i) for k, i in p]) for p in postings.values()]))
    sizes = F.array(*[F.lit(n) for n, _ in needed])
    quorum = F.array(*[F.lit(n) for _, n in needed])
    must = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, p)).alias("words"))
                               for at, p in places(t)]) for t in templates])
    info = F.array(*[F.struct(F.lit(t.name).alias("template"), F.lit(t.label).alias("label"), F.lit(t.kind).alias("kind"),
                              F.lit(len(t.text.split())).alias("n_words")) for t in templates])

    rows = project(docs, id_col, text_col).select("doc_id", words(F.col("text")).alias("words"))
    # Words of the index with their places; few files have any.
    hit = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*postings), F.struct(w.alias("w"), i.alias("i")))),
                   lambda x: x.isNotNull())
    rows = rows.select("*", hit.alias("hits"))
    # A vote is template and start in one number: postings that agree are equal, and sorting brings them together.
    votes = F.array_sort(F.flatten(F.transform("hits", lambda h: F.transform(posted[h["w"]], lambda p: p + h["i"]))))
    rows = rows.select("doc_id", "words", votes.alias("votes"))

    def run(x: Column, i: Column) -> Column:
        """At the last of equal votes: their number; else null."""
        t = F.shiftright(x, 40).cast("int")
        last = (i + 1 >= F.size("votes")) | (F.get("votes", i + 1) != x)
        same = F.filter(F.sequence(F.lit(0), F.get(sizes, t) - 1),
                        lambda back: (back <= i) & (F.get(F.col("votes"), i - back) == x))
        return F.when(last, F.struct(t.alias("t"), (x - F.shiftleft(t.cast("long"), 40) - (1 << 32)).alias("start"),
                                     F.size(same).alias("n")))

    starts = F.filter(F.transform("votes", run), lambda s: s.isNotNull())
    verified = F.filter(starts, lambda s: (s["n"] >= F.get(quorum, s["t"])) & F.forall(
        F.get(must, s["t"]),
        lambda m: (s["start"] + m["at"] >= 0) & (F.slice(F.col("words"), (F.greatest(s["start"] + m["at"], F.lit(0)) + 1).cast("int"),
                                                         F.size(m["words"])) == m["words"])))
    matches = F.transform(verified, lambda s: F.struct(
        F.get(info, s["t"])["template"].alias("template"), F.get(info, s["t"])["label"].alias("label"),
        F.get(info, s["t"])["kind"].alias("kind"), s["start"].alias("start"), F.get(info, s["t"])["n_words"].alias("n_words"),
        (s["n"] / F.get(sizes, s["t"])).alias("share")))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), matches.alias("matches"))
