import random
import re
from fnmatch import fnmatchcase

import brute
import pytest
from cases import EDGE, make_docs
from pyspark.sql import functions as F

from rubric.llm import fingerprints, license_scan, queries, url_filter

TEMPLATES = [license_scan.phrase(*x) for x in queries.BASE_PHRASES] + list(license_scan.NOTICES)


def test_phrases_are_found_everywhere(spark, edge):
    for r, (i, t) in zip(sorted(license_scan.scan(edge, TEMPLATES).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_words)),
                         sorted(EDGE, key=lambda x: (x[0] is None, x[0], len(brute.license_words(x[1]))))):
        words = brute.license_words(t)
        want = sorted((label, k) for label, p in queries.BASE_PHRASES for k in range(len(words))
                      if words[k:k + len(p.split())] == p.split())
        assert (r.doc_id, r.n_words) == (i, len(words))
        assert sorted((m.label, m.start) for m in r.matches if m.kind == "phrase") == want


def test_notices_need_votes_and_key_phrases(spark):
    mit = next(t for t in TEMPLATES if t.name == "MIT text").text
    texts = [mit, "x " + mit.upper() + " y", mit.replace("hereby", "never"), mit[60:], "licensed under the Apache License, Version 2.0",
             "Apache License, Version 1.1", "version 2 0 apache license", "CC BY-NC 4.0: licensed under CC BY-NC 4.0."]
    docs = make_docs(spark, list(enumerate(texts)))
    got = {r.doc_id: {m.label for m in r.matches if m.kind == "notice"} for r in license_scan.scan(docs, TEMPLATES).collect()}
    assert got == {0: {"mit-text"}, 1: {"mit-text"}, 2: set(), 3: set(), 4: {"apache-2.0"}, 5: set(), 6: set(), 7: {"cc-by-nc"}}


def test_gpl_file_headers(spark):
    header = ("you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by "
              "the Free Software Foundation; {}version {} of the License, or (at your option) any later version.")
    kinds = [("", "either ", "2"), ("", "either ", "3"), ("", "", "2"), ("Lesser ", "either ", "3"), ("Affero ", "either ", "3")]
    docs = make_docs(spark, [(i, header.format(*k)) for i, k in enumerate(kinds)])
    got = {r.doc_id: {m.label for m in r.matches if m.kind == "notice"} for r in license_scan.scan(docs, TEMPLATES).collect()}
    assert got == {0: {"gpl-2.0"}, 1: {"gpl-3.0"}, 2: {"gpl-2.0"}, 3: {"lgpl"}, 4: {"agpl"}}


def test_license_words_are_cut_without_an_object_for_each_match(spark, edge):
    more = [(i, t) for i, t in enumerate(["", " ", "a", " a", "a ", "--a--B9\x7fc", "@[`{ \x00", "\xe9\U0001F600 \u2028x", "A" * 3])]
    for docs in (edge, make_docs(spark, more)):
        rows = docs.select("text", license_scan.words(F.coalesce("text", F.lit(""))).alias("words"))
        assert all(r.words == brute.license_words(r.text) for r in rows.collect())
    assert "regexp_extract_all" not in license_scan.scan(edge, TEMPLATES)._jdf.queryExecution().toString()


def test_license_scan_of_an_empty_table(empty):
    assert license_scan.scan(empty, TEMPLATES).collect() == []


def test_native_plans(edge):
    for df in (license_scan.scan(edge, TEMPLATES), fingerprints.edit_report(edge)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def followers(rows):
    """Rows in order, each with the next one's text: descending ids, nulls last; ties are left open."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(a, b[1] or "") for a, b in zip(order, order[1:] + order[:1])]


def test_edits_use_the_next_document(spark):
    r = random.Random(2)
    rows = [(i * 3, "".join(r.choice("ab é\U0001F600 ") for _ in range(r.randint(0, 40)))) for i in range(300)]
    got = {x.doc_id: x for x in fingerprints.edit_report(make_docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, text), following in followers(rows):
        half = len(text) // 2
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == brute.sha(text[:len(text) - half] + following[:half])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_fingerprints_of_edge_rows(edge):
    rows = fingerprints.edit_report(edge).collect()
    assert len(rows) == len(EDGE)
    prints = {}
    for r in fingerprints.fingerprints(edge).select("text", fingerprints.as_string(fingerprints.F.col("values")).alias("f")).collect():
        assert prints.setdefault(r.text, r.f) == r.f and len(r.f) == 5 * fingerprints.LEVELS * fingerprints.DRAWS
    assert set(prints[""]) == {"0"} and prints["two one"] == prints["one two"] != prints[EDGE[0][1]]


def test_fingerprints_of_few_rows(spark, empty):
    assert fingerprints.edit_report(empty).collect() == []
    one = fingerprints.edit_report(make_docs(spark, [(5, "abcdef")])).collect()
    assert one[0].edited_sha256 == brute.sha("abcabc") and one[0].near_next == 1.0
    nulls = fingerprints.edit_report(make_docs(spark, [(None, "abcd"), (None, "xy")])).collect()
    assert sorted(r.edited_sha256 for r in nulls) == sorted([brute.sha("abxy"), brute.sha("xa")])


def test_half_edited_long_texts_stay_alike(spark):
    """40,000 terms each: 1/512 of them is always touched by the edit."""
    texts = [" ".join(f"{c}{i}" for i in range(40_000)) for c in "pq"] + [f"filler {i}" for i in range(38)]
    rows = fingerprints.edit_report(make_docs(spark, list(enumerate(texts)))).collect()
    long = [r for r in rows if r.n_chars > 100_000]
    assert len(long) == 2 and all(r.near_edited > 0.01 for r in long)
    assert all(r.near_next < 0.01 for r in long) and len({len(r.fingerprint) for r in rows}) == 1


def test_texts_without_lexicon_terms_have_a_likeness(spark):
    """Near copies hold half of the table, so their terms are above the band."""
    hot = " ".join(f"hot{i}" for i in range(200))
    other = [" ".join(f"o{k}x{i}" for i in range(200)) for k in range(20)]
    near = [hot.replace(f"hot{k} ", f"changed{k} ") for k in range(3, 23)]
    got = {r.doc_id: r for r in fingerprints.edit_report(make_docs(spark, list(enumerate(other[:1] + near + other[1:])))).collect()}
    assert min(got[i].near_next for i in range(2, 21)) > 0.3  # the next one is a near copy
    assert got[1].near_edited > 0 and got[1].near_next == 0  # the next one is another text
    few = fingerprints.edit_report(make_docs(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g i")])).collect()
    assert all(0 < r.near_next < 1 for r in few)
    short = fingerprints.edit_report(make_docs(spark, [(i, f"word{i}") for i in range(18)])).collect()
    assert all(r.near_next == 0 for r in short)


def test_copies_do_not_push_terms_out_of_the_lexicon(spark):
    texts = [f"one{i} two{i}" for i in range(40)]
    bits = fingerprints.lexicon(make_docs(spark, list(enumerate(texts))))
    assert any(bits)
    assert fingerprints.lexicon(make_docs(spark, list(enumerate(texts + texts[:1] * 30)))) == bits


def test_a_text_has_the_same_fingerprint_in_every_table(spark):
    texts = [f"one{i} two{i} three{i % 7}" for i in range(60)]
    bits = fingerprints.lexicon(make_docs(spark, list(enumerate(texts))))

    def prints(some):
        return {r.doc_id: r["values"] for r in fingerprints.fingerprints(make_docs(spark, some), bits).collect()}

    alone, among = prints([(5, texts[5])]), prints([*enumerate(texts), (99, " ".join(f"w{i}" for i in range(9000)))])
    assert alone[5] == among[5]


def test_values_and_likeness_against_plain_python(spark):
    """Subsets rebuilt from the terms' hashes: which terms are in the band, in which draws and levels, and which values agree."""
    r, f = random.Random(8), fingerprints
    rows = [(i, " ".join(f"w{r.randrange(80)}" if r.random() < 0.3 else f"own{i}x{k}" if r.random() < 0.5 else f"two{i // 2}x{k}"
                         for k in range(r.randrange(1, 60)))) for i in range(60)] + [(60, "!!!"), (61, "???"), (62, ""), (63, "!!!")]
    docs = make_docs(spark, rows)
    bits = f.lexicon(docs)
    n_numbers = -(-max(f.LEXICAL, f.WHOLE) // f.PER_NUMBER)
    numbers = ", ".join(f"xxhash64(t, {i}) as r{i}" for i in range(n_numbers))
    hashed = docs.select("doc_id", "text", f.F.expr(f"transform({f.terms_sql('text')}, t -> struct(t as t, {numbers}))").alias("terms")).collect()
    for x in hashed:  # a text has as many hashes as distinct terms
        assert len(x.terms) == len(set(brute.license_words(x.text))) and [t.t for t in x.terms] == sorted(t.t for t in x.terms)
    got = {x.doc_id: x["values"] for x in f.fingerprints(docs, bits).collect()}
    df = {}
    for terms in {x.text: x.terms for x in hashed}.values():
        for c in {t.t % f.LEXICON for t in terms}:
            df[c] = df.get(c, 0) + 1
    n = len({t for _, t in rows})
    band = {c for c, k in df.items() if f.BAND[0] * n <= k <= f.BAND[1] * n}
    assert band == {64 * i + j for i, w in enumerate(bits) for j in range(64) if (w >> j) & 1}
    subsets = {}
    for x in hashed:
        if not x.terms:
            continue
        inside = [t for t in x.terms if t.t % f.LEXICON in band]
        lexical = inside if inside and len(inside) * f.SPARSE >= len(x.terms) else []
        cells = []
        for some, draws in ((lexical, f.LEXICAL), (x.terms, f.WHOLE)):
            for d in range(draws):
                def number(t, d=d):
                    return ((t[f"r{d // f.PER_NUMBER}"] % (1 << 64)) >> (f.BITS * (d % f.PER_NUMBER))) & ((1 << f.BITS) - 1)

                for level in range(f.LEVELS):
                    chosen = tuple(t.t for t in some if number(t) < 1 << (f.LEVELS - 1 - level))
                    if not chosen and level == 0 and some is x.terms:
                        chosen = (min((number(t), t.t) for t in some)[1],)
                    cells.append(chosen)
        subsets[x.doc_id] = cells
        assert [v == 0 for v in got[x.doc_id]] == [not c for c in cells]
    split = f.LEXICAL * f.LEVELS
    report = {x.doc_id: x for x in f.edit_report(docs, in_band=bits).collect()}
    for i in range(1, 60):
        a, b = subsets[i], subsets[i - 1]
        part = slice(0, split) if any(a[:split]) and any(b[:split]) else slice(split, None)
        cells = [(p, q) for p, q in zip(a[part], b[part]) if p or q]
        want = 1.0 if a == b else sum(p == q for p, q in cells) / len(cells)
        assert report[i].near_next == pytest.approx(want, abs=1e-9)  # no two values of these rows collide
    assert got[60] == got[63] != got[61] and report[61].near_next == 0.0 and set(got[62]) == {0}


def test_url_filter_agrees_with_its_sql_on_odd_urls(spark):
    import duckdb

    r = random.Random(4)
    parts = ["http", "://", "/", "www.example.com", "Example.COM", "net", ".net", "x.net", "/es/", "/fr/", "/en/", "en", "?", "#", "spam", "com",
             "é", "\n", "", ".", "notexample.com"]
    urls = ["".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(800)]
    urls += [f"https://{h}{p}" for h in ("net", "a.net", "com", "example.com", "www.example.com", "xwww.example.com", "anet")
             for p in ("", "/", "/en/x", "/es/", "/es", "/fr/1?x", "#/en/", "/x.net/es/")] + [None, "http://" + "a" * 5000 + ".com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filter.site_rule(v, n) for n, v in queries.BASE_RULES]
    more = [url_filter.Rule(g, "block", (g,)) for g in queries.SPAM_GLOBS]
    got = {x.page_id: tuple(x) for x in url_filter.judge_urls(pages, rules, more).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    rel = con.sql(queries.ORACLE["op7_url_filter"])
    at = [rel.columns.index(c) for c in ("page_id", "host", "path", "rule", "verdict")]
    for row in rel.fetchall():
        assert got[row[at[0]]] == tuple(row[i] for i in at)


def test_automaton_against_plain_matching():
    r = random.Random(1)
    globs = ["*a", "**b/c**", "a*b", "**", "", "ab", "*/x", "**aa**bb**", "a" * 70 + "**", "**" + "b" * 130]
    rules = [url_filter.Rule(f"{i}", "block", (g,)) for i, g in enumerate(globs)]
    texts = ["".join(r.choice("ab/cx") for _ in range(r.randint(0, 9))) for _ in range(2000)] + ["", "a" * 75, "b" * 131]

    def fits(glob, text):
        return re.fullmatch("".join({"**": "(?s:.*)", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", glob)), text)

    for rule in rules:
        got = url_filter.Automaton([rule]).first_fit(texts)
        assert [k == 0 for k in got] == [bool(fits(rule.globs[0], t)) for t in texts], rule
    best = url_filter.Automaton(rules).first_fit(texts)
    assert (best >= 0).all()  # "**" fits all
    assert fnmatchcase("ab", "a*")


def test_url_filter_of_an_empty_table(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, host string"), []).collect() == []
