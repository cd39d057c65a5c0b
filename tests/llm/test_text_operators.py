"""Row-local operators against plain versions and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from tokenizers import Tokenizer

from logloom.llm import bpe, catalog, html_text, langid, licenses, repetition
from tools.check import compare

from ..conftest import DATA
from .conftest import by_id, prose


def page(html):
    return html_text.render(html_text.parse(html))


@pytest.mark.parametrize("html, text", [
    ("", ""), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<div>a</div>b", "a\nb"), ("a &lt; b &amp;amp;", "a < b &amp;"),
    ("<head><title>t</title><p>x", "x"), ("<p>a <b>b</b>c  d</p>", "a bc d"), ("<script>a<b</script>x<!-- y -->z", "xz"),
    ("<p hidden>a</p><p style='DISPLAY:none'>b</p><span style='visibility:hidden'>c<i style='visibility:visible'>d</i></span>", "d"),
    ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d</ol></ul>e", "- a\n- b\n  3. c\n  9. d\n\ne"),
    ("<table><tr><td>aa<td>b<tr><td>c<td align=right>dd</table>", "aa  b\nc   dd"),
    ("<table>x<tr><td colspan=2>wide<tr><td>a<td>b</table>", "x\n\nwide\na  b"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<details><summary>s</summary>x</details>", "s"), ("</p></div>a</b>", "a"), ("a <unfinished", "a"), ("1 < 2 <3", "1 < 2 <3"),
    ("<textarea><b>x</textarea>", "<b>x"), ("<td>a</td>", "a"),
])
def test_html_cases(html, text):
    assert page(html) == text


@pytest.mark.parametrize("html, text", [
    ("<p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></math> holds</p>", "so x=2 holds"),
    ("<math><semantics><mi>y</mi><annotation encoding='application/x-tex'>\\y</annotation></semantics></math>z", "yz"),
    ("<math><mtable><mtr><mtd>a</mtd><mtd>b</mtd></mtr><mtr><mtd>c</mtd></mtr></mtable></math>", "a b\nc"),
    ("a<svg viewBox='0 0 1 1'><title>t</title><desc>d</desc><defs/><g>loose<path d='M0'/><text x='1'>one <tspan>two</tspan></text><text>three</text></g></svg>b", "a\none two\nthree\nb"),
    ("<svg><defs><text>x</text></defs><symbol><text>y</text></symbol><metadata>m</metadata><style>s</style><text display='none'>n</text><text>shown</text></svg>", "shown"),
    ("<svg><foreignObject><p>html</p></foreignObject></svg>", "html"), ("<svg/>a<text>b</text><desc>c</desc>", "abc"),
    ("<table><tr><td><svg><circle r='1'/><text>a</text></svg><td>b</table>", "a  b"),
])
def test_html_formulas_and_drawings(html, text):
    assert page(html) == text


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_html_keeps_all_visible_words(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_text.extract_pages(rows).collect()}
    for r in rows.collect():
        plain = _Plain()
        plain.feed(r["html"])
        words = lambda t: Counter(x for x in "".join(t).split() if x not in ("-", "—"))
        assert words(found[r["page_id"]]) == words(plain.out)


@pytest.mark.parametrize("wide, rows", [(40_000, 1000), (20_000, 500), (2000, 3000)])
def test_html_wide_cells_are_not_padded(wide, rows):
    """A very wide cell, one of many columns, tables in tables: all words stay, and the text is bounded by the page."""
    short = "".join(f"<tr><td>a{i}<td align=right>b{i}" for i in range(rows))
    pages = [
        f"<table><tr><td>{'w ' * (wide // 2)}<td>x{short}</table>", f"<table><tr>{'<td>cell' * 999}{'<tr><td colspan=999>y<td>z' * rows}</table>",
        f"<table><tr><td>{'v' * wide}<td><table>{short}</table>{'<tr><td>p<td>q' * rows}</table>"]
    for html in pages:
        text = page(html)
        assert len(text) <= html_text.MOST_PADDING * len(html)
        assert sorted(text.split()) == sorted(re.sub("<[^>]*>", " ", html).split())
    assert page("<table><tr><td>name<td>n<tr><td>a<td align=right>1</table>") == "name  n\na     1"


def test_html_deep_lists_grow_with_the_page():
    lines = page("<ul><li>x" * 5000).split("\n")
    assert len(lines) == 5000 and max(map(len, lines)) <= html_text.MOST_INDENT + 3
    assert lines[1].index("x") > lines[0].index("x")


def test_html_odd_input(spark):
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    rows = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, deep, "u"), (3, deep, "u"), (None, "<p>a", "u")], "page_id long, html string, text string")
    found = {(r["page_id"], r["text"], r["n_lines"]) for r in html_text.extract_pages(rows).collect()}
    assert found == {(1, None, None), (2, "", 0), (3, "x", 1), (None, "a", 1)}
    assert html_text.extract_pages(rows.limit(0)).count() == 0
    r = random.Random(3)
    tags = ["p", "li", "ul", "ol", "table", "tr", "td", "b", "div", "head", "body", "select", "pre", "br", "caption", "a", "h1", "thead"]
    for _ in range(500):
        page("".join(r.choice(["<%s>", "</%s>", "<%s hidden>", "w%s ", "<%s a='"]) % r.choice(tags) for _ in range(40)))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.word_vocabulary())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.word_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_matches_the_library(vocabulary, library):
    r = random.Random(5)
    parts = ["a", "'s", "'re", "'", "é", " ", "\n", "<|endoftext|>", "<|startoftext|>", "1", "²", "漢", "İ", "Σ", "\x1c", "\x85", "!", "__", "😀", "the", "ing", "ß", "\x00", "‍"]
    texts = ["", "x" * 3000, *("".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(500))]
    texts += ["".join(chr(r.randint(33, 0x24F)) for _ in range(25)) for _ in range(300)]
    ids, counts = bpe.Encoder(vocabulary).encode_all(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_matches_the_library_at_every_code_point(vocabulary, library):
    """After a letter and after a sign, so that its kind decides where words end."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c} !{c}" for c in points]
    encoder = bpe.Encoder(vocabulary)
    wrong = []
    for at in range(0, len(texts), 50_000):
        some = texts[at: at + 50_000]
        ids, counts = encoder.encode_all(some)
        known = library.encode_batch(some, add_special_tokens=False)
        wrong += [hex(ord(points[at + i])) for i, (own, e) in enumerate(zip(np.split(ids, np.cumsum(counts)[:-1]), known, strict=True)) if own.tolist() != e.ids]
    assert not wrong


def test_bpe_verification_is_exact(vocabulary):
    """A greedy proposal passes if and only if it is what merging gives."""
    r = random.Random(6)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    data, first = np.frombuffer("".join(words).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    proposed, _ = vocabulary.greedy(data, first)
    atoms = vocabulary.atoms[data]
    atoms[first[1:] - 1] = vocabulary.last_atoms[data[first[1:] - 1]]
    merged = vocabulary.merge(atoms.copy(), first)
    for i in range(len(words)):
        a, b = proposed[first[i]: first[i + 1]], merged[first[i]: first[i + 1]]
        a, b = a[a >= 0], b[b >= 0]
        top = np.full(max(0, len(a) - 1), len(vocabulary.by_rank) + 1)
        assert bool(vocabulary.untouched(a[:-1], a[1:], top).all()) == (a.tolist() == b.tolist())
        assert vocabulary.merge_long(atoms[first[i]: first[i + 1]].tolist()) == b.tolist()


def test_bpe_round_trip(spark, odd, none, library):
    v = bpe.load(spark, bpe.word_vocabulary())
    rows = bpe.round_trip(odd, v).collect()
    texts = [r["text"] for r in odd.collect()]
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(none, v).count() == 0
    back = spark.createDataFrame([([49406, 10 ** 6, 320, -1],), (None,), ([],)], "ids array<int>").select(bpe.decoded("ids", v)).collect()
    assert [r[0] for r in back] == [library.decode([49406, 320], skip_special_tokens=False), None, ""]


def test_bpe_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in catalog.QUERIES["op2_bpe"](spark, DATA).collect():
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_language_accuracy(spark):
    directory = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    rows = catalog.QUERIES["op3_language_id"](spark, directory).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_odd_input(spark, odd, none):
    found = by_id(langid.identify(odd, odd).collect(), "lang_pred", "score", "rejected")
    for i in (1, 2, 3, 12):
        assert found[i] == [("und", 0.0, True)]
    assert found[9][0][0] == "fr" and len(found[6]) == 2
    assert langid.identify(none, odd).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    one = langid.identify(odd, odd.filter("lang = 'en'")).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("und", 0.0), ("en", 1.0)}


def test_language_of_many_copies(spark):
    """Copies neither starve the other texts of their language nor fill its sample."""
    single = [" ".join(prose(1000 + k, 12)) for k in range(300)]
    rows = spark.range(300).selectExpr("element_at(array(" + ", ".join(f"'{t}'" for t in single) + "), int(id) + 1) as text", "'many' as lang")
    copies = spark.range(60000).selectExpr("concat('same text number ', id % 3) as text", "'many' as lang")
    few = spark.range(100000).selectExpr("concat('copied ', substr('abcdefghijklmnopqrst', int(id % 20) + 1, 1)) as text", "'few' as lang")
    learned = langid.learn(rows.unionByName(copies).unionByName(few))
    assert {k: v.texts for k, v in learned.items()} == {"many": 60300, "few": 100000}
    held = learned["many"].dictionary.decode()
    assert sum(t.split()[0] in held and langid.words(t).decode() in held for t in single) >= langid.SAMPLE_TEXTS - 3
    assert learned["few"].dictionary.decode().count("copied") == 20


def _plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if triples[tuple(words[i: i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]
    for n in repetition.MOST_COVERED:
        runs = Counter(tuple(words[i: i + n]) for i in range(len(words) - n + 1))
        inside = {i + j for i in range(len(words) - n + 1) if runs[tuple(words[i: i + n])] > 1 for j in range(n)}
        out.append(sum(len(words[i]) for i in inside))
    twice = Counter(lines)
    out.append(sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in lines if twice[x] > 1))
    return tuple(out)


def test_quality_rules(spark, odd, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"chars_{n}" for n in repetition.MOST_COVERED), "chars_lines"]
    for docs in (odd, spark.read.parquet(f"{DATA}/documents.parquet")):
        texts = [r["text"] for r in docs.collect()]
        rows = repetition.quality_rules(docs).collect()
        for r, t in zip(rows, texts, strict=True):
            expect = _plain_rules(t)
            assert tuple(r[n] for n in names) == expect
            failed = expect[0] < 50 or 100 * expect[4] > 50 * expect[0]
            shares = [c / expect[1] if expect[1] else 0.0 for c in expect[5:]]
            assert r["base_failed"] == failed
            assert r["kept"] == (not failed and all(s <= m for s, m in zip(shares, [*repetition.MOST_COVERED.values(), repetition.MOST_IN_LINES], strict=True)))
    assert repetition.quality_rules(none).count() == 0


def test_license_scan(spark, odd, none):
    status, _, note = compare(spark, "op6", catalog.QUERIES["op6_license_scan"], catalog.SQL["op6_license_scan"], DATA)
    assert status == "ok", note
    rows = spark.createDataFrame([
        (1, "x\nReleased under the MIT License.\ny"), (2, None), (3, ""), (4, "Licensed under\nthe Apache License,\nVersion 2.0.\n\nother words here"),
        (5, "released under the gpl"), (6, "licensed under CC BY 4.0"), (7, "word"), (8, licenses.TEMPLATES[-2][1])], "doc_id long, text string")
    found = by_id(licenses.scan_licenses(rows).collect(), "licenses", "n_units")
    assert {k: v[0][0] for k, v in found.items()} == {1: "MIT", 2: "", 3: "", 4: "Apache-2.0", 5: "", 6: "CC-BY-4.0", 7: "", 8: "MIT"}
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(none).count() == 0


def test_license_headers_and_texts(spark):
    gpl = "This {} is free software{} you can redistribute it and/or modify it\nunder the terms of the GNU {}General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
    cases = [
        (gpl.format("program", ";", "", ";", "2"), "GPL-2.0"), (gpl.format("program", ":", "", ",", "3"), "GPL-3.0"),
        (gpl.format("program", ":", "Affero ", ",", "3"), "AGPL-3.0"), (gpl.format("library", ":", "Lesser ", ",", "3"), "LGPL-3.0"),
        (bsd, "BSD-2-Clause"), (bsd + "\n3. Neither the name of the owner may be used.\n", "BSD-3-Clause"),
        ("Some words stand first. Released under the MIT License. More words follow here, and some more.", "MIT"),
        ("Some words stand first; a notice then: Licensed under CC BY-SA 4.0; more words follow here, and some more.", "CC-BY-SA-4.0"),
        ("Some words stand first. " + gpl.format("program", ";", "", ";", "2") + " More words follow.\nAnd some more.", "GPL-2.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
        *((re.sub(r"3\. Neither.*?(?=THIS SOFTWARE)", "3. The name of the author may not be used to endorse or promote products.\n\n", t, flags=re.S), name) for name, t in licenses.full_texts() if name == "BSD-3-Clause"),
        *((f"Some title\n\n{t}\n\nsome end", name) for name, t in licenses.full_texts())]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(rows).collect()}
    assert found == {i: name for i, (_, name) in enumerate(cases)}
