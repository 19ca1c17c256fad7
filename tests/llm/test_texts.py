"""Fingerprints, licenses, leaks, pages, personal data, language."""

import dataclasses
import hashlib
from pathlib import Path
import re

import numpy as np
import pytest
import zstandard

from dossierlake.llm import decontaminate, fingerprints, html, language, licenses, pii

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fingerprints_follow_the_order_of_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    expected = {}
    for (doc_id, text), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        expected[doc_id] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.fingerprint(text), fingerprints.fingerprint(changed))
    for bins in (3, 64):
        found = {r["doc_id"]: tuple(r)[1:5] for r in fingerprints.fingerprints_with_next(docs, bins).collect()}
        assert found == expected


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    found = rows(fingerprints.fingerprints_with_next(odd_docs))
    assert len(found) == odd_docs.count()
    assert {r[3] for r in found if r[1] == 0} == {"4::"}
    assert rows(fingerprints.fingerprints_with_next(no_docs)) == []
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in found)
    alone = odd_docs.where("doc_id = 10")
    assert [r[6] for r in fingerprints.fingerprints_with_next(alone).collect()] == [1.0]
    assert fingerprints.fingerprints(odd_docs).count() == odd_docs.count()


def brute_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_likeness():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 30))) for _ in range(2))
        assert fingerprints.common_length(a, b) == brute_common(a, b)
    text = "".join(rng.choice(list("abcdefghij klmnop"), 5000))
    other = "".join(rng.choice(list("abcdefghij klmnop"), 5000))
    one = fingerprints.fingerprint(text)
    assert fingerprints.likeness(one, fingerprints.fingerprint(text[:2500] + "inserted" + text[2500:])) > 0.9
    assert fingerprints.likeness(one, fingerprints.fingerprint(text[:2500])) > 0.4
    assert fingerprints.likeness(one, fingerprints.fingerprint(other)) == 0
    assert len(fingerprints.fingerprint("a" * 100000)) < 300 and len(fingerprints.fingerprint("ab c" * 50000)) < 300
    small = fingerprints.PIECE_OF_TEXT
    try:
        fingerprints.PIECE_OF_TEXT = 100
        assert fingerprints.fingerprint(text) == one
    finally:
        fingerprints.PIECE_OF_TEXT = small


def test_licenses(spark, odd_docs, no_docs):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    mit = licenses.TEMPLATES["MIT"][2]
    docs = spark.createDataFrame([
        (1, "Some words.\nLicensed under CC BY-NC 4.0.\nMore words follow here."), (2, "x\n" + apache.replace(". ", ".\n") + "\ny"),
        (3, "Copyright 2020 Someone\n" + mit.replace("without restriction", "with no restriction at all") + "\nEnd"),
        (4, "A driving license is needed to drive a car."), (5, "first\nReleased under the MIT License.\nLicensed under CC BY 4.0.\nlast"),
        (6, None), (7, "x " * 100000 + "Released under the MIT License. " + "y " * 100000),
    ], "doc_id bigint, text string")
    found = {(r["doc_id"], r["license"]): r for r in licenses.license_findings(docs).collect()}
    assert set(found) == {(1, "CC-BY-NC-4.0"), (2, "Apache-2.0"), (3, "MIT"), (5, "MIT"), (5, "CC-BY-4.0"), (7, "MIT")}
    assert found[2, "Apache-2.0"]["exact"] and not found[3, "MIT"]["exact"]
    assert any("without > with no" in d for d in found[3, "MIT"]["differences"])
    text = docs.where("doc_id = 5").first()["text"]
    assert text[found[5, "MIT"]["start"] : found[5, "MIT"]["end"]] == "Released under the MIT License"
    assert licenses.license_findings(odd_docs).count() == 0 and licenses.license_findings(no_docs).count() == 0


def test_whole_license_texts_are_found():
    """Each text is found by its own sections, also with a changed word, and nothing of it under another name."""
    ready = licenses.prepared()
    folder = Path(licenses.__file__).parent / "license_texts"
    for file in sorted(folder.iterdir()):
        text = file.read_text().replace(" any ", " whatever ", 1)
        found = licenses.scan("A heading.\n\n" + text, ready)
        covered = sum(f.end - f.start for f in found if f.license == file.name[:-4])
        assert covered > 0.75 * len(text), (file.name, covered, len(text))
        assert sum(f.end - f.start for f in found if f.license != file.name[:-4]) < 0.12 * len(text), file.name
        assert any("any > whatever" in d for f in found for d in f.differences), file.name


def all_compared(words, templates):
    """The best template by comparing every one."""
    found = [(*licenses.compared(t, words), t) for t in templates]
    return max(((share, len(t.words), [-ord(c) for c in t.license]) for share, *_, t in found if share >= licenses.AGREEING), default=None)


def test_the_ranking_decides_how_much_is_compared(spark, monkeypatch):
    ready = licenses.prepared()
    plain = zstandard.ZstdCompressor(level=9)
    calls = []
    compared = licenses.compared
    monkeypatch.setattr(licenses, "compared", lambda *a: calls.append(1) or compared(*a))
    texts = [t for t in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toPandas()["text"] if licenses.CUE.search(t or "")]
    samples = [licenses.canonical(t[a:b]).decode().split() for t in texts for a, b in licenses.blocks(t)]
    samples += [list(t.words) for t in ready]
    for words in samples:
        best = licenses.best_of(words, ready, plain)
        made, expected = len(calls), all_compared(words, ready)
        assert (best and (best[2], len(best[1].words), [-ord(c) for c in best[1].license])) == expected
        del calls[:]
        assert made <= len(ready)

    class Constant:
        def compress(self, data):
            return b"x" * 10

    def comparisons(templates, words):
        del calls[:]
        licenses.best_of(words, templates, plain)
        return len(calls)

    blind = [dataclasses.replace(t, compressor=Constant()) for t in ready]
    wholes = [list(t.words) for t in ready if len(t.words) > 100]
    assert sum(comparisons(ready, w) for w in wholes) < sum(comparisons(blind, w) for w in wholes)


PARAGRAPH = """You may not think so, but the use of the word without any of the conditions that are subject to the law in this form is, as far as
we can see, not permitted in most of the countries that have signed the agreement, and to the extent that it is, the person who made the
copy has to include a notice of the source, either in the text or in the files which are distributed with it, and to obtain the
permission of those who hold the rights. Any person who is free to publish, sell or modify a work has to say so at the start. """


def test_every_license_that_the_words_allow_is_confirmed():
    """Short notices in a long line of common English words, where long templates save more bytes, and whole notices."""
    ready = licenses.prepared()
    for notice, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under the ISC License.", "ISC")):
        for text in (PARAGRAPH.replace("\n", " ") + notice + " And so on.", PARAGRAPH.replace("\n", " ") * 3 + notice + " " + PARAGRAPH.replace("\n", " ")):
            (found,) = licenses.scan(text, ready)
            assert found.license == name and text[found.start : found.end] + "." == notice
    for name, wordings in licenses.TEMPLATES.items():
        for wording in wordings:
            assert name in {f.license for f in licenses.scan(f"before it {wording} after it", ready)} or not licenses.CUE.search(wording), wording


ITEM = "Tom has 3 apples and 5 kg of pears. Then Tom eats 2 apples at the house of Ann Bell."


def test_leaks_with_other_numbers_and_names(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "short one"), (None, "nothing of this kind at all is ever found here")], "item_id bigint, text string")
    docs = spark.createDataFrame([
        (1, "before. " + ITEM + " after"), (2, "Bob has 7 apples and 9 kg of pears. Then Bob eats 4 apples at the house of Eve Dell."),
        (3, "Bob has 7 apples and 9 kg of pears. Then he sleeps for long and dreams of other things in another town by the sea."),
        (4, None), (5, ""), (6, "w " * 1000 + ITEM + " v" * 1000), (7, "It is a short one."),
    ], "doc_id bigint, text string")
    expected = {(1, 1), (2, 1), (6, 1), (7, 3)}
    found = decontaminate.contaminated(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected
    assert {r["doc_id"]: r["changed_slots"] for r in found.where("item_id = 1").collect()}[2] > 0
    assert {r["doc_id"] for r in decontaminate.cleaned(docs, items).collect()} == {3, 4, 5}
    monkeypatch.setattr(decontaminate, "AT_ONCE", 5)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == expected
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.cleaned(odd_docs, items).columns == odd_docs.columns and decontaminate.contaminated(no_docs, items).count() == 0
    monkeypatch.setattr(decontaminate, "PIECE", 300)
    block = [(1, ITEM)]
    assert [x[0] for x in decontaminate.leaks("w " * 1000 + ITEM + " v" * 1000, block)] == [1]
    assert decontaminate.leaks(ITEM.replace("Then Tom", "Then Bob").replace("Tom has", "Al has"), block)[0][1] < 1


def test_leaks_of_short_sentences_that_start_with_names():
    item = "Tom has 3 apples. Ann has 5 pears. Sue has 2 figs. Joe has 9 plums. How many fruits do they have in all?"
    other = "Bob has 8 apples. Eve has 6 pears. Kim has 4 figs. Max has 7 plums. How many fruits do they have in all?"
    block = [(1, item)]
    spelled = other.replace("8", "eight").replace("6", "six").replace("4", "four").replace("7", "seven")
    for text in (other, spelled, "Before it stands this. " + other + " And this comes after."):
        (leak,) = decontaminate.leaks(text, block)
        assert leak[0] == 1 and leak[1] == 1 and leak[3] > 0
    assert decontaminate.leaks("Bob likes apples. Eve has 6 cats. Kim sold 4 figs. Max saw 7 plums. Many people have nothing at all.", block) == []


def test_leaks_with_words_put_in():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    block = [(1, " ".join(words))]
    moved = words[:11] + ["new"] + words[11:22] + words[24:36]
    (leak,) = decontaminate.leaks("before it " + " ".join(moved) + " after", block)
    assert 0.8 < leak[1] < 0.95 and leak[2] == 12
    assert decontaminate.leaks(" ".join(words[:9] + ["other", "words"] * 9), block) == []


def test_the_scanner_reads_the_canonical_words(spark, monkeypatch):
    """Word numbers of many texts at once are those of their canonical words, in both forms."""
    rng = np.random.default_rng(7)
    parts = ["Tom", "tom", "The", "THE", "x.", "said:", "(Ann", "\"Bob", "5", "5-", "-", "kg", "Kg.", "-km", "m/s", "3kg", "1,000.5", "$5", "50%", "Three", "three,",
             "Äpfel", "ÄPFEL", "it's", "A-b", "A.", "x_y", "١", "²", "ſ", "5.", "...", "", "\t", "a\tB", "Meters", "METERS", "–", "“Eve", "日本", "Z9z", "I"]
    seps = [" ", " ", " ", " ", "\n", "  ", "\t", " \n"]
    texts = ["".join(rng.choice(parts) + rng.choice(seps) for _ in range(rng.integers(0, 30))) for _ in range(3000)]
    texts += ["TOM HAS THREE APPLES AND 5 KG. ANN TOO", "TOM", "", "\n", " "]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for known in (1 << 20, 300):
        monkeypatch.setattr(decontaminate, "KNOWN_CHUNKS", known)
        scanner = decontaminate.Scanner()
        for i in range(0, len(texts), 250):
            some = texts[i : i + 250]
            words, ends = scanner.numbers(some)
            begin = 0
            for text, end in zip(some, ends.tolist(), strict=True):
                expected = [[decontaminate.word_number(w) for w in form.words] for form in decontaminate.forms(text)]
                assert words[begin:end].T.tolist() == expected, text
                begin = end + 1
            assert begin == len(words)


def test_leaks_do_not_depend_on_other_items(spark):
    names = [("Will", "Grace", "Mark", "Rose"), ("Bob", "Eve", "Kim", "Max")]
    item, text = (f"{a} has 3 apples. {b} has 5 pears. {c} has 2 figs. {d} has 9 plums. How many do they have?" for a, b, c, d in names)
    other = "they will mark the rose with grace and then the very long day ends as it has begun for all"
    docs = spark.createDataFrame([(1, text), (2, "nothing of this")], "doc_id bigint, text string")
    for rows in ([(1, item)], [(1, item), (2, other)], [(i, other) for i in range(3, 50)] + [(1, item)]):
        items = spark.createDataFrame(rows, "item_id bigint, text string").repartition(3)
        assert [(r["doc_id"], r["item_id"], r["covered"]) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 1, 1.0)]


def test_leaks_are_those_of_comparing_all_pairs(spark, monkeypatch):
    """Every text with every item, without hashes of windows that a bit map lets pass; also where the map lets all pass."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    expected = sorted((r["doc_id"], *leak) for r in docs.collect() for leak in decontaminate.leaks(r["text"], items))
    for bits in (decontaminate.LEAST_BITS, 3):
        monkeypatch.setattr(decontaminate, "LEAST_BITS", bits)
        monkeypatch.setattr(decontaminate, "MOST_BITS", max(bits, 3))
        found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"))
        assert sorted(tuple(r) for r in found.collect()) == expected


def test_whole_items_are_found(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    listed = [(r["item_id"], r["text"]) for r in items.collect()]
    expected = {(r["doc_id"], i) for r in docs.collect() for i, t in listed if t in (r["text"] or "")}
    assert expected <= {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="masthead"><p>Site name</p></div><div class="menu"><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></div>
<div class="cookie-notice"><p>We use cookies to make this site work for all of its visitors.</p></div>
<div class="story"><h1>Short</h1><p>The first paragraph of the story has <b>quite</b> some words &amp; tells&nbsp;what it is about.</p>
<p>The second one, which is a little longer than the first, goes on to say more of it.
<p>The third was never closed</div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Another story</a></li></ul></aside>
<div class="comments"><div class="comment"><p>I read this with great joy and want more of this kind of thing, really.</p></div></div>
<form><p>Subscribe to our letter</p><input><button>Send</button></form><footer><p>&copy; 2020 Someone</p></footer>"""


@pytest.fixture(scope="module")
def forest(spark):
    return html.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_pages(spark, forest):
    expected = "Short\nThe first paragraph of the story has quite some words & tells what it is about.\n" \
        "The second one, which is a little longer than the first, goes on to say more of it.\nThe third was never closed"
    assert html.main_text([PAGE], forest) == [expected]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    same = 0
    for r in html.extracted(pages, forest).collect():
        page = html.parsed(r["html"])
        same += r["text"] == html.text_of(page, html.plain_choice(page))
        assert r["n_chars"] == len(r["text"])
    assert same >= 0.98 * pages.count()


def test_no_child_of_a_dropped_node_is_kept(forest):
    page = html.parsed(PAGE)
    rng = np.random.default_rng(3)
    for _ in range(20):
        keep = html.kept(page, rng.normal(0, 3, len(page.nodes)))
        assert all(not keep[i] or i == 0 or keep[n.parent] for i, n in enumerate(page.nodes))


def test_odd_pages(spark, forest):
    odd = [None, "", "   ", "no tags at all", "<", "<p", "<p class='x", "</p></div>", "<!-- open", "<script>never closed", "<div " * 50, "<a><b><p>x</a></b>", "&#x110000; &bogus; &amp"]
    pages = spark.createDataFrame([(i, "u", t, "clash") for i, t in enumerate(odd)] + [(None, None, None, None)], "page_id bigint, url string, html string, text string")
    for model in (forest, None):
        assert len(rows(html.extracted(pages, model).select("page_id", "text", "n_chars"))) == len(odd) + 1
    assert html.fit(pages) is None and html.fit(pages.limit(0)) is None
    assert html.extracted(pages.limit(0), forest).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "phone" and not 10 <= len(number) <= 15:
                continue
            if kind == "card":
                doubled = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number)))
                if not 14 <= len(number) <= 19 or doubled % 10:
                    continue
            out.append((m.start(), rank, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_base_spans(spark):
    texts = [
        None, "", "a@b.c@d.e", "x@y.zz_w@q.rr", "a.b+c@d-e.f.g.", "@a.b", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.4 0.0.0.0", "1.1.1.1.1",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (123) 555-7713 x +12 +1+2345678901", "4111111111111111 4111111111111111", "é\U0001f600 a@b.co é",
        "1 " * 5000, "a@b" + ".c" * 20000, "1.2" * 2000, "a" * 200000 + "@b.c", "9" * 20000 + "." + "8" * 10, "+" + "1-" * 10000 + "x",
    ]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in pii.find(docs).collect()}
    assert found == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_disclosing_terms(spark):
    names = ["alpha", "bravo", "carol", "delta", "echo", "fox", "golf", "hotel"]
    rows_ = [(i, f"some words {names[i]} then Zanzibar wrote from a@b.com about {names[-1 - i]} things") for i in range(4)]
    rows_ += [(10 + i, f"words about things wrote then from some other place number {i}") for i in range(60)]
    rows_ += [(90, "Zanzibar once more, without the address"), (91, rows_[0][1]), (91, rows_[0][1]), (92, None), (None, "c@d.org")]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string").selectExpr("*", "'x' AS key", "'y' AS spans", "length(text) AS n_chars")
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    marked = {d for d, r in found.items() if any(s["kind"] == "term" for s in r["spans"])}
    assert marked == {0, 1, 2, 3, 91}
    term = next(s for s in found[0]["spans"] if s["kind"] == "term")
    assert rows_[0][1][term["start"] : term["end"]] == "Zanzibar"
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "[EMAIL]" in texts[0] and "Zanzibar" not in texts[0] and texts[90] == rows_[64][1] and texts[None] == "[EMAIL]"
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean.collect())


def test_odd_rows_of_personal_data(odd_docs, no_docs):
    assert pii.find(odd_docs).count() == odd_docs.count() and pii.find(no_docs).count() == 0
    assert sorted(map(repr, rows(pii.sanitised(odd_docs)))) == sorted(map(repr, rows(odd_docs)))


def test_languages(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where("doc_id % 5 <> 0"))
    assert model.languages == sorted(model.languages) and set(model.languages) == {"de", "en", "es", "fr"}
    test = docs.where("doc_id % 5 = 0")
    found = language.identified(test, model)
    assert found.where("lang = lang_pred").count() >= 0.97 * test.count() and found.where("rejected").count() == 0
    assert model.predict("Это совсем другой язык, написанный другими буквами")[2] and model.predict("12 34 !")[0] == "und"
    odd = {r["doc_id"]: r for r in language.identified(odd_docs, model).collect()}
    assert odd[2]["lang_pred"] == odd[7]["lang_pred"] == "und" and odd[2]["score"] == 0 and odd[1]["lang_pred"] != "und"
    nothing = language.fit(no_docs.select("doc_id", "text", "lang"))
    assert nothing.predict("words")[0] == "und" and language.accepted(no_docs, model).count() == 0
    assert language.accepted(odd_docs.where("doc_id = 1"), model).columns == odd_docs.columns


OTHERS = {
    "it": "Il governo ha annunciato ieri una nuova legge sulla scuola che entrerà in vigore dal prossimo anno, mentre i sindacati hanno chiesto di discutere ancora il testo con gli insegnanti.",
    "nl": "De regering heeft gisteren een nieuwe wet over het onderwijs aangekondigd die volgend jaar in werking treedt, terwijl de vakbonden om nader overleg met de leraren hebben gevraagd.",
    "fi": "Hallitus ilmoitti eilen uudesta koululaista, joka tulee voimaan ensi vuonna, kun taas ammattiliitot ovat pyytäneet keskustelemaan tekstistä vielä opettajien ja perheiden kanssa.",
    "tr": "Hükümet dün gelecek yıl yürürlüğe girecek olan yeni bir okul yasasını duyurdu, sendikalar ise metnin öğretmenler ve ailelerle yeniden tartışılmasını istedi.",
    "pl": "Rząd ogłosił wczoraj nową ustawę o szkołach, która wejdzie w życie w przyszłym roku, natomiast związki zawodowe poprosiły o ponowne omówienie tekstu.",
}


def test_unlearned_languages_and_junk_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where("doc_id % 5 <> 0"))
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    junk = [" ".join(letters(int(rng.integers(2, 10))) for _ in range(n)) for n in (15, 60, 400)]
    junk += ["".join(rng.choice(list("0123456789abcdef"), n)) for n in (100, 600, 5000)]
    others = [text[: len(text) // k] * n for text in OTHERS.values() for k, n in ((1, 1), (1, 20))]
    assert [t for t in junk + others if not model.predict(t)[2]] == []
    # clean loss on snippets of rows that were not learned from
    texts = [r["text"] for r in docs.where("doc_id % 5 = 0").collect() if r["text"]]
    for size, most in ((100, 0.01), (400, 0.01), (2000, 0.002)):
        parts = [t[i : i + size] for t in texts for i in range(0, len(t), size) if len(t) - i >= size]
        assert sum(model.predict(p)[2] for p in parts) <= most * len(parts)
