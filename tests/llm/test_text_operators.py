"""Markup, encoding, leaks and personal information."""

import os
import random
import time

import pytest

from lexmill.llm import encode, leak, markup, pii

DOCUMENTS = "doc_id long, text string, lang string, source string, ids string, kinds string, first_word int"
VOCABULARY = f"{encode.FOLDER}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


def documents_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", 1) for i, t in texts], DOCUMENTS)


ODD = [None, "", " ", "\n\n \t", "Oil prices rose 3.4 pct.", "don't we'll I'M", "naïve café — 日本語 😀", "a" * 3000, "<|endoftext|> x", "\x00\x1c\u200b", " \u00a0 x", "e\u0301", "½ ² ٣", "x" + " " * 50 + "y"]


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(encode.read_ranks(open(VOCABULARY, "rb").read()))


@needs_vocabulary
def test_encoding_matches_the_library(spark, encoder):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    rows = documents_of(spark, [*enumerate(ODD), (4, ODD[4]), (None, "no id")])
    got = [(r.doc_id, r.ids) for r in encode.encode_texts(rows).collect()]
    assert len(got) == len(ODD) + 2
    for key, ids in got:
        text = "no id" if key is None else ODD[key]
        assert ids == ([] if not text else library.encode(text, add_special_tokens=False).ids)
    assert encode.encode_texts(rows.limit(0)).count() == 0


@needs_vocabulary
def test_round_trip(encoder):
    back = {v: k for k, v in encoder.ranks.items()}
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aetoin shrdlu.,é日😀\n\t0123456789'") for _ in range(rng.randint(0, 300)))
        assert b"".join(back[i] for i in encoder.encode(text)).decode() == text


@needs_vocabulary
def test_long_pre_token(encoder):
    began = time.time()
    ids = encoder.encode("abcdefgh" * 25_000)
    assert ids and time.time() - began < 20
    assert encoder.queue.pop() is None


def test_rank_queue():
    queue, rng, items = encode.RankQueue(50_000), random.Random(3), []
    for _ in range(3000):
        items.append((rng.randrange(50_000), rng.randrange(100)))
        queue.push(*items[-1])
    assert [queue.pop() for _ in items] == sorted(items) and queue.pop() is None


def brute_leaks(documents, items, least):
    out = set()
    for item, text in items:
        own = leak.words(text or "")
        runs = {tuple(own[i : i + least]) for i in range(len(own) - least + 1)}
        for doc, other in documents:
            seen = leak.words(other or "")
            if any(tuple(seen[i : i + least]) in runs for i in range(len(seen) - least + 1)):
                out.add((doc, item))
    return out


@pytest.mark.parametrize("seed,limit", [(1, leak.MOST_CHARACTERS), (2, 300)])
def test_leaks(spark, seed, limit):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 40)))) for i in range(1, 25)]
    items += [(30, None), (31, ""), (32, items[0][1])]
    docs = []
    for i in range(60):
        filler = lambda: " ".join(rng.choices([*words, "zz", "yy"], k=rng.randint(0, 30)))
        item = (rng.choice(items[:24])[1]).split()
        start = rng.randrange(len(item))
        docs.append((i, f"{filler()}\n{'; '.join(item[start : start + rng.randint(1, 25)]).upper()}! {filler()}"))
    docs += [(100, None), (101, ""), docs[0]]
    frame = documents_of(spark, docs)
    asked = spark.createDataFrame([(i, t, "en", 1) for i, t in items], "item_id long, text string, suite string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in leak.leaks(frame, asked, 5, limit).collect()}
    assert got == brute_leaks(docs, items, 5) and got
    assert leak.leaks(frame.limit(0), asked).count() == 0 and leak.leaks(frame, asked.limit(0)).count() == 0


def test_leaked_spans_are_cut(spark):
    item = "one two three four five six"
    frame = documents_of(spark, [(1, f"Before it. {item}, after ALL of this long text here."), (2, item), (3, "clean")])
    asked = spark.createDataFrame([(9, item)], "item_id long, text string")
    found = leak.leaks(frame, asked, 4)
    assert {(r.doc_id, r.first_word, r.end_word) for r in found.collect()} == {(1, 2, 8), (2, 0, 6)}
    got = {r.doc_id: (r["items"], r.text) for r in leak.clean(frame, found).collect()}
    assert got == {1: ([9], "Before it. , after ALL of this long text here."), 2: ([9], None)}


def test_cut_keeps_the_case_of_the_rest():
    """A capital I with a dot becomes two characters in lower case and breaks a word."""
    assert leak.words("AİB") == ["ai", "b"]
    assert leak.without_spans("Keep AİB This ONE two Rest", [(4, 6)], 0.9) == "Keep AİB This  Rest"
    assert leak.without_spans("Keep AİB This", [(1, 2)], 0.9) == "Keep B This"


CASES = {
    "<h2>Oil</h2>": {"heading"}, "# Oil": {"heading"}, "Oil prices\n-----": {"heading"}, "==Oil==": {"heading"}, "\\subsection*{Oil}": {"heading"},
    "<OL><LI>a<LI>b</OL>": {"list"}, "- a\n- b": {"list"}, "1. a\n2. b": {"list"}, "* [[a]]\n** b": {"list", "inline"},
    "\\begin{itemize}\n\\item a\n\\end{itemize}": {"list"}, "# [[a]]\n# b": {"list", "inline"},
    "```sql\nSELECT <b>\n```": {"code"}, "<pre>\n# x\n</pre>": {"code"}, "<source lang=\"sql\">a == b</source>": {"code"},
    "\\begin{verbatim}\n\\section{x}\n\\end{verbatim}": {"code"}, "~~~\nx\n~~~": {"code"},
    "$$a_{b} = 2$$": {"formula"}, "\\[ \\sum_i w_i \\]": {"formula"}, "<math><mi>x</mi></math>": {"formula"},
    "\\begin{equation}\nP_t\n\\end{equation}": {"formula"}, "so $\\mathrm{gain} = 3$ here": {"formula"},
    "a **bold** b": {"inline"}, "see [the\nword](/q/1)": {"inline"}, "![x](y.png)": {"inline"}, "~~no~~": {"inline"}, "__yes__ it": {"inline"},
    "'''bold'''": {"inline"}, "[[a|b]]": {"inline"}, "{{convert|1|x}}": {"inline"}, "a<ref>b</ref>": {"inline"}, "<!-- x -->": {"inline"},
    "a&nbsp;b": {"inline"}, "&#8220;x": {"inline"}, "a<br/>b": {"inline"}, "\\textbf{x}": {"inline"}, "x~\\cite{y}": {"inline"},
    "<span\nclass=\"t\">x</span>": {"inline"},
    "R&amp;D at Co cost 5 mln ~ 95 pct": set(), "Bids were <37 pct and asks >71": set(), "code 2_23_x and 5*54 lots [sic].": set(),
    "C:\\FEEDS\\NEW_X.TXT came -- again": set(), "Grade #2 fuel at $34 and $93 dlrs": set(), "(a) 39 pct; net = gross less": set(),
    "&lt;XYZ&gt;": set(), "<TITLE>Oil</TITLE>": set(), "sold\n- again at 5\nlots": set(), "worth\n12. It said": set(), "": set(),
}


@pytest.mark.parametrize("text,expected", CASES.items())
def test_structures(text, expected):
    assert set(markup.convert(text.split("\n"))[1]) == expected


def test_clean_text():
    text, _ = markup.convert("<TITLE>Oil</TITLE>\n<h2>A <b>B</b></h2>\nx &amp; [[y|z]]\n* a\n* b\n```\nif (a) {\n```\n$$q_1$$".split("\n"))
    assert text == "Oil\n\n# A B\n\nx & z\n- a\n- b\n\n```\nif (a) {\n```\n\n$$q_1$$"


def test_markup_of_any_depth_and_length():
    deep = "core"
    for k in range(9):
        deep = f"[[p{k}|{deep}]]"
    assert markup.convert([f"x {deep} y"]) == ("x core y", ["inline"])
    words = " ".join(["word"] * 1000)
    for mark in ("**", "__", "~~"):
        assert markup.convert([f"a {mark}{words}{mark} b"]) == (f"a {words} b", ["inline"])
        assert markup.convert([f"a {mark}{words} b"]) == (f"a {mark}{words} b", [])
    assert markup.convert(["a &unknown; b"]) == ("a &unknown; b", ["inline"])


def test_markup_table(spark, scratch):
    schema = "doc_id long, path string, text_lines array<string>, own string, kinds int, tokens int"
    page = lambda i, lines: (i, "f", lines, "x", 1, 1)
    rows = [page(i, [f"<TITLE>T{i}</TITLE>", "<DATELINE> X </DATELINE><BODY>text", "more"]) for i in range(20)]
    rows += [page(30, ["<TITLE>A</TITLE>", "<h1>x</h1>", None]), page(31, None), page(None, ["**x**"]), page(32, []), page(30, ["<TITLE>A</TITLE>", "<h1>x</h1>", None]), (33, None, ["**x** y"], "x", 1, 1)]
    frame = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, tuple(r.kinds)) for r in markup.markup(frame, scratch).collect()}
    assert got == {(30, ("heading",)), (33, ("inline",))}
    classes = {tuple(r.tokens) for r in markup.template_classes(markup._one_row_per_page(frame), scratch).where("path = 'f'").collect()}
    assert ("<DATELINE>", "</DATELINE>", "<BODY>") in classes
    assert markup.markup(frame.limit(0), scratch).count() == 0


def test_template_of_unknown_tags(spark, scratch):
    """Tags that nobody listed are learned from the pages and part the slots; crossing and reordered ones are none, and
    without the template the same page reads otherwise."""
    page = lambda i, lines, path="g": (i, path, lines)
    rows = [page(i, [f"<HEAD9>T{i}</HEAD9><STORY>", f"<SLUG>s{i}</SLUG> text</STORY>"]) for i in range(20)]
    rows += [page(50, ["<HEAD9>T</HEAD9><STORY># Oil", "more</STORY>"])]
    rows += [page(100 + i, ["<P1><P2>a</P1>b</P2>"], "crossing") for i in range(9)]
    rows += [page(200 + i, ["<Q1>a</Q1><Q2>b</Q2>" if i % 2 else "<Q2>b</Q2><Q1>a</Q1>"], "order") for i in range(9)]
    frame = spark.createDataFrame(rows + rows[:3], "doc_id long, path string, text_lines array<string>")
    classes = {(r.path, tuple(r.tokens), r.depth) for r in markup.template_classes(frame, scratch).collect()}
    assert classes == {("g", ("<HEAD9>", "</HEAD9>", "<STORY>", "</STORY>"), 0), ("g", ("<SLUG>", "</SLUG>"), 1)}
    assert {(r.doc_id, tuple(r.kinds)) for r in markup.markup(frame, scratch).collect()} == {(50, ("heading",))}
    assert markup.markup(frame, scratch, support=1.1).count() == 0


def test_long_texts_stay_fast():
    began = time.time()
    for text in ("[" * 20_000, "**x " * 20_000, "a" * 300_000, "<" * 50_000, "1 2 " * 40_000, "A. " * 20_000, "@" * 20_000, "a@" * 20_000, "{{" * 20_000, "\\(" * 3_000):
        markup.convert([text])
        pii.find(text, NAMES)
        leak.words(text)
    assert time.time() - began < 120


NAMES = pii.Names(frozenset({"Anna", "Tom"}), frozenset({"Berth"}))
PERSONAL = {
    "mail a.b+c@x-y.example.com now": [("a.b+c@x-y.example.com", "email")], "to desk-a (at) x (dot) example (dot) com for": [("desk-a (at) x (dot) example (dot) com", "email")],
    "j [at]\nx.example.org": [("j [at]\nx.example.org", "email")], "u @ x.example": [("u @ x.example", "email")], "write jo at mail dot example": [("jo at mail dot example", "email")],
    "\u0430nna@example.com": [("\u0430nna@example.com", "email")], "an\u200bna@example.com": [("an\u200bna@example.com", "email")],
    "Wheat @ 2.91 was bid, see @marketdesk": [],
    "on +44 20 7946 0660 now": [("+44 20 7946 0660", "phone")], "(415) 555-0177 ext. 12": [("(415) 555-0177 ext. 12", "phone")], "303.555.0161": [("303.555.0161", "phone")],
    "3035550157": [("3035550157", "phone")], "+33.1.99.00.74.99": [("+33.1.99.00.74.99", "phone")], "01 99 00 00 47": [("01 99 00 00 47", "phone")],
    "030/23125-552": [("030/23125-552", "phone")], "+4930 23125156": [("+4930 23125156", "phone")],
    "call three zero three five five five zero one five seven": [("three zero three five five five zero one five seven", "phone")],
    "fell from 212.555 to 211.782 on 12-03-2021": [], "Lot no. 775-93-397 was": [], "Lot no. 303-555-0161 was": [], "Ref. 9958/39, revision": [], "closed at 1,898.56": [],
    "SSN 920363187": [("SSN 920363187", "id_number")], "943-36-9635.": [("943-36-9635", "id_number")], "QQ 12 34 56 A": [("QQ 12 34 56 A", "id_number")],
    "QQ849068C": [("QQ849068C", "id_number")], "passport no. ZX5235657": [("passport no. ZX5235657", "id_number")], "Ausweis-Nr. T09338564": [("Ausweis-Nr. T09338564", "id_number")],
    "DNI 00003369-R": [("DNI 00003369-R", "id_number")], "n° INSEE 3 65 13 99 115 845 08": [("INSEE 3 65 13 99 115 845 08", "id_number")],
    "at 12 Oak Lane, X": [("12 Oak Lane", "address")], "791-793 W. Oak Ave": [("791-793 W. Oak Ave", "address")], "Flat 2, 194 Oak Road, X": [("Flat 2, 194 Oak Road", "address")],
    "au 720, avenue de Oak": [("720, avenue de Oak", "address")], "Oakstraße 120, X": [("Oakstraße 120", "address")], "Calle Oak 977": [("Calle Oak 977", "address")],
    "About 56 Oak Lane stalls traded": [], "The Oak Road terminal reopened": [],
    "from Anna Berth was": [("Anna Berth", "name")], "BERTH, Anna, who": [("BERTH, Anna", "name")], "Mr. Oak said": [("Mr. Oak", "name")], "by T. Oak.": [("T. Oak", "name")],
    "Anna-Tom C. Oak": [("Anna-Tom C. Oak", "name")], "Frau Oak sagte": [("Frau Oak", "name")],
    "Anna Oak Ltd bid": [], "Berth & Partners Ltd": [], "Berth chartered from": [], "the tanker Anna Oak": [], "": [],
}


@pytest.mark.parametrize("text,expected", PERSONAL.items())
def test_personal(text, expected):
    assert [(text[a:b], kind) for a, b, kind in pii.find(text, NAMES)] == expected


def test_long_gaps_cut_nothing():
    """Words and gaps of any length around digits and street names."""
    gap, name = " " * 90, "Oak" + "a" * 80
    for text, kind in ((f"passport{gap}no.{gap}ZX5235657", "id_number"), (f"at 12 {name} {name} Lane, X", "address"), (f"Flat 2,{gap}194{gap}Oak{gap}Road", "address"), (f"SSN{gap}920363187", "id_number")):
        (found,) = pii.find(text, NAMES)
        assert found[2] == kind and text[found[0] : found[1]] == text.removeprefix("at ").removesuffix(", X")


def test_redaction_keeps_the_rest():
    text = "Dear Anna Berth,\r\nwrite to j (at) x (dot) example\u200b or \u0441all 3035550157.\n"
    assert pii.redact(text, pii.find(text, NAMES)) == "Dear [NAME],\r\nwrite to [EMAIL]\u200b or \u0441all [PHONE].\n"


def test_personal_table(spark, monkeypatch):
    texts = [(1, "Mr. Nora Oak and Nora K. Elm met."), (2, "ELM, Nora said."), (3, "Nora Ash came. Nora Elm went."), (4, None), (5, ""), (None, "a@b.example"), (1, "Mr. Nora Oak and Nora K. Elm met."), (6, "nothing here")]
    frame = documents_of(spark, texts)
    names = spark.createDataFrame([("Anna", "given", 1), (None, "given", 1), ("Oak", None, 1)], "name_text string, kind string, doc_id int")
    got = {r.doc_id: r.text for r in pii.personal_information(frame, names).collect()}
    assert set(got) == {1, 2, 3} and got[3] == "[NAME] came. [NAME] went."
    assert pii.personal_information(frame.limit(0), names.limit(0)).count() == 0
    monkeypatch.setattr(pii, "MOST_NAMES", 2)  # more names than are sent to the executors
    assert {r.doc_id: r.text for r in pii.personal_information(frame, names).collect()} == got
    monkeypatch.undo()
    assert {r.doc_id for r in pii.personal_information(frame, names, learn=False).collect()} == {1}
