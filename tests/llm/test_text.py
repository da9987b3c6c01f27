"""Spelling, residue, main body, truncation: hand-made cases, held-out accuracy and edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelode.llm import body, residue, truncation
from sitelode.llm.canonical import canonical, folded_values, compare_key, normalise, respelled


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------ spelling


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("café", "café"), ("ＡＢＣ　１", "ABC 1"), ("\U0001d68a\U0001d6a0\U0001d68a\U0001d6a2", "away"), ("ﬁrewall", "firewall"),
        ("a​b­c⁠d﻿", "abcd"), ("a b c d", "a b c d"), ("pаper", "paper"), ("Vеrrіt", "Verrit"), ("Kora", "Kora"),
        ("＄６９", "$69"), ("Ⅷ", "VIII"), ("cafе́", "café"), ("стaл", "стал"),
    ],
)
def test_respelled(raw, expected):
    assert canonical(raw) == expected


@pytest.mark.parametrize(
    "text",
    [
        "", "plain text\n\twith lines", "5 m² ½ cup ™ … ① ℃", "“quotes” – dash — don’t", "зима winter сорока",
        "友達に教える！、。", "\U0001f469‍\U0001f527 ❤️", "خانه‌ها", "Σ β naïve", "हमारी",
    ],
)
def test_left_alone(text):
    assert canonical(text) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_canonical_is_idempotent(text):
    once = canonical(text)
    assert canonical(once) == once


def test_compare_key():
    assert compare_key("STRAßE  x") == compare_key("strasse x")


def test_respelled_rows(spark):
    data = [(1, "a b", "ok"), (1, "a b", "ok"), (2, None, None), (3, "", "x​y"), (4, "t", "ａ" * 100_000)]
    df = spark.createDataFrame([(*d, "z") for d in data], "id long, title string, content string, field string")
    assert rows(respelled(df, ["title", "content"])) == [(1, "title"), (3, "content"), (4, "content")]
    got = rows(normalise(df, ["title"]))
    assert len(got) == 5 and got[0][:2] == (1, "a b") and rows(normalise(df.limit(0), ["title"])) == [] == rows(respelled(df.limit(0), ["title"]))


# ------------------------------------------------------------------ residue

RESIDUE = [
    ("The {{ name }} keeps a cabinet.", 1), ("Costs %PRICE_TAG% today.", 1), ("${title}", 1), ("<%= page.heading %>", 1), ("Visit [insert city here] soon.", 1), ("XXX intro text XXX", 1),
    ("TODO: price", 1), ("##TITLE##", 1), ("@@hero_copy@@", 1), ("[object Object]", 1), ("{% block lead %}", 1), ("*|LEAD|*", 1), ("&lt;company&gt;", 1),
    ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", 2), ("Your sofa text goes here.", 2), ("This is sample text for the vase block.", 2), ("asdf asdf asdf qwer", 2),
    ("404 Not Found", 4), ("HTTP 503: Service Unavailable", 4), ("Access denied", 4), ("You need to enable JavaScript to run this app.", 4), ("Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", 4),
    ("Checking your browser before you continue. This takes a few seconds.", 4), ("Traceback (most recent call last):", 4), ("Página no encontrada", 4), ("Страница не найдена", 4), ("ただいまメンテナンス中です。", 4),
]
CLEAN = [
    "In the template you write {{ name }} where the survey of the buyer will appear, and it is filled in later.", "The guide to placeholders says that %CITY% is replaced by Lowick.",
    "A shell script reads ${HOME} first, so the baker should set it before a walk.", "Printers once set lorem ipsum dolor sit amet to judge a page before the copy was ready.",
    "Norra wrote about the night when error 503 woke every illustrator.", 'Searching for "page not found" in the log led Vik to 12 broken links.',
    "Our widgets also work when a visitor has JavaScript turned off, Tasis explains.", "Rooms from $40 to 500 guests.", "We moved 404 tables in May.", "", "Just text.",
]


def kinds(text):
    total = 0
    for _, label, _ in residue.page_units(text, {}):
        total |= label
    return total


@pytest.mark.parametrize(("text", "kind"), RESIDUE)
def test_residue_labels(text, kind):
    assert kinds(text) == kind
    assert kinds("A fine lantern.\n" + text + "\nMore text here today.") == kind


@pytest.mark.parametrize("text", CLEAN)
def test_clean_labels(text):
    assert kinds(text) == 0 == kinds("Line one.\n" + text)


def test_residue_records(spark):
    data = [(i, t) for i, (t, _) in enumerate(RESIDUE)] + [(100 + i, t) for i, t in enumerate(CLEAN)]
    data += [(200, None), (201, "  \n "), (202, "word " * 60_000), data[0]]
    df = spark.createDataFrame([(*d, 1) for d in data], "id long, content string, label int")
    assert dict(rows(residue.residue_records(df))) == {i: k for i, (_, k) in enumerate(RESIDUE)}
    left = residue.without_residue(df)
    assert left.columns == df.columns and {r["id"] for r in left.collect()} == {i for i, _ in data if i >= 100}
    assert rows(residue.residue_records(df.limit(0))) == []


def test_residue_is_carried_to_near_duplicates(spark):
    notice = "Your browser is too old to display this page properly with all of its many moving parts and pictures on it"
    far = "Sorry: " + "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun until the evening bell rings out loud"
    data = [(1, notice), (2, "Note - " + notice.replace("properly", "properly now")), (3, far)]
    got = dict(rows(residue.residue_records(spark.createDataFrame(data, "id long, content string"))))
    assert got.get(1) == 4 and 3 not in got


def example(tree, rng):
    """A random text that the parsed pattern matches."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "ANY":
            out += rng.choice("x ")
        elif op == "IN":
            out += example([rng.choice([x for x in arg if str(x[0]) != "NEGATE"])], rng)
        elif op == "RANGE":
            out += chr(rng.randint(*arg))
        elif op == "CATEGORY":
            out += {"CATEGORY_DIGIT": "7", "CATEGORY_NOT_WORD": " "}[str(arg)]
        elif op == "BRANCH":
            out += example(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            out += example(arg[-1], rng)
        elif op == "MAX_REPEAT":
            least, most, inner = arg
            out += "".join(example(inner, rng) for _ in range(rng.randint(least, min(most, least + 6))))
    return out


def test_notice_gate_lets_every_alternative_through():
    rng = random.Random(3)
    tree = re._parser.parse(residue.NOTICE.pattern, re.I)
    assert len(tree) == 1 and str(tree[0][0]) == "BRANCH"
    for branch in tree[0][1][1]:
        texts = {" ".join(example(branch, rng).split()) for _ in range(400)}
        texts = {t for t in texts if residue.NOTICE.fullmatch(t)}
        assert texts
        for text in texts:
            assert residue.label_sentence(text, residue._WORD.findall(text.lower())) == residue.ERROR, text
            assert residue._line_units(text)[0][1] == residue.ERROR, text


@pytest.mark.parametrize("text", ["This shop is currently being rebuilt.", "This store is temporarily paused.", "We are under heavy load.", "This site is under repair."])
def test_notices_of_common_words(text):
    assert kinds(text) == 4 == kinds("A fine lantern.\n" + text)
    assert residue._notice_within("A lantern " + text)


def near_sentences(n=1_500):
    """Sentences of 5 to 30 words and others with a word similarity of at least 0.8 to them."""
    rng = np.random.default_rng(12)
    seeds, others = [], []
    for size in rng.integers(5, 31, n):
        words = [f"w{x}y" for x in rng.choice(20_000, size, replace=False)]
        near = list(words)
        if size < 9:
            near.append("onemore")
        else:
            for k in rng.choice(size, max(1, size // 9 - 1), replace=False):
                near[k] = f"v{rng.integers(20_000)}y"
        seeds.append(words)
        others.append(near)
    return seeds, others


def test_residue_candidates_against_brute_force():
    seeds, others = near_sentences()
    like = [len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in zip(seeds, others)]
    assert min(like) >= 0.8
    one, two = residue.sim_hashes(seeds), residue.sim_hashes(others)
    keys = list(residue._table_keys(one))
    order = [np.argsort(k, kind="stable") for k in keys]
    a, b = residue.candidates(one, [k[o] for k, o in zip(keys, order)], order, two)
    assert (a == b).sum() >= 0.97 * len(seeds)


def test_residue_words_coded_once():
    texts = ["a b a 12 x9y", "", "² 3rd ½ 4²", "b a", "one two three four five six"]
    words = [residue._WORD.findall(t) for t in texts]
    sims, keys, n = residue._sims_and_keys(words)
    own, own_n = residue.own_keys([residue._word_set(t) for t in texts])
    assert n.tolist() == own_n.tolist() and sorted(keys.tolist()) == sorted(own.tolist())
    assert sims.tolist() == residue.sim_hashes([["0" if w.isdigit() else w for w in ws] for ws in words]).tolist()


def test_residue_search_misses_nothing_near(spark):
    letters = str.maketrans("0123456789", "abcdefghij")  # numbers are all one word
    seeds, others = ([[w.translate(letters) for w in ws] for ws in x] for x in near_sentences())
    one, two = residue.sim_hashes(seeds), residue.sim_hashes(others)
    near = np.bitwise_count((one ^ two).view(np.uint64)) <= residue.DISTANCE
    assert near.mean() >= 0.97
    keys, n = residue.own_keys([set(w) for w in others])
    ends = np.cumsum(n).tolist()
    frontier = [(i, s, " ".join(w)) for i, (s, w) in enumerate(zip(one.tolist(), seeds))]
    rest = [(10_000 + i, s, " ".join(w), keys[b - k : b].tolist()) for i, (s, w, b, k) in enumerate(zip(two.tolist(), others, ends, n.tolist()))]
    got = residue._near(
        spark.createDataFrame(frontier, "unit long, sim long, text string"), spark.createDataFrame(rest, "unit long, sim long, text string, keys array<int>")
    )
    assert {(r["a"], r["b"]) for r in got.collect()} >= {(int(i), 10_000 + int(i)) for i in np.flatnonzero(near)}


def test_residue_links_between_linked_sentences_join(spark):
    base = "Sorry, the page that you asked for {} is not {} the catalogue of this small shop in the old town by the harbour"
    data = [(i, base.format(x, "in")) for i, x in enumerate(("today", "here"))]
    # Alike, each near a notice; one speaks about such things.
    data += [(10, "Alas" + data[0][1][5:]), (11, "Alas" + data[1][1][5:] + " you see")]
    got = dict(rows(residue.residue_records(spark.createDataFrame(data, "id long, content string"))))
    assert got == {0: 4, 1: 4}


@pytest.mark.parametrize("few", [0, 32 << 20])
def test_residue_is_carried_along_a_chain(spark, monkeypatch, few):
    words = "click here to edit this heading and then add more lines about our small bakery".split()
    data = [(0, " ".join(words))]
    for i, k in enumerate((4, 0, 8, 9, 10, 11)):  # each is near the one before it and the one after it only
        words[k] = "vanorak" + "abcdef"[i]
        data.append((i + 1, " ".join(words)))
    written, write = [], residue.materialised
    monkeypatch.setattr(residue, "BROADCAST", few, raising=False)
    monkeypatch.setattr(residue, "materialised", lambda df: (written.append(df.columns), write(df))[1])
    got = dict(rows(residue.residue_records(spark.createDataFrame([*data, (20, "An oven is lit")], "id long, content string"))))
    assert got == {i: residue.FILL for i, _ in data}
    # A hop of few sentences passes over the rest once: it writes its pairs, the near ones and what is looked up next.
    if few:
        assert len(written) <= 8 + 4 * len(data)


@pytest.mark.parametrize("few", [0, 100])
def test_residue_components(spark, monkeypatch, few):
    monkeypatch.setattr(residue, "FEW_LINKS", few)
    links = spark.createDataFrame([(5, 4), (4, 9), (9, 5), (2, 7), (7, 3), (3, 9), (20, 21), (20, 21)], "a long, b long")
    assert rows(residue._components(links)) == sorted([(x, 2) for x in (2, 3, 4, 5, 7, 9)] + [(20, 20), (21, 20)], key=str)


def test_residue_of_one_other_word_is_carried(spark):
    notices = [f"Sorry, the page that you asked for {x} is not in the catalogue" for x in ("today", "here", "again", "now")]
    data = [(i, t) for i, t in enumerate(notices)] + [(10 + i, t.replace("Sorry", "Alas")) for i, t in enumerate(notices)]
    data += [(20, "The page that we read for a lantern is in the catalogue of the fair")]
    got = dict(rows(residue.residue_records(spark.createDataFrame(data, "id long, content string"))))
    assert got == {i: 4 for i in (0, 1, 2, 3, 10, 11, 12, 13)}


# ------------------------------------------------------------------ main body


def made_pages(n, seed):
    rng = np.random.default_rng(seed)
    nouns, names = ["lamp", "desk", "rug", "fence", "oven", "tile"], ["Anna", "Zoe", "Mika", "Ravi"]
    out = []
    for i in range(n):
        noun, name = rng.choice(nouns), rng.choice(names)
        title = f"Fine {noun} in Town{rng.integers(99)}"
        main = [title] + [f"The {rng.choice(nouns)} of {rng.choice(names)} weighs {rng.integers(99)} kilos and lasts for years." for _ in range(4)] + [f"Weight: {rng.integers(99)} kg"]
        noise = ["Home | About | Shop", f"By {name}, {rng.integers(1, 28)} May 20{rng.integers(10, 26)}", "We use cookies. OK", "Share this page", f"© 20{rng.integers(10, 26)} Site{i % 7}. All rights reserved."]
        lines = [(noise[0], 0), (noise[2], 0)] + [(m, 1) for m in main]
        lines.insert(int(rng.integers(3, 8)), (noise[1], 0))
        lines += [(noise[3], 0), ("", 0), (noise[4], 0)]
        out.append((i, title, lines))
    return out


def tables(spark, pages):
    raw = [(i, f"http://s{i % 7}.example/{i}", t, "\n".join(x for x, _ in ls), f"t{i}") for i, t, ls in pages]
    kept = [(f"http://s{i % 7}.example/{i}", f"t{i}", "\n".join(x for x, b in ls if b)) for i, t, ls in pages]
    return (
        spark.createDataFrame(raw, "id long, url string, title string, content string, scraped_at string"),
        spark.createDataFrame(kept, "url string, scraped_at string, content string"),
    )


def test_body_on_held_out_pages(spark):
    model = body.fit_from_kept(*tables(spark, made_pages(150, 1)))
    held = made_pages(80, 2)
    found = set(rows(body.boilerplate_lines(tables(spark, held)[0], model)))
    truth = {(i, k) for i, _, ls in held for k, (x, b) in enumerate(ls, 1) if x and not b}
    assert len(found & truth) / len(truth) > 0.97 and len(found & truth) / max(1, len(found)) > 0.97


def test_body_edges(spark):
    model = body.fit_from_kept(*tables(spark, made_pages(20, 1)))
    df = spark.createDataFrame(
        [(1, None, None, 0), (2, None, "", 0), (3, "t", "one line", 0), (4, None, "Share this page\nShare this page", 0), (4, None, "Share this page\nShare this page", 0), (5, "", "\n\n", 0), (6, None, "word\n" * 20_000, 0)],
        "id long, title string, content string, line_no int",
    )
    got = rows(body.boilerplate_lines(df.filter("id < 6"), model))
    assert len(got) == len(set(got)) and {i for i, _ in got} <= {4}
    assert rows(body.boilerplate_lines(df.limit(0), model)) == []
    assert body.boilerplate_lines(df.filter("id = 6"), model).count() <= 20_000
    empty = tables(spark, made_pages(2, 1))
    assert body.fit_from_kept(empty[0].limit(0), empty[1].limit(0)).weights.shape == (body.DIM,)


def brute_cut(odds, link):
    n = len(odds)
    best, value = None, None
    for code in range(1 << n):
        x = [(code >> i) & 1 for i in range(n)]
        cost = sum(max(0, o) * (1 - b) + max(0, -o) * b for o, b in zip(odds, x)) + sum(w for w, a, b in zip(link, x, x[1:]) if a != b)
        if value is None or cost < value - 1e-12:
            best, value = x, cost
    return best, value


def test_min_cut_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        odds, link = rng.normal(size=n), np.abs(rng.normal(size=n - 1))
        got = body.min_cut(odds, link).astype(int)
        cost = sum(max(0, o) * (1 - b) + max(0, -o) * b for o, b in zip(odds, got)) + sum(w for w, a, b in zip(link, got, got[1:]) if a != b)
        assert cost == pytest.approx(brute_cut(odds, link)[1])
    assert len(body.min_cut(np.zeros(0), np.zeros(0))) == 0


# ------------------------------------------------------------------ truncation

LIST = "• calm desk, $40\n• chic oven, 12 in stock\n- old lamp, Lowick\n"


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "OK", "$740", "oak-framed seedling", "All is well.", "He said “yes.”", "Done! 🙂", "これは本です。", LIST + "* fine rug, 3 in stock", "A rug.\nPrice: $40\nSKU BRAVO-12345",
        "Text here.\n— Anna, Lowick", "Text here.\nAnna\nHead of rugs, Lowick", "Code.\nfor (i = 0; i < 3; i++) { show(i); }", "x" * 200, "can't won't it's they'll", "Is it?", "One. (Two.)",
    ],
)
def test_complete_ends(text):
    assert truncation.judge_end(text) != truncation.CUT


@pytest.mark.parametrize(
    "text",
    [
        "All is well. The lamp of", "All is well. The la", "All is well. The la…", "All is well. We moved [...]", "All is well. We...", LIST + "* fine ru", LIST + "*", LIST + "* fine rug, 3 in st", LIST + "- x, $",
        "A rug.\nSKU BRAV", "Q: Is it?\nA:", "これは本です。それは机で", "Fine lamps Lowick\nWe measured", "All is well. One,", "All is well. (", "Code.\nfor (i = 0; i < 3; i++) { sho", "All is well.\nUn", "All is well.\nYour desk is safe with us: 66 modules a night watch the b",
    ],
)
def test_cut_ends(text):
    assert truncation.judge_end(text) == truncation.CUT


def test_hidden_limits(spark):
    rng = np.random.default_rng(11)
    word = lambda: "é" * int(rng.integers(2, 9))
    full = [" ".join(word() for _ in range(int(n))) + "." for n in rng.integers(20, 120, 80)]
    cut = [t if len(t.encode()) <= 400 else t.encode()[:400].decode(errors="ignore") for t in full]
    data = [(i, t, "bytes") for i, t in enumerate(cut)] + [(1000 + i, t, "free") for i, t in enumerate(full)]
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, source string, length int")
    limits = {(r["source"], r["measure"]): r["length"] for r in truncation.hidden_limits(df).collect()}
    assert ("bytes", "utf8") in limits and limits["bytes", "utf8"] in (399, 400) and not any(s == "free" for s, _ in limits)
    shares = {r["source"]: r for r in truncation.source_shares(df).collect()}
    assert shares["free"]["n_cut"] == 0 and shares["bytes"]["n_docs"] == 80
    assert shares["bytes"]["n_cut"] == sum(not t.endswith(".") for t in cut)


def test_truncation_edges(spark):
    data = [(1, None, "s"), (2, "", "s"), (3, "Well. The la", None), (3, "Well. The la", None), (4, "one two " * 30_000, "s"), (5, "Well.", None)]
    df = spark.createDataFrame([(*d, True) for d in data], "doc_id long, text string, source string, cut boolean")
    assert rows(truncation.truncated_documents(df)) == [(3,), (4,)]
    assert len(rows(truncation.truncated(df))) == 5
    assert rows(truncation.truncated(df.limit(0))) == [] == rows(truncation.source_shares(df.limit(0))) == rows(truncation.hidden_limits(df.limit(0)))
    assert {r["source"]: r["n_docs"] for r in truncation.source_shares(df).collect()} == {"s": 3, None: 2}


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("a\u061cb", "ab"), ("a\u2065b", "ab"), ("a\ufff3b", "ab"), ("a\u2800b", "a b"), ("\u2f08\u2f00", "人一"), ("\u0601", "\u0601"), ("\u00b5m", "\u03bcm")],
)
def test_ignorable_and_radicals(raw, expected):
    assert canonical(raw) == expected


def test_folded_values(spark):
    df = spark.createDataFrame([("Stra\u00dfe",), ("STRASSE",), ("STRASSE",), (None,), ("",)], "title string")
    assert sorted(map(tuple, folded_values(df, "title").collect())) == [("", "", 1), ("STRASSE", "strasse", 2), ("Stra\u00dfe", "strasse", 1)]


def test_a_slice_writes_each_sentence_once():
    texts = ["Page not found.\nNew: 5 lamps in the shop" for _ in range(5000)] + ["Sorry, we could not find it 日本。テスト。"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    got = pa.Table.from_batches(residue._unit_rows(iter([batch])))
    found = [(text, label) for text in texts for text, label, _ in residue.page_units(text, {})]
    assert got.column("label").to_pylist() == [label for _, label in found]
    shown = [x for x in got.column("text").to_pylist() if x]
    assert len(shown) == len(set(shown)) == len({text for text, _ in found})


def test_long_texts_are_sliced_by_bytes(monkeypatch):
    monkeypatch.setattr(residue, "SLICE", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["abcd", "efgh", "ij", "k" * 30, "", "l"]})
    assert [p.column("text").to_pylist() for p in residue._slices(batch)] == [["abcd", "efgh", "ij"], ["k" * 30], ["", "l"]]


def test_sentence_ends_by_either_pattern():
    for text in ("One. Two! Three: four", "a.b c", "Eins.\u00a0Zwei", "終わり。次。 Last? x", "no end", "x:  y"):
        assert [p for p in residue._sentences(text) if p] == [p for p in residue._SENTENCES.split(text) if p]


LINES = [
    "", "  ", "Plain words. And more: of it!  Last", "One.\tTwo", "Short. One.", "終わり。次。 Last? x", "Costs {{ a. b }} here today. More words follow.", "404 Not Found", "A café. Page not found.", "Cafés Sorry, we could not find it",
    "pаyment by card. Straße 5 ² m", "日本語、テスト！ＡＢＣ１", "x\x0by", "x\x00y. z", "한 one two three", "ΟΔΟΣ. ΟΔΟΣ 4²", "İstanbul sorry. Fehler 404: nein", "Lorem ipsum dolor sit amet consectetur. 12 345 6th", "---", "  Ray ID: 83a7 f. Then. ", "word " * 300,
]


def test_lines_in_one_spelling_all_at_once():
    from sitelode.llm.canonical import canonical_lines

    assert canonical_lines(LINES) == [canonical(x) for x in LINES] and canonical_lines([]) == []


def test_sentences_of_all_lines_at_once(monkeypatch):
    texts = ["\n".join(LINES), *LINES, "\n".join(LINES[::-1]), "A lantern We are under heavy load now. Zzz", ""]
    expected = [(i, text, label) for i, content in enumerate(texts) for text, label, _ in residue.page_units(content, {})]
    words = {text: own for content in texts for text, _, own in residue.page_units(content, {})}
    one_by_one = []
    monkeypatch.setattr(residue, "_units_of", one_by_one.append)
    got = pa.Table.from_batches(residue._unit_rows(iter([pa.RecordBatch.from_pydict({"id": range(len(texts)), "text": texts})])))
    assert not one_by_one and [(i, label) for i, _, label in expected] == list(zip(got.column("id").to_pylist(), got.column("label").to_pylist()))
    unit = dict(zip((text for _, text, _ in expected), got.column("unit").to_pylist()))
    masked = {text: tuple("0" if w.isdigit() and re.search(r"\d", text) else w for w in own) for text, own in words.items()}
    assert len(set(unit.values())) == len(set(masked.values())) == len({(unit[t], masked[t]) for t in unit})
    for text, sim, keys in zip(*(got.column(c).to_pylist() for c in ("text", "sim", "keys"))):
        if text is not None:
            sims, own, _ = residue._sims_and_keys([words[text]])
            assert sim == sims[0] and sorted(keys or []) == sorted(own.tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé́адΣω 1.²。！？:!\t\r\x0b ‍{}4日ア-하 "), max_size=30), max_size=6))
def test_sentences_of_any_lines_at_once(lines):
    from sitelode.llm.canonical import canonical_lines

    assert canonical_lines(lines) == [canonical(x) for x in lines]
    distinct = list(dict.fromkeys(lines))
    units = residue._Units(distinct, np.arange(0))
    for i, line in enumerate(distinct):
        own = units.of[units.begin[i] : units.begin[i] + units.size[i]].tolist()
        assert [(units.texts[u], int(units.labels[u]), units.words[units.codes[units.at[u] : units.at[u] + units.n[u]]].tolist()) for u in own] == residue._units_of(line)
