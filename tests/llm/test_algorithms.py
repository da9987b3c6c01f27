"""Splitting, near-duplicates, nearest vectors, repeated lines, tokens, leaks: exactness and edge cases."""

import json
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelode.llm import leakage, neardup, nearest, repeated, split, tokens


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------ splitting


def check_pieces(text, limit, overlap):
    pieces = split.split_text(text, limit, overlap)
    assert all(len(p) <= limit for p in pieces)
    assert pieces[0] + "".join(p[overlap:] for p in pieces[1:]) == text
    for a, b in zip(pieces, pieces[1:]):
        assert len(a) >= overlap and b.startswith(a[len(a) - overlap :])
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!\n。é🙂", max_size=400))
def test_split_round_trip(text):
    check_pieces(text, 40, 7)


@pytest.mark.parametrize("text", ["", "x", "a" * 1000, "a" * 1001, "a" * 30_000, "word " * 4_000, "s. " * 900, "line\n" * 700, "h\n\n" + "b" * 2_000])
def test_split_sizes(text):
    assert (len(check_pieces(text, 1_000, 50)) > 1) == (len(text) > 1_000)


def test_split_prefers_strong_boundaries():
    paragraphs = ["First part. " * 50, "Second part. " * 50, "Third part. " * 50]
    text = "\n\n".join(p.strip() for p in paragraphs)
    pieces = check_pieces(text, 1_000, 50)
    assert [p.endswith("\n\n") for p in pieces[:-1]] == [True] * (len(pieces) - 1)
    assert not any(re.search(r"\w$", p) for p in check_pieces("One two three four. " * 100, 1_000, 50)[:-1])


def test_split_rows(spark):
    df = spark.createDataFrame(
        [(1, "a" * 1001, "x"), (1, "a" * 1001, "x"), (2, None, "x"), (3, "", "x"), (4, "short", None)], "id long, content string, piece string"
    )
    assert rows(split.oversized(df)) == [(1, 2)]
    assert rows(split.split_rows(df).groupBy("id").count()) == [(1, 4), (3, 1), (4, 1)]
    assert rows(split.oversized(df.limit(0))) == [] == rows(split.split_rows(df.limit(0)))


# ------------------------------------------------------------------ near-duplicates


def brute_pairs(texts, size, least):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def edited_texts():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, i = {}, 0
    for _ in range(25):
        base = list(rng.choice(vocabulary, 60))
        for edits in (0, 0, 1, 3, 6, 12):
            own = list(base)
            for at in rng.integers(0, 60, edits):
                own[at] = rng.choice(vocabulary)
            texts[i] = " ".join(own)
            i += 1
    return texts


def test_near_duplicates_against_brute_force(spark):
    texts = edited_texts()
    df = spark.createDataFrame(list(texts.items()), "id long, content string")
    assert set(rows(neardup.duplicate_pairs(df, shingle=3, similarity=0.6))) == brute_pairs(texts, 3, 0.6)
    assert set(rows(neardup.duplicate_pairs(df))) == brute_pairs(texts, 5, 0.8)


def test_near_duplicate_groups_and_edges(spark):
    same = "one two three four five six seven"
    data = [(1, same), (2, same.upper() + "!"), (2, same.upper() + "!"), (3, same + " eight"), (4, "a b"), (5, "a b"), (6, None), (7, ""), (8, "z " * 50_000)]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in data], "id long, content string, key string, band int")
    got = {r["id"]: (r["class_id"], r["group_id"], r["n_links"]) for r in neardup.duplicate_groups(df, shingle=3, similarity=0.6).collect()}
    assert got[1] == (1, 1, 1) and got[2] == (1, 1, 1) and got[3] == (3, 1, 1)
    assert got[4] == (4, 4, 0) and got[5] == (4, 4, 0) and got[7] == (7, 7, 0) and 6 not in got
    assert rows(neardup.duplicate_pairs(df, shingle=3, similarity=0.6)) == [(1, 2), (1, 3), (2, 3)]
    assert rows(neardup.duplicate_pairs(df.limit(0))) == [] == rows(neardup.duplicate_groups(df.limit(0)))


def test_signature_estimate(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 400)]
    other = base[:200] + [f"v{i}" for i in rng.integers(0, 10_000, 100)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "key long, text string")
    signed = df.mapInPandas(neardup._signatures(1), neardup._SIGNED)
    a, b = signed.filter("key = 1"), signed.filter("key = 2").select(F.col("packed").alias("other"))
    got = a.join(b).select(neardup.estimate(F.col("packed"), F.col("other")).alias("x")).first()["x"]
    assert abs(got - len(set(base) & set(other)) / len(set(base) | set(other))) < 0.15


# ------------------------------------------------------------------ nearest vectors


def brute_nearest(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = (x @ x.T).round(6)
    np.fill_diagonal(score, -9)
    return {i: {ids[j] for j in np.lexsort((ids, -score[r]))[: min(k, len(ids) - 1)]} for r, i in enumerate(ids)}


def vector_table(spark, vectors):
    return spark.createDataFrame([(i, json.dumps(list(map(float, v)))) for i, v in vectors.items()], "id long, embedding string")


def nearest_of(df, **options):
    out = {}
    for r in nearest.nearest_neighbours(df, **options).collect():
        out.setdefault(r["id"], set()).add(r["near"])
    return out


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64))
    vectors = {i: (centres[i % 12] + 0.5 * rng.normal(size=64)).round(4) for i in range(2_500)}
    got, truth = nearest_of(vector_table(spark, vectors)), brute_nearest(vectors, 5)
    assert set(got) == set(vectors) and all(len(s) == 5 for s in got.values())
    assert np.mean([len(got[i] & truth[i]) / 5 for i in truth]) >= 0.9


def test_nearest_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=64).round(3) for i in range(20)}
    for i in range(100, 130):
        vectors[i] = vectors[3]
    vectors[200] = vectors[3] * 2  # another length, the same direction
    assert nearest_of(vector_table(spark, vectors)) == brute_nearest(vectors, 5)


def test_nearest_unusable(spark):
    good = [json.dumps([float(i == j) for j in range(64)]) for i in range(3)]
    bad = [None, "", "x", "[]", "[1]", json.dumps([0.0] * 64), "[" + ",".join(["NaN"] * 64) + "]", "[" + ",".join(["1e999"] * 64) + "]", json.dumps([None] + [1.0] * 63)]
    data = [(i, v, 1.0) for i, v in enumerate(good + good[:1] + bad)]
    df = spark.createDataFrame(data + data[:2], "id long, embedding string, score double")
    got = nearest_of(df)
    assert got == {0: {1, 2, 3}, 1: {0, 2, 3}, 2: {0, 1, 3}, 3: {0, 1, 2}}
    assert rows(nearest.neighbour_pairs(df.filter("id >= 4"))) == [] == rows(nearest.neighbour_pairs(df.limit(0)))
    assert rows(nearest.neighbour_pairs(df.filter("id = 0"))) == []


def test_nearest_split_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 32)
    rng = np.random.default_rng(7)
    vectors = {i: rng.normal(size=64).round(3) for i in range(150)}
    assert nearest_of(vector_table(spark, vectors)) == brute_nearest(vectors, 5)


def test_nearest_two_levels(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 25)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    vectors = {i: (centres[i % 40] + 0.5 * rng.normal(size=64)).round(4) for i in range(2_000)}
    index = nearest.fit_index(np.array(list(vectors.values()), np.float32)[:300], 2_000)
    assert len(index.first) == 37 and len(index.second) > 1  # more cells than a sample of 300 can fit in one level
    truth = brute_nearest(vectors, 5)
    got = nearest_of(vector_table(spark, vectors), sample_rows=300)
    assert np.mean([len(got[i] & truth[i]) / 5 for i in truth]) >= 0.95
    whole = nearest_of(vector_table(spark, vectors), sample_rows=300, probes=2_000, rerank=2_000)
    assert np.mean([len(whole[i] & truth[i]) / 5 for i in truth]) >= 0.9999


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    index = nearest.fit_index(x, 500)
    cells = index.cells(x, 1)[:, 0]

    def loss(beam):
        codes, norms = index.encode(x, cells, beam)
        made = index.centre(cells) + sum(index.books[m][codes[:, m]] for m in range(len(index.books)))
        assert np.allclose((made**2).sum(1), norms, rtol=1e-3, atol=1e-3)
        return ((x - made) ** 2).sum()

    assert loss(4) <= loss(1) + 1e-3


# ------------------------------------------------------------------ repeated lines


def brute_repeated(records, least=5, share=0.1):
    seen, sites = {}, {}
    for i, url, text in set(records):
        host = re.match(r"[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", url.lower()).group(1).removeprefix("www.")
        sites.setdefault(host, set()).add(i)
        for k, line in enumerate((text or "").split("\n") if text is not None else [], 1):
            norm = " ".join(line.lower().split())
            if norm:
                seen.setdefault((host, norm), []).append((i, k))
    return sorted(
        {p for (h, _), at in seen.items() if len({i for i, _ in at}) >= max(least, share * len(sites[h])) for p in at}, key=str
    )


def site_records():
    rng = np.random.default_rng(9)
    records = []
    for i in range(120):
        site = ["http://www.A.example:80", "https://a.example", "http://b.example"][i % 3]
        lines = [f"Body {rng.integers(1_000_000)} of its own text {rng.integers(1_000_000)}" for _ in range(3)]
        lines.insert(int(rng.integers(0, 3)), "Share  THIS page" if i % 2 else "share this page")
        if i % 3 == 2:
            lines.append(f"By Anna Smith, {i} May 2020")
        if i in (4, 7, 10, 13):
            lines.append("Only four records")
        records.append((i, site + f"/{i}", "\n".join([*lines, "", "  "])))
    records += [records[0], records[0], (500, "http://a.example/null", None), (501, "http://a.example/empty", "")]
    return records


def test_repeated_lines_against_brute_force(spark):
    records = site_records()
    df = spark.createDataFrame([(*r, "x") for r in records], "id long, url string, content string, site string")
    assert rows(repeated.repeated_lines(df, exact=True)) == brute_repeated(records)
    clusters = set(rows(repeated.repeated_lines(df)))
    assert clusters >= set(brute_repeated(records))
    assert len([p for p in clusters if p[0] % 3 == 2]) >= 40 + 40  # the masked bylines are one cluster


def test_without_repeated(spark):
    df = spark.createDataFrame(site_records(), "id long, url string, content string")
    got = dict(rows(repeated.without_repeated(df)))
    assert len(got) == 122 and got[500] is None and got[501] == ""
    assert not any("share this page" in " ".join((t or "").lower().split()) for t in got.values())


def test_repeated_edges(spark):
    df = spark.createDataFrame([(i, u, "same") for i, u in enumerate([None, "nohost", "http://x.example", "http://x.example/2"])], "id long, url string, content string")
    assert rows(repeated.repeated_lines(df, exact=True)) == [] == rows(repeated.repeated_lines(df.limit(0), exact=True))
    assert len(rows(repeated.without_repeated(df))) == 4


@pytest.mark.parametrize(
    ("a", "b"), [("By Anna Smith, 3 May 2020", "By Zoe Braun, 14 June 1999"), ("12 comments", "7 comments"), ("Rated 4.5 out of 5", "Rated 3.0 out of 5")]
)
def test_masks(a, b):
    assert repeated.masked_line(a) == repeated.masked_line(b)


# ------------------------------------------------------------------ tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")

SAMPLES = [
    "", None, " ", "\n\n\t", "Hello world", "Hello  world ", "can't won't it's", "<|endoftext|>", "naïve café", "日本語のテキスト。", "👩‍🔧 ok", "x" * 300,
    "a b c", "tab\tand  two", "1234567890 12", "Привет, мир!", "हमारी दुकान", "�", "aaaa bbbb aaaa", "def f(x):\n    return x + 1\n", "é",
]


@needs_vocabulary
def test_encode_is_the_library(spark):
    import base64

    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = tokens.PATTERN.removeprefix("(?U)")
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    data = [(i, t, "x") for i, t in enumerate(SAMPLES)]
    df = spark.createDataFrame(data + data[:5], "doc_id long, text string, ids string")
    for hot in (4, 10_000):
        got = tokens.encode_texts(df, hot_words=hot)
        assert got.count() == len(data) + 5
        for r in got.collect():
            text = SAMPLES[r["doc_id"]]
            assert list(r["ids"]) == (reference.encode_ordinary(text) if text else [])


@needs_vocabulary
@pytest.mark.parametrize(("window", "overlap"), [(tokens.WINDOW, tokens.OVERLAP), (96, 32), (24, 12)])
def test_long_words_are_the_library(spark, window, overlap):
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=tokens.PATTERN.removeprefix("(?U)"), mergeable_ranks=tokens.load_ranks(), special_tokens={})
    rng = np.random.default_rng(2)
    letters = lambda pool, n: "".join(rng.choice(list(pool), n))
    long = [
        letters("abcdefghijklmnopqrstuvwxyz", 5_000), letters("ACGT", 3_000), letters("ab", 2_000), "x" * 3_001, "the" * 900, letters("日本語のテキスト", 900),
        "-" * 2_000, "=-" * 700, "antidisestablishment" * 80, letters("aeiou", 1_500), "short", "é" * 800,
    ]
    df = spark.createDataFrame([(w, 1) for w in long], "word string, n long")
    got = {r["word"]: list(r["ids"]) for r in tokens.encode_distinct(df, window=window, overlap=overlap).collect()}
    assert got == {w: reference.encode_ordinary(w) for w in long}


@needs_vocabulary
def test_decode_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES) if t], "doc_id long, text string")
    both = tokens.encode_texts(df).join(df, "doc_id").select(tokens.decode_ids(F.col("ids")).alias("again"), "text")
    assert both.filter("again <> text or again is null").count() == 0
    assert rows(tokens.encode_texts(df.limit(0))) == []


# ------------------------------------------------------------------ leaks


def brute_leaks(docs, items, run=12):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, q in items:
        w = words(q)
        k = min(run, len(w))
        grams = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if k else set()
        for d, t in docs:
            x = words(t)
            if any(tuple(x[p : p + k]) in grams for p in range(len(x) - k + 1)) and k:
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(10)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    items = [(i, word(int(rng.integers(3, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "!!!"), (93, "solo")]
    docs = []
    for d in range(80):
        text = word(int(rng.integers(0, 300)))
        if d % 2:
            w = items[d % 30][1].split()
            n = int(rng.integers(1, len(w) + 1))
            at = int(rng.integers(0, len(w) - n + 1))
            text += " " + ", ".join(w[at : at + n]).upper() + " " + word(20)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "Solo"), (0, docs[0][1]), (103, docs[1][1])]
    truth = brute_leaks(docs, items)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, size int")
    i = spark.createDataFrame([(*x, "y") for x in items + items[:3]], "item_id long, text string, mark string")
    assert set(rows(leakage.leaks(d, i))) == truth and len(rows(leakage.leaks(d, i))) == len(truth)
    counts = dict(rows(leakage.leaked_items(d, i)))
    assert counts == {k: len({a for a, b in truth if b == k}) for k, _ in items}
    assert rows(leakage.leaks(d.limit(0), i)) == [] == rows(leakage.leaks(d, i.limit(0)))


def planted_lines(n_lines=4_000, n_pairs=60, size=12, vocabulary=2_000):
    """Random word sets of one site and pairs of them that differ in one word."""
    rng = np.random.default_rng(9)
    sets = [rng.choice(vocabulary, size, replace=False) for _ in range(n_lines)]
    pairs = []
    for i in range(n_pairs):
        near = sets[i].copy()
        near[rng.integers(size)] = vocabulary + i
        pairs.append((i, len(sets)))
        sets.append(near)
    return [repeated._word_sets([" ".join(f"w{x}" for x in s)])[0] for s in sets], pairs


def test_near_duplicate_lines_of_a_large_site(spark):
    # Unrelated lines of few different words, and 20 lines that five records each have with one word of their own.
    rng = np.random.default_rng(10)
    line = lambda ws: " ".join("w" + "".join(chr(97 + int(c)) for c in str(x)) for x in ws)
    texts = [[line(rng.choice(80, 12, replace=False)) for _ in range(150)] for _ in range(40)]
    planted = set()
    for group in range(20):
        base = list(rng.choice(80, 12, replace=False))
        for k in range(5):
            texts[(group + 8 * k) % 40].append(line(base[:6] + [1_000 + 10 * group + k] + base[7:]))
            planted.add(((group + 8 * k) % 40, len(texts[(group + 8 * k) % 40])))
    df = spark.createDataFrame([(i, "http://a.org/", "\n".join(x)) for i, x in enumerate(texts)], "id long, url string, content string")
    got = set(map(tuple, repeated.repeated_lines(df).collect()))
    assert len(got & planted) >= 0.97 * len(planted) and got <= planted


def test_bucket_links_against_brute_force():
    sets, pairs = planted_lines(n_lines=250, n_pairs=50, vocabulary=25)

    def parts(links):
        part = list(range(len(sets)))
        for a, b in links:
            part = [part[a] if p == part[b] else p for p in part]
        return {frozenset(i for i, q in enumerate(part) if q == p) for p in part}

    own = [set(s.tolist()) for s in sets]
    brute = [(a, b) for a in range(len(own)) for b in range(a) if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    assert set(pairs) <= {(b, a) for a, b in brute}
    assert parts(repeated.bucket_links(np.arange(len(sets)), sets, 0.8)) == parts(brute)


def test_bucket_links_are_all_pairs():
    own = [{"a", "b", "c", "d", "e", "f", "g", "h", "i", x} for x in "pqrst"]
    sets = [np.array(sorted(map(ord, s))) for s in own]
    assert sorted(map(sorted, repeated.bucket_links(np.arange(5), sets, 0.8))) == [[a, b] for a in range(5) for b in range(a + 1, 5)]


@pytest.mark.parametrize("grouped", [2_048, 4])
def test_clusters_do_not_depend_on_the_bucket(spark, monkeypatch, grouped):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(60)]
    lines = []
    for _ in range(6):
        base = list(rng.choice(words, 14, replace=False))
        for _ in range(12):
            own = list(base)
            own[int(rng.integers(14))] = str(rng.choice(words))
            lines.append(" ".join(own))
    forms = spark.createDataFrame([(1, i, int(rng.integers(1, 4)), 6, t) for i, t in enumerate(dict.fromkeys(lines))], "site long, form long, w long, need long, text string")
    want = set(rows(repeated.line_clusters(forms)))
    assert len(want) > 100
    monkeypatch.setattr(repeated, "PAIRED", 1)
    monkeypatch.setattr(repeated, "GROUPED", grouped)
    assert set(rows(repeated.line_clusters(forms))) == want


def test_a_form_may_come_in_parts(spark):
    # As the counts of files come: w in several rows, the text in some of them.
    parts = [(1, 7, 2, 5, "alpha beta gamma"), (1, 7, 2, 5, None), (1, 7, 1, 5, None), (1, 8, 4, 5, "one two three"), (1, 8, 0, 0, "one two three")]
    forms = spark.createDataFrame(parts, "site long, form long, w long, need long, text string")
    assert rows(repeated.line_clusters(forms)) == [(7, 7)]


def test_masks_of_many_lines_are_those_of_each():
    lines = ["By Anna, 12 May 2020", "", "12. Mai 2020 um 3", "on 2020-01-02 and 3", "2020年1月2日 Ana", "one two three four five 1.200,5", "one two three 4", "5,\u3000Bob"]
    for everywhere in (False, True):
        assert repeated.masked_lines(lines, everywhere) == [repeated.masked_line(line, everywhere) for line in lines]
    assert repeated.masked_lines(lines[:6], False) == ["by #n, #d", "", "#d um #", "on #d and #", "#d #n", "one two three four five #"]


def test_line_counts_for_each_form_of_its_spellings(spark):
    names = ["Anna Smith", "Zoe Braun", "Carl Weber", "Ida Lund", "Omar Haddad", "Nina Rossi", "Paul Martin", "Eva Novak", "Hugo Silva", "Lena Fischer"]
    lines = [f"By {n}, {i + 1} May 2020" for i, n in enumerate(names)]
    data = [(i, "http://a.org/", t) for i, t in enumerate(lines)] + [(10 + i, "http://a.org/", t.upper()) for i, t in enumerate(lines)]
    df = spark.createDataFrame(data, "id long, url string, content string")
    assert rows(repeated.repeated_lines(df)) == sorted([(i, 1) for i in range(20)], key=str)


def test_texts_of_one_id_count_once(spark):
    records = [(i // 2, "http://a.org/", f"Share this page\nown {i}" + "\nFollow us" * (i < 10)) for i in range(8)] + [(9, "http://a.org/", "Follow us")]
    df = spark.createDataFrame(records, "id long, url string, content string")
    assert rows(repeated.repeated_lines(df, exact=True)) == brute_repeated(records)


def test_repeated_line_of_several_spellings(spark):
    # Three records in each of two files, one spelling a file; the bound is five records.
    make = lambda i, line: (i, "http://a.org/", f"{line}\nown line {'abcdefgh'[i]} of this record")
    one = [make(i, "Share on Facebook") for i in range(3)]
    two = [make(i, "SHARE ON FACEBOOK") for i in range(3, 6)]
    parts = [spark.createDataFrame(x, "id long, url string, content string").coalesce(1) for x in (one, two)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1")  # each record is a batch of its own
    try:
        got = rows(repeated.repeated_lines(parts[0].unionByName(parts[1]), exact=True))
    finally:
        spark.conf.set(batch, before)
    assert [(i, 1) for i in range(6)] == [x for x in got if x[1] == 1]


def test_unrelated_long_lines_stay(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**7, n)) for n in np.linspace(60, 5_000, 50).astype(int)]
    df = spark.createDataFrame([(i, "http://a.org/", t) for i, t in enumerate(texts)], "id long, url string, content string")
    assert dict(rows(repeated.without_repeated(df))) == dict(enumerate(texts))


def test_lines_alike_only_once_masked(spark):
    towns = ["Oakford", "Elmwick", "Ashby", "Birchton", "Pineham", "Cedarly", "Rowanby", "Hazelton", "Willowmere", "Aldertown"]
    texts = [f"Weight: {i}.5 kg\nThe {t} shop at {t} road opens at {i}\nBy Anna {t}, {i + 1} May 2020" for i, t in enumerate(towns)]
    df = spark.createDataFrame([(i, "http://a.org/", t) for i, t in enumerate(texts)], "id long, url string, content string")
    got = dict(rows(repeated.without_repeated(df)))
    assert got == {i: "\n".join(t.split("\n")[:2]) for i, t in enumerate(texts)}  # only the bylines go
    everywhere = {p for p in rows(repeated.repeated_lines(df, mask_everywhere=True))}
    assert {(i, k) for i in range(10) for k in (1, 2, 3)} == everywhere


def test_hubs_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeated, "PAIRED", 1)
    monkeypatch.setattr(repeated, "GROUPED", 2)
    monkeypatch.setattr(repeated, "HUBS", 1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [f"notice {letters[i]} all goods of this shop are sold as seen with no return at any later time" for i in range(20)]
    df = spark.createDataFrame([(i, "http://a.org/", t) for i, t in enumerate(own)], "id long, url string, content string")
    assert {i for i, _ in rows(repeated.repeated_lines(df))} == set(range(20))


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_minima_of_all_sizes_in_one_pass(shingle):
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 4, 5, 12, 40, 11)]
    many = np.array([len(t) for t in texts])
    left = np.repeat(np.cumsum(many), many) - np.arange(many.sum())
    row = np.repeat(np.arange(len(texts)), many)
    for size, minima, starts in leakage._batch_minima(np.concatenate(texts), left, [1, 2, 3, 4, 5, 6, 9, 12], shingle):
        for k, text in enumerate(texts):
            own = np.unique(minima[row[starts] == k]).view(np.int64)
            assert np.array_equal(own, leakage._window_minima(text, size, shingle)), (size, k)


@pytest.mark.parametrize("exact", [True, False])
def test_lines_of_small_sites_are_clustered_in_one_task(spark, monkeypatch, exact):
    rng = np.random.default_rng(8)
    stems = [" ".join(f"w{x}" for x in rng.choice(60, int(rng.integers(1, 14)), replace=False)) for _ in range(25)]
    data = []
    for i in range(160):
        lines = [stems[k] + (f" {rng.integers(30)}x" if rng.random() < 0.4 else "") for k in rng.choice(25, 4)] + [f"only here {i}", "Seen 3 May 2020 By" if i % 2 else "seen 3 may 2020 by"]
        data.append((i - i % 10 // 9, f"http://www.s{i % 5 % 4}.example/{i}", None if i % 20 == 7 else "\n".join(lines)))
    df = spark.createDataFrame([*data, data[0], (500, None, "a\nb"), (501, "http://s9.example/", None)], "id long, url string, content string")
    spread, calls = repeated._spread_clusters, []
    monkeypatch.setattr(repeated, "_spread_clusters", lambda *x: calls.append(x) or spread(*x))
    want = None
    for most in (1 << 16, 150, 0):
        monkeypatch.setattr(repeated, "LOCAL", most)
        got = rows(repeated.repeated_lines(df, exact=exact))
        assert bool(calls) == (most < 1 << 16) and len(got) == len(set(got)) > 100
        want = want or got
        assert got == want


@pytest.mark.parametrize(("paired", "grouped"), [(64, 2048), (3, 2048), (2, 5)])
def test_links_of_a_task_against_brute_force(monkeypatch, paired, grouped):
    monkeypatch.setattr(repeated, "PAIRED", paired)
    monkeypatch.setattr(repeated, "GROUPED", grouped)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 14, int(rng.integers(1, 12)))).astype(np.int64) for _ in range(120)]
    keys = [rng.integers(0, 25, int(rng.integers(1, 4))) for _ in sets]
    keys = [np.unique(k) for k in keys]
    w, need = rng.integers(1, 4, 120), rng.integers(3, 40, 120)
    size = np.array([len(x) for x in sets])
    bits = [np.array([int(np.bitwise_or.reduce(np.int64(1) << x)) for x in sets]), np.zeros(120, np.int64)]
    one, two = repeated._site_links(np.concatenate(keys), np.repeat(np.arange(120), [len(k) for k in keys]), w, need, np.concatenate(sets), size, bits, 0.6)
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    want = {(a, b) for a in range(120) for b in range(120) if a != b and len(np.intersect1d(keys[a], keys[b])) and like(a, b) >= 0.6 - 1e-9}
    got = set(zip(one.tolist(), two.tolist()))
    centres = lambda links: {a for a in range(120) if w[a] + sum(w[b] for x, b in links if x == a) >= need[a]}
    assert len(got) == len(one) and got <= want and centres(got) == centres(want)
    assert {x for x in want if x[0] in centres(want)} <= got and want
