"""Operators, sources and pipelines on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelode.operators import answers, chunking, crawl, dedupe, search
from sitelode.operators.components import connected_components
from sitelode.operators.embedding import HashEmbedder, embed, embed_missing, load_embeddings
from sitelode.plans import catalogue, pipeline
from sitelode.schemas import CHUNKS, RAW_PAGES
from sitelode.session import release_materialised
from sitelode.sources import dumps, sqlite
from sitelode.sources.store import Store, decode_images


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (2, 1), (5, 6), (7, 7), (None, 9), (10, 11), (11, 12), (12, 13), (13, 14)], "a long, b long")
    assert dict(rows(connected_components(edges))) == {
        1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10,
    }
    assert rows(connected_components(edges.limit(0))) == []


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))]
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    seen = {x for p in pairs for x in p}
    assert dict(rows(connected_components(spark.createDataFrame(pairs, "a long, b long")))) == {x: find(x) for x in seen}


def test_distinct_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "x"), (None, "x")], "id long, t string")
    assert rows(dedupe.distinct_rows(df, "id")) == rows(df.distinct())
    assert rows(dedupe.distinct_rows(df.limit(0), "id")) == []


def test_upsert(spark):
    old = spark.createDataFrame([(1, "u", "x", "c1"), (2, "v", "y", "c2")], "id long, url string, t string, created string")
    new = spark.createDataFrame([(9, "u", "x2", "c9"), (8, "w", "z", "c8"), (7, "u", "x1", "c7")], old.schema)
    merged = dedupe.upsert(old, new, ["url"], ["id"], ["id", "created"])
    assert rows(merged) == [(1, "u", "x2", "c1"), (2, "v", "y", "c2"), (8, "w", "z", "c8")]
    assert rows(dedupe.upsert(merged, new, ["url"], ["id"], ["id", "created"])) == rows(merged)
    assert rows(dedupe.upsert(old.limit(0), new.limit(0), ["url"], ["id"])) == []


def test_replace_and_pickup(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page_id long, t string")
    new = spark.createDataFrame([(1, "n")], old.schema)
    assert rows(dedupe.replace_by_key(old, new, "page_id")) == [(1, "n"), (2, "c")]
    pages = spark.createDataFrame([(1,), (3,)], "id long")
    assert rows(dedupe.not_yet(pages, old, "id", "page_id")) == [(3,)]


def test_sentences_and_pieces():
    parts = ["a" * 600 + ".", "b" * 600 + ".", "c."]
    assert chunking.grow_pieces(parts, [True, True], 1000) == [parts[0] + " " + parts[1], "c."]
    assert chunking.grow_pieces(["x" * 1000, "y"], [True], 1000) == ["x" * 1000, "y"]
    assert chunking.semantic_split(["one."], HashEmbedder()) == ["one."]


def test_chunk_pages(spark):
    schema = "id long, title string, page_type string, content string"
    pages = spark.createDataFrame([(1, "Peace Patch", "blog", "One. Two. Three."), (2, " ", None, "x."), (3, None, None, ""), (4, None, None, None), (5, None, None, "y.")], schema)
    done = spark.createDataFrame([(5,)], "page_id long")
    made = chunking.chunk_pages(pages, HashEmbedder(), done, min_chars=1)
    got = made.orderBy("page_id", "chunk_index").collect()
    assert {r["page_id"] for r in got} == {1, 2}
    assert " ".join(r["content"] for r in got if r["page_id"] == 1) == "One. Two. Three."
    assert [r["section"] for r in got if r["page_id"] == 1][:2] == ["Peace Patch", "Peace Patch_part2"][: len([r for r in got if r["page_id"] == 1])]
    assert [r["section"] for r in got if r["page_id"] == 2] == [""]


def test_embed_missing(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "c", "[1.0]"), (3, None, None), (4, "d", "broken")], "id long, content string, embedding string")
    full = embed_missing(df, HashEmbedder(8))
    got = {r["id"]: r["embedding"] for r in full.collect()}
    assert got[2] == "[1.0]" and got[4] == "broken" and got[1].startswith("[") and got[3].startswith("[")
    assert {r["id"] for r in load_embeddings(full).collect()} == {1, 2, 3}


def index_of(spark, vectors, use_cosine=True):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, e array<double>")
    return search.build_index(df, "id", "e", use_cosine)


def test_search(spark):
    index = index_of(spark, [(1, 0), (0, 1), (2, 0), (0, 0)])
    assert [r["id"] for r in search.search(index, [1, 0], 10).collect()] == [0, 2, 1, 3]
    flat = index_of(spark, [(1, 0), (0, 1), (2, 0)], use_cosine=False)
    assert [(r["id"], r["score"]) for r in search.search(flat, [2, 0], 2, use_cosine=False).collect()] == [(2, 0.0), (0, -1.0)]
    assert search.search(index.limit(0), [1, 0], 3).collect() == []


def test_search_batch_is_search(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(60, 6)).round(2)
    index = index_of(spark, data)
    asked = index.filter("id < 5").select(F.col("id").alias("query_id"), "v")
    got = {}
    for r in search.search_batch(index, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i in range(5):
        assert got[i] == [r["id"] for r in search.search(index, list(data[i]), 4, digits=6).collect()]
    assert rows(search.search_batch(index, asked.limit(0), 4)) == []


def test_mmr():
    docs = np.array([(0.8, 0.6), (0.8, 0.6), (0.7, -0.714)])
    assert search.mmr_order(np.array([1.0, 0.0]), docs, 2) == [0, 2]
    assert search.mmr_order(np.array([1.0, 0.0]), docs, 9, 1.0) == [0, 1, 2]
    assert search.mmr_order(np.array([1.0, 0.0]), docs[:1], 3) == [0]


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("How much is the Peace Patch price", ["is-the-peace-patch", "the-peace-patch", "peace-patch"]), ("shop?", []), ("", []), (None, []),
        ("buy order cost", []), ("one two three four five", ["one-two-three-four-five", "two-three-four-five", "three-four-five", "four-five"]),
    ],
)
def test_slugs(spark, question, expected):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(search.slug_candidates(F.col("q")).alias("x")).first()["x"] == expected


def test_answers(spark):
    hits = spark.createDataFrame([(1, 2, "T2", "u2", "b" * 600, 0.5), (1, 1, None, "u1", "a", 0.9)], "query_id long, rank int, title string, url string, text string, score double")
    block = answers.context_blocks(hits).first()["context"]
    assert block == "-  | u1 (score: 0.9000)\na\n\n- T2 | u2 (score: 0.5000)\n" + "b" * 500
    questions = spark.createDataFrame([(1, "q1", "s"), (2, "q2", "none")], "query_id long, question string, session_id string")
    turns = spark.createDataFrame([("s", i, f"q{i}", f"a{i}") for i in range(1, 8)] * 2, "session_id string, turn long, question string, answer string")
    past = answers.history(turns)
    assert [t["turn"] for t in past.first()["history"]] == [3, 4, 5, 6, 7]
    got = {r["query_id"]: r["answer"] for r in answers.answers(questions, hits, past).collect()}
    assert got[2] == answers.NO_HITS and got[1].startswith("**Answer:**\nYou asked: q1") and "- T2 (u2)" in got[1]


def test_crawl(spark):
    site = {
        "http://e.com/": "<a href='/a'>a</a><a href='/a#x'>a</a><a href='http://o.com/'>o</a><a href='/f.pdf'>f</a>",
        "http://e.com/a": "<a href='/b/'>b</a><a href='/'>home</a>", "http://e.com/b": "<a href='/c'>c</a><a href='/bad'>bad</a>",
        "http://e.com/c": "<a href='/d'>d</a>", "http://e.com/d": "",
    }
    calls = spark.createDataFrame([("http://E.com",), ("http://e.com/",)], "url string")

    def fetch(url):
        return site[url]

    found = crawl.crawl(calls, fetch, attempts=1).collect()
    assert {(r["url"], r["depth"]) for r in found if r["error"] is None} == {
        ("http://e.com/", 0), ("http://e.com/a", 1), ("http://e.com/b", 2), ("http://e.com/c", 3),
    }
    assert {r["url"] for r in found if r["error"]} == {"http://e.com/bad"}


def test_retry():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise OSError("x")
        return "ok"

    assert crawl.with_retry(flaky, 2, sleep=lambda s: None) == "ok"
    with pytest.raises(OSError):
        crawl.with_retry(lambda: (_ for _ in ()).throw(OSError("y")), 2, sleep=lambda s: None)


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y"), (None, "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert rows(crawl.reach(edges, seeds)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(crawl.reach(edges.limit(0), seeds)) == [("a", 0)]


def test_dumps(spark, tmp_path):
    df = spark.createDataFrame([("http://e.com/a", "one line"), ("http://e.com/b", "two\nlines"), ("http://e.com/c", "")], "url string, content string")
    dumps.write_dumps(df, str(tmp_path / "d"))
    assert rows(dumps.read_dumps(spark, str(tmp_path / "d"))) == rows(df)


def test_sqlite(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}" if i % 3 else None) for i in range(50)], "id long, t string")
    sqlite.write_sqlite(df, str(tmp_path / "x.db"), "pages", batch=7)
    assert rows(sqlite.read_sqlite(spark, str(tmp_path / "x.db"), "pages", df.schema)) == rows(df)
    sqlite.write_sqlite(df.limit(0), str(tmp_path / "x.db"), "empty")
    assert rows(sqlite.read_sqlite(spark, str(tmp_path / "x.db"), "empty", df.schema)) == []


def raw_pages(spark):
    base = dict(meta_desc=None, links="[]", images="bad", page_type=None)
    data = [
        dict(base, id=1, url="http://e.com/a", title="A", content="Get in touch\nThe workshop opens at nine. Mail a@e.com", scraped_at="2025-01-01T00:00:00"),
        dict(base, id=2, url="http://e.com/b", title=None, content=None, scraped_at="2025-01-01T00:00:00"),
    ]
    return spark.createDataFrame([tuple(d[c] for c in RAW_PAGES.names) for d in data], RAW_PAGES)


def test_store_and_pipeline(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("pages") is None and rows(store.read("chunks", CHUNKS)) == []
    store.write("chunks", spark.createDataFrame([], CHUNKS))
    chunks = pipeline.build_site(store, raw_pages(spark), HashEmbedder(16))
    assert chunks.count() == 1 and chunks.first()["embedding"].startswith("[")
    page = store.cleaned_page("http://e.com/a").first()
    assert (page["content"], page["email"], page["page_type"], page["images"]) == ("The workshop opens at nine. Mail a@e.com", "a@e.com", "generic", "[]")
    again = pipeline.build_site(store, raw_pages(spark), HashEmbedder(16))
    assert again.count() == 1 and store.read("cleaned_pages").count() == 2
    assert pipeline.build_site(store, raw_pages(spark), HashEmbedder(16), force=True).count() == 1
    asked = spark.createDataFrame([(1, "when does the workshop open"), (2, "zzz")], "query_id long, question string")
    got = pipeline.answer_questions(asked, again, store.read("cleaned_pages"), HashEmbedder(16)).collect()
    assert len(got) == 2 and any("http://e.com/a" in r["answer"] for r in got)
    store.export("cleaned_pages", str(tmp_path / "out"), "csv")
    assert [decode_images(x) for x in (None, "x", "{}", '["a"]')] == [[], [], [], ["a"]]


def test_streaming(spark, tmp_path):
    from sitelode.streaming.ingest import first_of_each, ingest, stream_pages

    store = Store(spark, str(tmp_path / "s"))
    raw_pages(spark).write.parquet(str(tmp_path / "in"))
    query = ingest(first_of_each(stream_pages(spark, str(tmp_path / "in"))), store, str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert store.read("cleaned_pages").count() == 2
    raw_pages(spark).withColumn("title", F.lit("B")).withColumn("scraped_at", F.lit("2025-01-01T05:00:00")).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(first_of_each(stream_pages(spark, str(tmp_path / "in"))), store, str(tmp_path / "ck")).awaitTermination(120)
    got = store.read("pages").collect()
    assert len(got) == 2 and {r["title"] for r in got} == {"B"}


def test_embed_interface(spark):
    df = spark.createDataFrame([("a a b",), (None,), ("",)], "t string")
    got = [r["v"] for r in df.select(embed(F.col("t"), HashEmbedder(4), batch=1).alias("v")).collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1) and list(got[1]) == [0.0] * 4 == list(got[2])
    release_materialised()


def test_page_components_take_the_whole_table(spark):
    # sf0.001 of the test tables: every link counts, against union-find.
    root = "/root/testdata/sf0.001"
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in catalogue._graph(spark, root).collect():
        one, two = find(a), find(b)
        up[max(one, two)] = min(one, two)
    got = dict(map(tuple, catalogue.QUERIES["page_components"](spark, root).collect()))
    assert got == {x: find(x) for x in list(up)} and set(got) == set(up) and got


def test_prefilter_keeps_the_far_chunks_of_a_question(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(400)] + [(900, [-1.0, 0.2])], "id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id long, v array<double>")
    allowed = spark.createDataFrame([(1, i) for i in range(400)] + [(2, 900)], "query_id long, id long")
    got = search.search_allowed(vectors, asked, allowed, 3)
    assert rows(got.select("query_id", "rank", "id")) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 900)]


def test_store_without_a_complete_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("t", spark.range(1))
    (tmp_path / "t" / "v-000000000009-lost").mkdir()  # a job that ended before its mark of success
    assert store.read("t").count() == 1
    store.write("t", spark.range(2))
    assert store.read("t").count() == 2
    store.write("t", spark.range(3))
    store.vacuum("t", keep=1)
    assert store.read("t").count() == 3 and len([p for p in (tmp_path / "t").iterdir()]) == 2


def test_changed_pages_are_chunked_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    pipeline.build_site(store, raw_pages(spark), HashEmbedder(16))
    page = raw_pages(spark).filter("id = 1").withColumn("content", F.lit("The oven is cold."))
    chunks = pipeline.build_site(store, page, HashEmbedder(16))
    assert [r["content"] for r in chunks.collect()] == ["The oven is cold."]
    assert store.chunks_of(chunks.first()["page_id"]).first()["vector"] is not None and store.page("http://e.com/a").count() == 1


def test_slow_fetch_fails(spark):
    import time

    urls_table = spark.createDataFrame([("http://a/", 0), ("http://slow/", 0)], "url string, depth int")
    fetch = lambda u: time.sleep(30) if "slow" in u else "<p>x</p>"
    got = {r["url"]: r for r in crawl.fetch_pages(urls_table, fetch, attempts=1, timeout=0.5).collect()}
    assert got["http://a/"]["html"] and "TimeoutError" in got["http://slow/"]["error"]


def test_answer_without_titles(spark):
    hits = spark.createDataFrame([(1, 1, "T", "u", "x", 0.5), (1, 2, "S", None, "y", None)], "query_id long, rank int, title string, url string, text string, score double")
    asked = spark.createDataFrame([(1, "q")], "query_id long, question string")
    assert answers.answers(asked, hits, titles=False).first()["answer"] == "**Answer:** You asked: q\n\n**Sources:**\n- u"
    assert answers.context_blocks(hits).first()["context"] == "- T | u (score: 0.5000)\nx\n\n- S | \ny"
