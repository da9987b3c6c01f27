"""Queries over the test tables, each over whole tables, and their SQL equivalents.

``QUERIES`` maps a name to a function of (spark, folder); ``ORACLES`` maps the
same name to DuckDB SQL where SQL can express the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions import contacts, html, text, urls, vectors
from sitelode.operators import answers, chunking, crawl, dedupe, search
from sitelode.operators.components import connected_components
from sitelode.operators.embedding import HashEmbedder, embed, embed_missing, load_embeddings
from sitelode.plans import pipeline
from sitelode.session import materialised, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):  # noqa: ANN202
    def register(fn):  # noqa: ANN001, ANN202
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# ---------------------------------------------------------------- URLs

_PARTS_SQL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _sql_part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{_PARTS_SQL}', {group})"


def _sql_normal(url: str) -> str:
    path = rf"regexp_replace(regexp_replace({_sql_part(url, 3)}, ';[^/]*$', ''), '/+', '/', 'g')"
    path = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END"
    pairs = (
        f"list_filter(list_transform(list_filter(string_split({_sql_part(url, 4)}, '&'), lambda p: p <> ''),"
        " lambda p: {'k': url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))}),"
        " lambda p: p.k NOT IN ('gclid', 'fbclid', 'ref', 'referrer', '_hsenc', '_hsmi') AND NOT starts_with(p.k, 'utm_'))"
    )
    query = f"array_to_string(list_transform({pairs}, lambda p: p.k || '=' || p.v), '&')"
    scheme = f"CASE WHEN {_sql_part(url, 1)} = '' THEN 'http' ELSE lower({_sql_part(url, 1)}) END"
    return (
        f"({scheme}) || '://' || lower({_sql_part(url, 2)}) || ({path}) ||"
        f" CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"
    )


@_query(f"SELECT DISTINCT url, {_sql_normal('url')} AS normal FROM pages")
def url_normalize(spark: SparkSession, root: str) -> DataFrame:
    """Every url of pages and its one spelling."""
    return read_table(spark, root, "pages").select("url", urls.normalize_url(F.col("url")).alias("normal")).distinct()


@_query(f"SELECT {_sql_normal('url')} AS normal, min(id) AS first_id, count(DISTINCT id) AS n FROM pages GROUP BY 1")
def url_visited_dedup(spark: SparkSession, root: str) -> DataFrame:
    """The pages that are one by their normalised url: first id and number."""
    rows = read_table(spark, root, "pages").select("id", urls.normalize_url(F.col("url")).alias("normal"))
    return rows.groupBy("normal").agg(F.min("id").alias("first_id"), F.count_distinct("id").alias("n"))


_PATH = f"lower({_sql_part('url', 3)})"


@_query(
    f"""SELECT DISTINCT id, CASE WHEN {_PATH} LIKE '%blog%' OR {_PATH} LIKE '%article%' OR {_PATH} LIKE '%post%' THEN 'blog'
        WHEN {_PATH} LIKE '%product%' OR {_PATH} LIKE '%item%' OR {_PATH} LIKE '%shop%' THEN 'product'
        WHEN {_PATH} IN ('', '/', '/home') THEN 'homepage' ELSE 'generic' END AS kind FROM pages"""
)
def page_type(spark: SparkSession, root: str) -> DataFrame:
    """The page type that the url of each record shows."""
    return read_table(spark, root, "pages").select("id", urls.page_type(F.col("url")).alias("kind")).distinct()


_ENDINGS = "|".join(urls.NON_PAGE_ENDINGS)
_LINKS_SQL = """SELECT DISTINCT id, url, unnest(from_json(links, '["VARCHAR"]')) AS link FROM pages"""
_HOST = "regexp_replace(lower({}), '^www\\.', '')"


def _links(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "pages").select("id", "url", "links")
    return rows.select("id", "url", F.explode(F.from_json("links", "array<string>")).alias("link")).distinct()


@_query(
    f"""WITH l AS ({_LINKS_SQL})
    SELECT id, link, coalesce({_HOST.format(_sql_part('link', 2))} = {_HOST.format(_sql_part('url', 2))}
             AND lower({_sql_part('link', 1)}) IN ('http', 'https'), false) AS internal,
           NOT (lower({_sql_part('link', 3)}) LIKE '%/wp-content/uploads/%')
             AND NOT regexp_matches(lower({_sql_part('link', 3)}), '\\.(?:{_ENDINGS})$') AS is_page FROM l"""
)
def link_predicates(spark: SparkSession, root: str) -> DataFrame:
    """Whether each stored link is an internal one, and one of a page."""
    return _links(spark, root).select(
        "id", "link", urls.is_internal(F.col("link"), F.col("url")).alias("internal"), urls.is_page_url(F.col("link")).alias("is_page")
    )


@_query(
    f"""WITH l AS ({_LINKS_SQL})
    SELECT id, link, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
        WHEN starts_with(link, '/') THEN {_sql_part('url', 1).replace("regexp_extract(", "lower(regexp_extract(", 1)}) || '://' || {_sql_part('url', 2)} || link END AS full_url FROM l
    WHERE regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(link, '/')"""
)
def links_absolute(spark: SparkSession, root: str) -> DataFrame:
    """Every rooted or whole link resolved against its page."""
    rows = _links(spark, root).filter(F.col("link").rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|/)"))
    return rows.select("id", "link", urls.absolute_url("link", "url").alias("full_url"))


def _graph(spark: SparkSession, root: str) -> DataFrame:
    """Edges between normalised urls of pages, over their stored links, within a site."""
    full = _links(spark, root).select(
        urls.normalize_url(F.col("url")).alias("src"), "url", urls.absolute_url("link", "url").alias("full")
    )
    kept = full.filter(urls.is_internal(F.col("full"), F.col("url")) & urls.is_page_url(F.col("full")))
    return kept.select("src", urls.normalize_url(F.col("full")).alias("dst")).distinct()


_FULL_SQL = (
    "CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link "
    f"ELSE lower({_sql_part('url', 1)}) || '://' || {_sql_part('url', 2)} || link END"
)


@_query(
    f"""WITH RECURSIVE l AS ({_LINKS_SQL}),
    f AS (SELECT url, {_FULL_SQL} AS full_url FROM l),
    e AS (SELECT DISTINCT {_sql_normal('url')} AS src, {_sql_normal('full_url')} AS dst FROM f
          WHERE {_HOST.format(_sql_part('full_url', 2))} = {_HOST.format(_sql_part('url', 2))}
            AND NOT regexp_matches(lower({_sql_part('full_url', 3)}), '\\.(?:{_ENDINGS})$')),
    seeds AS (SELECT DISTINCT src AS url FROM e JOIN (SELECT {_sql_normal('url')} AS u, min(id) AS i FROM pages GROUP BY 1) p ON p.u = e.src
              WHERE i IN (SELECT min(id) FROM pages GROUP BY {_HOST.format(_sql_part('url', 2))})),
    walk AS (SELECT url, 0 AS depth FROM seeds
             UNION SELECT e.dst, walk.depth + 1 FROM walk JOIN e ON e.src = walk.url WHERE walk.depth < 3)
    SELECT url, min(depth)::INT AS depth FROM walk GROUP BY url"""
)
def crawl_bfs(spark: SparkSession, root: str) -> DataFrame:
    """Urls within three links of the first page of each host, with their depth."""
    edges = materialised(_graph(spark, root))
    pages = read_table(spark, root, "pages").select("id", "url")
    firsts = pages.groupBy(urls.bare_host(F.col("url")).alias("host")).agg(F.min_by("url", "id").alias("url"))
    seeds = firsts.select(urls.normalize_url(F.col("url")).alias("url")).join(edges.select(F.col("src").alias("url")).distinct(), "url", "left_semi")
    return crawl.reach(edges, seeds)


# ---------------------------------------------------------------- HTML


def _as_html(spark: SparkSession, root: str) -> DataFrame:
    """Records of pages set as HTML with a menu, a script and a footer around the content."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = read_table(spark, root, "pages").select("id", "title", "content", "links").distinct()
    return rows.select(
        "id",
        F.concat(
            F.lit("<!doctype html><html><head><title>"), esc(F.col("title")), F.lit("</title><meta name='description' content='about "), F.col("id").cast("string"),
            F.lit("'><script>var a = \"</p>\";</script></head><body><nav><a href='/menu'>Menu</a></nav><p>"), esc(F.col("content")),
            F.lit("</p><a href='/more'>more</a><img src='/i.png'><footer><a href='/foot'>Imprint</a></footer></body></html>"),
        ).alias("html"),
    )


@_query(
    r"""SELECT DISTINCT id, regexp_replace(coalesce(title, ''), '^[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS title,
        'about ' || id AS meta_desc, '/more' AS links, '/i.png' AS images FROM pages"""
)
def html_fields(spark: SparkSession, root: str) -> DataFrame:
    """Title, description, links and images read back from HTML."""
    rows = _as_html(spark, root).select("id", html.extract("html").alias("f")).select("id", "f.*")
    return rows.select("id", "title", "meta_desc", F.array_join("links", " ").alias("links"), F.array_join("images", " ").alias("images"))


@_query("SELECT DISTINCT id, '/menu /more /foot' AS hrefs FROM pages")
def html_all_links(spark: SparkSession, root: str) -> DataFrame:
    """Every href, menus and footers too."""
    return _as_html(spark, root).select("id", F.array_join(html.all_hrefs(F.col("html")), " ").alias("hrefs"))


@_query()
def html_text(spark: SparkSession, root: str) -> DataFrame:
    """The visible text read back from HTML."""
    return _as_html(spark, root).select("id", html.extract("html")["content"].alias("content"))


# ---------------------------------------------------------------- text

_SPACE_SQL = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM_SQL = rf"regexp_replace(LINE, '^{_SPACE_SQL}+|{_SPACE_SQL}+$', '', 'g')"
_LINES_SQL = (
    "list_filter(list_transform(regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x{85}\\x{2028}\\x{2029}]'), lambda l: "
    + _TRIM_SQL.replace("LINE", "l") + "), lambda l: l <> '')"
)
_PHRASE_SQL = "(?i)(?:^|[^\\p{L}\\p{N}\\p{M}_])(?:" + "|".join(p for p in text.PHRASES if "©" not in p) + ")(?:$|[^\\p{L}\\p{N}\\p{M}_])"
_COPYRIGHT_SQL = "[\\p{L}\\p{N}\\p{M}_]©\\s?\\d{4}(?:$|[^\\p{L}\\p{N}\\p{M}_])"
_HAS_SQL = f"(regexp_matches(l, '{_PHRASE_SQL}') OR regexp_matches(l, '{_COPYRIGHT_SQL}'))"


@_query(
    f"""WITH r AS (SELECT DISTINCT id, content FROM pages WHERE content IS NOT NULL)
    SELECT id, len({_LINES_SQL})::INT AS n_lines,
           len(list_filter({_LINES_SQL}, lambda l: {_HAS_SQL}))::INT AS with_phrase,
           len(list_filter({_LINES_SQL}, lambda l: {_HAS_SQL} AND length(l) < 120))::INT AS dropped FROM r"""
)
def boilerplate_hits(spark: SparkSession, root: str) -> DataFrame:
    """Lines of each record, those with a boilerplate phrase and those that are dropped."""
    rows = read_table(spark, root, "pages").select("id", "content").filter("content is not null").distinct()
    lined = rows.select("id", text.text_lines(F.col("content")).alias("ls"))
    return lined.select(
        "id", F.size("ls").alias("n_lines"), F.size(F.filter("ls", text.has_phrase)).alias("with_phrase"),
        F.size(F.filter("ls", text.drops_line)).alias("dropped"),
    )


@_query()
def cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Raw pages through the whole cleaning transform."""
    return pipeline.clean(read_table(spark, root, "pages").distinct(), now="2025-01-01 00:00:00")


_KEYWORD_SQL = "|".join(text.SECTION_KEYWORDS)
_HEADING_SQL = f"""(regexp_matches(lower(l), '{_KEYWORD_SQL}') OR (length(l) <= 100
    AND len(list_filter(regexp_split_to_array(l, '{_SPACE_SQL}+'), lambda w: regexp_matches(w, '^[\\p{{Lu}}\\p{{Lt}}]'))) BETWEEN 1 AND 6))"""
_NAME_SQL = (
    "CASE " + " ".join(f"WHEN contains(lower(l), '{k}') THEN '{k.replace(' ', '_')}'" for k in text.SECTION_KEYWORDS)
    + " WHEN trim(regexp_replace(lower(l), '[^a-z0-9]+', '_', 'g'), '_') <> '' THEN trim(regexp_replace(lower(l), '[^a-z0-9]+', '_', 'g'), '_') ELSE 'section' END"
)


@_query(
    f"""WITH r AS (SELECT DISTINCT id, content FROM cleaned_pages WHERE content IS NOT NULL),
    ls AS (SELECT id, {_LINES_SQL} AS x FROM r),
    lines AS (SELECT id, unnest(x) AS l, unnest(range(len(x))) AS pos FROM ls),
    flagged AS (SELECT id, l, pos, {_HEADING_SQL} AS h FROM lines),
    grouped AS (SELECT *, sum(h::INT) OVER (PARTITION BY id ORDER BY pos) AS g, max(h::INT) OVER (PARTITION BY id) AS any_h FROM flagged)
    SELECT id, (row_number() OVER (PARTITION BY id ORDER BY g) - 1)::INT AS pos,
           CASE WHEN max(any_h) = 0 THEN 'main' WHEN g = 0 THEN 'intro' ELSE max(CASE WHEN h THEN {_NAME_SQL} END) END AS section,
           coalesce(string_agg(CASE WHEN NOT h THEN l END, chr(10) ORDER BY pos), '') AS content
    FROM grouped GROUP BY id, g"""
)
def section_slices(spark: SparkSession, root: str) -> DataFrame:
    """The sections of every cleaned page."""
    rows = read_table(spark, root, "cleaned_pages").select("id", "content").filter("content is not null").distinct()
    return rows.select("id", F.inline(text.sections(F.col("content"))))


@_query(
    r"""WITH r AS (SELECT DISTINCT id, coalesce(content, '') AS t FROM pages),
    d AS (SELECT id, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\[email\s*protected\]', 'email@example.com', 'gi'),
            '\s*[\[(]at[\])]\s*', '@', 'gi'), '\s*[\[(]dot[\])]\s*', '.', 'gi'), '(^|[^\p{L}\p{N}_])email\s+at\s+', '\1email@', 'gi'), '(^|[^\p{L}\p{N}_])dot($|[^\p{L}\p{N}_])', '\1.\2', 'gi') AS s FROM r)
    SELECT id, lower(nullif(regexp_extract(s, '([a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+)', 1), '')) AS email FROM d"""
)
def emails_first(spark: SparkSession, root: str) -> DataFrame:
    """The first e-mail address in each record's content."""
    rows = read_table(spark, root, "pages").select("id", "content").distinct()
    return rows.select("id", contacts.first_email(F.col("content")).alias("email"))


@_query(
    r"""WITH r AS (SELECT DISTINCT id, coalesce(content, '') AS t FROM pages),
    c AS (SELECT id, regexp_extract_all(t, '(\+?\d[\d\-\s().]{6,}\d)', 1) AS f FROM r),
    e AS (SELECT id, unnest(f) AS c, unnest(range(len(f))) AS i FROM c),
    b AS (SELECT id, starts_with(c, '+') AS plus, regexp_replace(c, '\D', '', 'g') AS d,
                 row_number() OVER (PARTITION BY id ORDER BY length(regexp_replace(c, '\D', '', 'g')) DESC, i) AS n FROM e)
    SELECT r.id, CASE WHEN plus THEN '+' || d WHEN length(d) BETWEEN 11 AND 15 THEN '+' || d WHEN length(d) BETWEEN 8 AND 10 THEN d END AS phone
    FROM r LEFT JOIN b ON b.id = r.id AND n = 1"""
)
def phones_best(spark: SparkSession, root: str) -> DataFrame:
    """The telephone number of each record's content."""
    rows = read_table(spark, root, "pages").select("id", "content").distinct()
    return rows.select("id", contacts.phone(F.col("content")).alias("phone"))


# ---------------------------------------------------------------- chunks and tables


@_query(
    rf"""WITH r AS (SELECT DISTINCT id, content FROM cleaned_pages WHERE content IS NOT NULL),
    s AS (SELECT id, string_split(regexp_replace(content, '([.?!]){_SPACE_SQL}+', '\1' || chr(1), 'g'), chr(1)) AS x FROM r)
    SELECT id, unnest(range(len(x)))::INT AS pos, unnest(x) AS sentence FROM s"""
)
def sentence_split(spark: SparkSession, root: str) -> DataFrame:
    """The sentences of every cleaned page."""
    rows = read_table(spark, root, "cleaned_pages").select("id", "content").filter("content is not null").distinct()
    return rows.select("id", F.posexplode(chunking.sentences(F.col("content"))).alias("pos", "sentence"))


@_query(
    """WITH d AS (SELECT label, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS x FROM embeddings),
    t AS (SELECT label, vec_id, x, quantile_cont(x, 0.95) OVER (PARTITION BY label) AS q FROM d)
    SELECT label, vec_id, round(x, 6) AS distance, x > q AS is_break FROM t WHERE x IS NOT NULL"""
)
def breakpoints(spark: SparkSession, root: str) -> DataFrame:
    """Distances between neighbouring vectors of a label, and those beyond its 95th percentile."""
    rows = read_table(spark, root, "embeddings")
    found = chunking.breakpoints(rows, "label", "vec_id", "embedding")
    return found.select("label", "vec_id", F.round("distance", 6).alias("distance"), "is_break")


@_query()
def chunk_semantic(spark: SparkSession, root: str) -> DataFrame:
    """Semantic chunks of the pages that have none yet."""
    pages = read_table(spark, root, "cleaned_pages").distinct()
    return chunking.chunk_pages(pages, HashEmbedder(), read_table(spark, root, "chunks"))


@_query("SELECT DISTINCT id, url FROM cleaned_pages p WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.page_id = p.id)")
def unchunked_anti(spark: SparkSession, root: str) -> DataFrame:
    """Cleaned pages without chunks."""
    pages = read_table(spark, root, "cleaned_pages").select("id", "url").distinct()
    return dedupe.not_yet(pages, read_table(spark, root, "chunks"), "id", "page_id")


@_query("SELECT DISTINCT id, page_id FROM chunks WHERE embedding IS NULL")
def unembedded(spark: SparkSession, root: str) -> DataFrame:
    """Chunks whose embedding is still to be made."""
    return read_table(spark, root, "chunks").filter("embedding is null").select("id", "page_id").distinct()


@_query()
def embed_chunks(spark: SparkSession, root: str) -> DataFrame:
    """All chunks, the missing embeddings made."""
    rows = read_table(spark, root, "chunks").select("id", "content", "embedding").distinct()
    return embed_missing(rows, HashEmbedder())


@_query(
    """WITH v AS (SELECT DISTINCT id, TRY_CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE embedding IS NOT NULL AND starts_with(trim(embedding), '[') AND json_valid(embedding))
    SELECT id, len(e)::INT AS dim, round(coalesce(list_sum(e), 0), 3) AS total FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""
)
def embedding_json_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Stored vectors read, written as JSON and read again: length and sum."""
    rows = load_embeddings(read_table(spark, root, "chunks").select("id", "embedding").distinct())
    again = rows.select("id", vectors.parse_vector(vectors.vector_json(F.col("v"))).alias("v"))
    finite = again.filter(~F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return finite.select("id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@_query(
    """WITH p AS (SELECT DISTINCT * FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC, id DESC) AS n FROM p)
    SELECT id, url, title, scraped_at FROM r WHERE n = 1"""
)
def upsert_pages(spark: SparkSession, root: str) -> DataFrame:
    """All scrapes merged into one row per url: the newest wins."""
    rows = read_table(spark, root, "pages").distinct()
    merged = dedupe.upsert(rows.limit(0), rows, ["url"], ["scraped_at", "id"])
    return merged.select("id", "url", "title", "scraped_at")


@_query(
    """WITH old AS (SELECT DISTINCT id, url, page_type, title, created_at, updated_at FROM cleaned_pages),
    fresh AS (SELECT id, url, coalesce(page_type, 'generic') AS page_type, title, scraped_at AS created_at, scraped_at AS updated_at,
              row_number() OVER (PARTITION BY url, coalesce(page_type, 'generic') ORDER BY scraped_at DESC, id DESC) AS n FROM (SELECT DISTINCT * FROM pages)),
    new AS (SELECT * FROM fresh WHERE n = 1)
    SELECT coalesce(old.id, new.id) AS id, coalesce(new.url, old.url) AS url, coalesce(new.page_type, old.page_type) AS page_type,
           CASE WHEN new.url IS NULL THEN old.title ELSE new.title END AS title,
           coalesce(old.created_at, new.created_at) AS created_at, coalesce(new.updated_at, old.updated_at) AS updated_at
    FROM old FULL JOIN new ON old.url = new.url AND old.page_type = new.page_type"""
)
def upsert_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Cleaned pages with all scrapes merged in by (url, page_type); ids and creation times kept."""
    cols = ["id", "url", "page_type", "title", "created_at", "updated_at"]
    old = read_table(spark, root, "cleaned_pages").select(cols).distinct()
    new = read_table(spark, root, "pages").distinct().select(
        "id", "url", F.coalesce("page_type", F.lit("generic")).alias("page_type"), "title",
        F.col("scraped_at").alias("created_at"), F.col("scraped_at").alias("updated_at"),
    )
    return dedupe.upsert(old, new, ["url", "page_type"], ["updated_at", "id"], ["id", "created_at"])


@_query(
    """WITH c AS (SELECT DISTINCT id, url, page_type, updated_at FROM cleaned_pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY updated_at DESC, id DESC) AS n FROM c)
    SELECT id, url, page_type, updated_at FROM r WHERE n = 1"""
)
def latest_by_key(spark: SparkSession, root: str) -> DataFrame:
    """The version of each cleaned url that was updated last."""
    rows = read_table(spark, root, "cleaned_pages").select("id", "url", "page_type", "updated_at").distinct()
    return dedupe.latest(rows, ["url"], ["updated_at", "id"])


@_query("SELECT id, url, updated_at FROM (SELECT DISTINCT id, url, updated_at FROM cleaned_pages) ORDER BY updated_at DESC, id LIMIT 5")
def topk_recent(spark: SparkSession, root: str) -> DataFrame:
    """The five pages updated last."""
    return answers.sample_recent(read_table(spark, root, "cleaned_pages").select("id", "url", "updated_at").distinct())


@_query(
    """SELECT DISTINCT c.id, c.page_id, c.chunk_index, p.url, p.title, c.content FROM chunks c JOIN cleaned_pages p ON p.id = c.page_id"""
)
def fetch_join(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk with the url and title of its page."""
    chunks = read_table(spark, root, "chunks").select("id", "page_id", "chunk_index", "content").distinct()
    pages = read_table(spark, root, "cleaned_pages").select(F.col("id").alias("page_id"), "url", "title").distinct()
    return chunks.join(pages, "page_id").select("id", "page_id", "chunk_index", "url", "title", "content")


@_query(
    """WITH c AS (SELECT DISTINCT page_id, chunk_index, content FROM chunks)
    SELECT page_id, string_agg(content, chr(10) ORDER BY chunk_index, content) AS content, count(*) AS n FROM c GROUP BY page_id"""
)
def chunks_of_page(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of every page in order, joined to one text."""
    rows = read_table(spark, root, "chunks").select("page_id", "chunk_index", "content").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return rows.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content"), F.count("*").alias("n")
    )


# ---------------------------------------------------------------- vectors


def _first_vector(spark: SparkSession, root: str) -> list[float]:
    return list(read_table(spark, root, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def _index(spark: SparkSession, root: str, use_cosine: bool = True) -> DataFrame:
    return search.build_index(read_table(spark, root, "embeddings"), "vec_id", "embedding", use_cosine)


_Q_SQL = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


@_query(
    f"""WITH {_Q_SQL}, s AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q)
    SELECT id, score FROM s ORDER BY score DESC, id LIMIT 25"""
)
def vec_topk_cos(spark: SparkSession, root: str) -> DataFrame:
    """The 25 vectors most similar to the first one by cosine."""
    return search.search(_index(spark, root), _first_vector(spark, root), 25, digits=6)


@_query(
    f"""WITH {_Q_SQL}, s AS (SELECT vec_id AS id, round(0 - list_sum(list_transform(list_zip(embedding::DOUBLE[], v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS score FROM embeddings, q)
    SELECT id, score FROM s ORDER BY score DESC, id LIMIT 25"""
)
def vec_topk_l2(spark: SparkSession, root: str) -> DataFrame:
    """The 25 vectors nearest to the first one by distance."""
    return search.search(_index(spark, root, False), _first_vector(spark, root), 25, use_cosine=False, digits=6)


@_query(
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
               FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s)
    SELECT query_id, n::INT AS rank, id, round(score, 4) AS score FROM r WHERE n <= 10"""
)
def vec_topk_batch(spark: SparkSession, root: str) -> DataFrame:
    """For every vector with an id divisible by 100, the ten most similar of all others."""
    index = _index(spark, root)
    asked = index.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "v")
    found = search.search_batch(index, asked, 10, skip_self=True)
    return found.select("query_id", "rank", "id", F.round("score", 4).alias("score"))


def _mmr_sql() -> str:
    sim = "list_cosine_similarity(a.v, b.v)"
    return f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT a.id AS query_id, b.id, b.v, round(round({sim}, 6), 6) AS score FROM e a, e b WHERE a.id % 100 = 0 AND a.id <> b.id),
    c0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM s),
    c AS (SELECT c0.*, round(list_cosine_similarity(c0.v, e.v), 9) AS rel FROM c0 JOIN e ON e.id = c0.query_id WHERE pos <= 25),
    p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, pos) AS n FROM c) WHERE n = 1),
    m1 AS (SELECT b.*, round(list_cosine_similarity(a.v, b.v), 9) AS near FROM c b JOIN p1 a ON a.query_id = b.query_id AND a.id <> b.id),
    p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel - 0.3 * near, 9) DESC, pos) AS n FROM m1) WHERE n = 1),
    m2 AS (SELECT b.* REPLACE (greatest(b.near, round(list_cosine_similarity(a.v, b.v), 9)) AS near) FROM m1 b JOIN p2 a ON a.query_id = b.query_id AND a.id <> b.id),
    p3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel - 0.3 * near, 9) DESC, pos) AS n FROM m2) WHERE n = 1)
    SELECT query_id, 1 AS rank, id, round(score, 4) AS score FROM p1 UNION ALL SELECT query_id, 2, id, round(score, 4) FROM p2
    UNION ALL SELECT query_id, 3, id, round(score, 4) FROM p3"""


@_query(_mmr_sql())
def mmr_top3(spark: SparkSession, root: str) -> DataFrame:
    """The 25 most similar vectors of each query re-ranked for relevance and diversity."""
    index = _index(spark, root)
    asked = index.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "v")
    recall = search.search_batch(index, asked, 25, skip_self=True)
    rows = recall.join(index, "id").join(asked.withColumnRenamed("v", "q"), "query_id")
    return search.mmr_rerank(rows).withColumn("score", F.round("score", 4))


# ---------------------------------------------------------------- questions and answers

_STOP_SQL = ", ".join(f"'{w}'" for w in search.STOPWORDS)
_SLUG_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_SLUGS_SQL = f"""w AS (SELECT session_id, turn, list_filter(regexp_split_to_array(question, '{_SPACE_SQL}+'), lambda t: t <> '' AND lower(t) NOT IN ({_STOP_SQL})) AS x
          FROM (SELECT DISTINCT session_id, turn, question FROM chat_turns)),
    s AS (SELECT session_id, turn, {_SLUG_SQL.format("array_to_string(x, ' ')")} AS slug FROM w
          UNION SELECT session_id, turn, {_SLUG_SQL.format("array_to_string(x[-4:], ' ')")} FROM w WHERE len(x) >= 4
          UNION SELECT session_id, turn, {_SLUG_SQL.format("array_to_string(x[-3:], ' ')")} FROM w WHERE len(x) >= 3
          UNION SELECT session_id, turn, {_SLUG_SQL.format("array_to_string(x[-2:], ' ')")} FROM w WHERE len(x) >= 2)"""


def _slugs(spark: SparkSession, root: str) -> DataFrame:
    turns = read_table(spark, root, "chat_turns").select("session_id", "turn", "question").distinct()
    return turns.select("session_id", "turn", F.explode(search.slug_candidates(F.col("question"))).alias("slug"))


@_query(f"WITH {_SLUGS_SQL} SELECT session_id, turn, slug FROM s WHERE length(slug) >= 6")
def slug_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The slugs of every question."""
    return _slugs(spark, root)


@_query(
    f"""WITH {_SLUGS_SQL}, d AS (SELECT DISTINCT slug FROM s WHERE length(slug) >= 6),
    p AS (SELECT DISTINCT p.id, d.slug FROM cleaned_pages p JOIN d ON contains(lower(p.url), d.slug) OR contains(lower(coalesce(p.title, '')), d.slug))
    SELECT DISTINCT s.session_id, s.turn, s.slug, c.id AS chunk_id FROM s JOIN p USING (slug) JOIN chunks c ON c.page_id = p.id"""
)
def slug_match(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of the pages whose url or title contains a slug of a question."""
    slugs = _slugs(spark, root).select(F.struct("session_id", "turn").alias("query_id"), "slug")
    found = search.match_slugs(read_table(spark, root, "chunks"), read_table(spark, root, "cleaned_pages"), slugs)
    return found.select("query_id.session_id", "query_id.turn", "slug", "chunk_id")


@_query(
    """WITH t AS (SELECT DISTINCT session_id, turn, question, answer FROM chat_turns),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM t)
    SELECT session_id, turn, question, answer FROM r WHERE n <= 5"""
)
def history_last5(spark: SparkSession, root: str) -> DataFrame:
    """The last five turns of every session."""
    return answers.last_turns(read_table(spark, root, "chat_turns").select("session_id", "turn", "question", "answer"))


@_query()
def prompt_messages(spark: SparkSession, root: str) -> DataFrame:
    """The messages that would be sent for the last question of every session."""
    turns = read_table(spark, root, "chat_turns").select("session_id", "turn", "question", "answer").distinct()
    past = answers.history(turns)
    last = dedupe.latest(turns, ["session_id"], ["turn"]).select("session_id", F.col("question").alias("ask"))
    return last.join(past, "session_id").select("session_id", answers.prompt_messages(F.lit(""), F.col("ask"), F.col("history")).alias("messages"))


@_query(
    """WITH h AS (SELECT DISTINCT p.id AS query_id, c.chunk_index, p.title, p.url, c.content FROM chunks c JOIN cleaned_pages p ON p.id = c.page_id WHERE c.chunk_index < 3)
    SELECT query_id, string_agg('- ' || coalesce(title, '') || ' | ' || url || ' (score: ' || printf('%.4f', 1.0 / (chunk_index + 1)) || ')' || chr(10) || substring(content, 1, 500),
                      chr(10) || chr(10) ORDER BY chunk_index) AS context FROM h GROUP BY query_id"""
)
def context_block(spark: SparkSession, root: str) -> DataFrame:
    """The context made of the first three chunks of every page, as if they were its hits."""
    pages = read_table(spark, root, "cleaned_pages").select(F.col("id").alias("page_id"), "title", "url").distinct()
    chunks = read_table(spark, root, "chunks").filter("chunk_index < 3").select("page_id", "chunk_index", F.col("content").alias("text")).distinct()
    hits = chunks.join(pages, "page_id").select(
        F.col("page_id").alias("query_id"), (F.col("chunk_index") + 1).alias("rank"), "title", "url", "text",
        (F.lit(1.0) / (F.col("chunk_index") + 1)).alias("score"),
    )
    return answers.context_blocks(hits)


@_query()
def e2e_retrieve(spark: SparkSession, root: str) -> DataFrame:
    """Pages cleaned, chunked, embedded; every session's last question answered with ranked hits."""
    raw = dedupe.latest(read_table(spark, root, "pages").distinct(), ["url"], ["scraped_at", "id"])
    pages = materialised(pipeline.clean(raw, now="2025-01-01 00:00:00"))
    embedder = HashEmbedder()
    made = materialised(chunking.chunk_pages(pages, embedder).withColumn("id", F.xxhash64("page_id", "chunk_index")))
    vectors_ = materialised(made.select("id", embed(F.col("content"), embedder).alias("v")))
    turns = read_table(spark, root, "chat_turns").select("session_id", "turn", "question").distinct()
    asked = dedupe.latest(turns, ["session_id"], ["turn"]).select(F.xxhash64("session_id").alias("query_id"), "question")
    asked = materialised(asked)
    return search.retrieve(asked, made, pages, asked.select("query_id", embed(F.col("question"), embedder).alias("v")), vectors_)


# ---------------------------------------------------------------- relational helpers


@_query()
def page_components(spark: SparkSession, root: str) -> DataFrame:
    """Connected components of all links between pages; no SQL, as a recursive one walks every path."""
    return connected_components(_graph(spark, root), "src", "dst")


@_query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT user_id, event_type, event_id, value FROM r WHERE n = 1"""
)
def upsert_events(spark: SparkSession, root: str) -> DataFrame:
    """The latest event of every user and type."""
    rows = read_table(spark, root, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return dedupe.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")
