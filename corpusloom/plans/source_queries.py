"""Registered queries: sources, links, catalog and keyed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.words import words
from corpusloom.operators import blockmax, upkeep
from corpusloom.operators.sizing import shared_folder
from corpusloom.plans import sqltext as s
from corpusloom.plans.inputs import benchmark_questions, document_chunks
from corpusloom.plans.registry import Tables, query
from corpusloom.sources import buckets, folder, links, relations, segments, store

C = lambda name: F.col(name)


# sources ------------------------------------------------------------------------------------------


@query(
    "s2_extracted_pages",
    "WITH parts AS (SELECT page_id, unnest(string_split(html, '<p>')) AS part, generate_subscripts(string_split(html, '<p>'), 1) AS page FROM pages), "
    f"made AS (SELECT page_id, page, {s.strip(f"""regexp_replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '{s.SP}+', ' ', 'g')""")} AS text FROM parts) "
    "SELECT CAST(page_id AS VARCHAR) AS source, page::INT AS page, text FROM made WHERE text <> ''",
)
def extracted_pages(t: Tables):
    def paragraphs(content: bytes) -> list[str]:
        """One page per paragraph of a web page."""
        import re

        return [re.sub("<[^>]*>", " ", x) for x in content.decode().split("<p>")]

    found = t.pages.select(C("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return folder.extracted_pages(found, paragraphs)


@query(
    "s3_merged_pages",
    "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id",
)
def merged_pages(t: Tables):
    pages = t.conversations.select("conv_id", (C("turn") + 1).alias("page"), "text")
    return folder.merged_pages(pages, "conv_id")


@query(
    "s12_inventory",
    "SELECT CASE WHEN contains(last, '.') THEN lower(regexp_extract(last, '(\\.[^./]+)$', 1)) ELSE '' END AS suffix, count(*) AS n_files, sum(strlen(html)) AS n_bytes "
    "FROM (SELECT html, regexp_extract(url, '([^/]*)$', 1) AS last FROM pages) GROUP BY 1",
)
def inventory(t: Tables):
    """Pages as files: by the suffix of their urls."""
    return folder.inventory(t.pages.select(F.regexp_extract("url", "([^/]*)$", 1).alias("path"), F.octet_length("html").alias("length")))


@query(
    "s6_query_documents",
    "WITH agg AS (SELECT n_nationkey, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) "
    "SELECT 'query:nations' AS source, 'db_query' AS doc_type, n_nationkey // 1000 AS block, 'Tabel: nations' || chr(10) || chr(10) || '| n_nationkey | n_name | customers |' || chr(10) || '|---|---|---|' || chr(10) || "
    "string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || customers || ' |', chr(10) ORDER BY n_nationkey) AS text FROM agg GROUP BY n_nationkey // 1000",
)
def query_documents(t: Tables):
    t.customer.createOrReplaceTempView("loom_customer")
    t.nation.createOrReplaceTempView("loom_nation")
    found = t.spark.sql(
        "SELECT n_nationkey, n_name, count(*) AS customers FROM loom_customer JOIN loom_nation ON c_nationkey = n_nationkey GROUP BY ALL"
    )
    return relations.label_queries({"nations": found}, "n_nationkey", {"nations": ["n_nationkey", "n_name", "customers"]})


CORPUS_SQL = """corpus AS (SELECT source, 'txt' AS doc_type, text FROM documents
 UNION ALL SELECT 'table:part' AS source, 'db_table', 'Tabel: part' || chr(10) || chr(10) || '| p_partkey | p_name |' || chr(10) || '|---|---|' || chr(10) ||
   string_agg('| ' || p_partkey || ' | ' || p_name || ' |', chr(10) ORDER BY p_partkey) FROM part GROUP BY p_partkey // 1000)"""


@query(
    "s8_source_union",
    f"WITH {CORPUS_SQL} SELECT source, doc_type, count(*) AS n, sum(len(text))::BIGINT AS n_chars, min(left(text, 60)) AS first FROM corpus GROUP BY ALL",
)
def source_union(t: Tables):
    readers = {
        "folder": lambda part: t.documents.select("source", F.lit("txt").alias("doc_type"), "text"),
        "tables": lambda part: relations.table_documents(t.part, "part", ["p_partkey", "p_name"], "p_partkey"),
    }
    corpus = relations.corpus_of("/corpus/documents|postgresql://host/db", readers)
    return corpus.groupBy("source", "doc_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.min(F.substring("text", 1, 60)).alias("first")
    )


KEYS = {"customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "nation": ["n_nationkey"]}
LAYOUT = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
                 ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
}


@query(
    "s10_catalog_profile",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", (SELECT count(*) FROM {n}) AS row_count, {i} AS ordinal, '{c}' AS \"column\", '{k}' AS type, true AS nullable, {str(c in KEYS[n]).lower()} AS primary_key"
        for n, cols in LAYOUT.items() for i, (c, k) in enumerate(cols, 1)
    ),
)
def catalog_profile(t: Tables):
    frames = {n: getattr(t, n) for n in LAYOUT}
    # parquet timestamps are read with or without a zone; the profile names both the same
    profile = relations.catalog_profile(*relations.catalog_frames(frames, KEYS))
    return profile.withColumn("type", F.regexp_replace("type", "_ntz$", ""))


@query(
    "s11_table_profile",
    "SELECT 'customer' AS \"table\", count(*) AS row_count, min(c_custkey) AS first_key FROM customer UNION ALL SELECT 'part', count(*), min(p_partkey) FROM part "
    "UNION ALL SELECT 'orders', count(*), min(o_orderkey) FROM orders",
)
def table_profile(t: Tables):
    keys = {"customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"}
    found = relations.table_profile({n: getattr(t, n) for n in keys}, keys)
    first = F.coalesce(*[F.get_json_object("sample", f"$.{k}") for k in keys.values()]).cast("long")
    return found.select("table", "row_count", first.alias("first_key"))


@query(
    "s17_persisted_index",
    f"WITH {s.DOCS_BY_LANG}, {s.ASKED}, {s.lexical()} "
    + s.best("bm", "question_id, collection", "score DESC, chunk_id", 5, cols="question_id, collection, chunk_id, score, rank"),
)
def persisted_index(t: Tables):
    place = f"{shared_folder(t.spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    store.save_collections(document_chunks(t, by_language=True), place)
    return store.score_saved(benchmark_questions(t), place, 5)


@query(
    "s17_block_max",
    f"WITH {s.DOCS_BY_LANG}, {s.ASKED}, {s.lexical()} "
    + s.best("bm", "question_id, collection", "score DESC, chunk_id", 5, cols="question_id, collection, chunk_id, score, rank"),
)
def block_max(t: Tables):
    place = f"{shared_folder(t.spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    blockmax.save_blocks(document_chunks(t, by_language=True), place)
    return blockmax.block_max_top(benchmark_questions(t), place, 5).hits


@query(
    "s17_segments",
    f"WITH {s.DOCS_BY_LANG}, {s.ASKED}, {s.lexical()} "
    + s.best("bm", "question_id, collection", "score DESC, chunk_id", 5, cols="question_id, collection, chunk_id, score, rank"),
)
def grown_index(t: Tables):
    """Three batches: a third of the documents in a former version, the others with copies under ids of their own, then the
    last version of that third while the copies go; two of the segments are merged."""
    place = f"{shared_folder(t.spark).rstrip('/')}/segments-{uuid.uuid4().hex}"
    chunks = document_chunks(t, by_language=True).select("collection", "chunk_id", "text")
    third = F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0
    copies = chunks.filter(~third).withColumn("chunk_id", -F.col("chunk_id") - 1)
    segments.add_segment(t.spark, place, chunks.filter(third).withColumn("text", F.concat("text", F.lit(" former text"))))
    segments.add_segment(t.spark, place, chunks.filter(~third).unionByName(copies))
    segments.compact(t.spark, place, 1, 2)
    segments.add_segment(t.spark, place, chunks.filter(third), copies.select("collection", "chunk_id"))
    return segments.search_segments(benchmark_questions(t), place, 5)


# links --------------------------------------------------------------------------------------------

FILE_SHAPE = r"^/([a-z][^/]*)"
FOLDER_SHAPE = r"^/([A-Z][^/]*)"
BASE_SQL = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"


def _unescaped(c: str) -> str:
    for a, b in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        c = f"replace({c}, '{a}', '{b}')"
    return c


LINKS_SQL = f"""hits AS (SELECT page_id, {BASE_SQL} AS base, regexp_extract_all(html, {s.q(links.ANCHOR)}, 1) AS hrefs, regexp_extract_all(html, {s.q(links.ANCHOR)}, 2) AS raws FROM pages),
each AS (SELECT page_id, base, unnest(hrefs) AS href, unnest(raws) AS raw, generate_subscripts(hrefs, 1) AS place FROM hits),
anchors AS (SELECT page_id, place, CASE WHEN regexp_matches({_unescaped('href')}, '^https?://') THEN {_unescaped('href')} WHEN starts_with({_unescaped('href')}, '/') THEN base || {_unescaped('href')} ELSE base || '/' || {_unescaped('href')} END AS url,
  {s.strip(f"regexp_replace({_unescaped('raw')}, '<[^>]+>', '', 'g')")} AS label FROM each),
parts AS (SELECT *, regexp_extract(url, {s.q(urls.URL)}, 3) AS path FROM anchors),
typed AS (SELECT page_id, place, url, label, nullif(regexp_extract(path, '{FILE_SHAPE}', 1), '') AS file_id, nullif(regexp_extract(path, '{FOLDER_SHAPE}', 1), '') AS folder_id FROM parts),
kinds AS (SELECT page_id, place, url, label, coalesce(file_id, folder_id) AS id, CASE WHEN file_id IS NOT NULL THEN 'file' ELSE 'folder' END AS item_type FROM typed WHERE coalesce(file_id, folder_id) IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, item_type, id ORDER BY place) AS f FROM kinds),
items AS (SELECT page_id, item_type, id, coalesce(nullif(label, ''), 'item ' || item_type || ' ' || row_number() OVER (PARTITION BY page_id, item_type ORDER BY place)) AS name, url FROM firsts WHERE f = 1)"""


@query("s13_folder_items", f"WITH {LINKS_SQL} SELECT * FROM items")
def folder_items(t: Tables):
    base = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    found = links.anchors(t.pages, base)
    shape = lambda x: F.nullif(F.regexp_extract(urls.path(F.col("url")), x, 1), F.lit(""))
    return links.folder_items(found, shape(FILE_SHAPE), shape(FOLDER_SHAPE))


@query(
    "s14_folder_tree",
    "SELECT 'r' || n_regionkey AS root, 'n' || n_nationkey AS id, 'folder' AS item_type, n_name AS name, 1 AS depth FROM nation "
    "UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 'folder', c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "UNION ALL SELECT 'r' || n_regionkey, 'o' || o_orderkey, 'file', 'order ' || o_orderkey || '.pdf', 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def folder_tree(t: Tables):
    return _tree(t, F.lit(".pdf"))


@query(
    "s14_wanted_files",
    "SELECT 'r' || n_regionkey AS root, 'o' || o_orderkey AS id, 'file' AS item_type, 'order ' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.PDF' ELSE '.md' END AS name, 3 AS depth "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 4 IN (0, 1)",
)
def wanted_files(t: Tables):
    """Files of the tree that can be read, by the end of their names; folders and other files are left out."""
    kind = C("o_orderkey") % 4
    return links.wanted_files(_tree(t, F.when(kind == 0, ".PDF").when(kind == 1, ".md").when(kind == 2, ".xlsx").otherwise(".md.bak")))


def _tree(t: Tables, ending):
    def edges(df, parent, letter, key, kind, name):
        return df.select(
            F.concat(F.lit(parent[0]), F.col(parent[1]).cast("string")).alias("parent"),
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("item_type"), name.alias("name"),
        )

    every = (
        edges(t.nation, ("r", "n_regionkey"), "n", "n_nationkey", "folder", C("n_name"))
        .unionByName(edges(t.customer, ("n", "c_nationkey"), "c", "c_custkey", "folder", C("c_name")))
        .unionByName(edges(t.orders, ("c", "o_custkey"), "o", "o_orderkey", "file", F.concat(F.lit("order "), C("o_orderkey").cast("string"), ending)))
        # the way back up closes cycles that the search has to survive
        .unionByName(edges(t.nation, ("n", "n_nationkey"), "r", "n_regionkey", "folder", F.lit("up")))
    )
    roots = t.region.select(F.concat(F.lit("r"), C("r_regionkey").cast("string")).alias("root"))
    return links.below(roots, every, 5)


def _url(part: int, c: str = "url") -> str:
    return f"regexp_extract({c}, {s.q(urls.URL)}, {part})"


TAIL = f"regexp_extract(regexp_replace({_url(3)}, '^/+|/+$', '', 'g'), '([^/]*)$', 1)"
HOSTS = ["thther.example.org", "tionble.example.com"]


@query(
    "s15_urls",
    f"""WITH p AS (SELECT page_id, url, {_url(2)} AS auth, {_url(3)} AS path, {_url(4)} AS qs, {TAIL} AS tail, regexp_replace(lower({_url(2)}), '^www\\.', '') AS host FROM pages),
    i AS (SELECT *, CASE WHEN host IN {s.in_list(HOSTS)} THEN coalesce(nullif(regexp_extract(path, '/([a-z]{{2}}/[0-9]+)', 1), ''), nullif(regexp_extract(qs, '(?:^|&)utm_source=([^&]+)', 1), '')) END AS item FROM p)
    SELECT page_id, host, coalesce(nullif(tail, ''), nullif(auth, ''), 'item') AS name, coalesce(nullif(auth, ''), 'Public Link') || CASE WHEN tail <> '' THEN '/' || tail ELSE '' END AS title,
    lower({_url(1)}) IN ('http', 'https') AND auth <> '' AS valid, item, CASE WHEN item IS NOT NULL THEN 'https://files.example/' || item ELSE url END AS download,
    'postgresql://user:****@' || host || ':5432/db' AS redacted, host || '/db' AS label FROM i""",
)
def normalised_urls(t: Tables):
    u = F.col("url")
    shape = "/([a-z]{2}/[0-9]+)"
    item = urls.item_id(u, HOSTS, shape, "utm_source")
    secret = F.concat(F.lit("postgresql://user:s3cret@"), urls.host(u), F.lit(":5432/db"))
    return t.pages.select(
        "page_id", urls.host(u).alias("host"), urls.name_of(u).alias("name"), urls.title_of(u).alias("title"),
        urls.is_valid(u).alias("valid"), item.alias("item"),
        F.when(item.isNotNull(), F.concat(F.lit("https://files.example/"), item)).otherwise(u).alias("download"),
        urls.redacted(secret).alias("redacted"), urls.connection_label(secret).alias("label"),
    )


NAMES_SQL = """h AS (SELECT doc_id, source, lang, text, CASE lang WHEN 'en' THEN 'attachment; filename="' || source || ' (1).pdf"' WHEN 'fr' THEN 'attachment; filename=x.pdf; filename*=UTF-8''''' || source || '%20%C3%A9+a.txt'
  WHEN 'de' THEN 'inline' ELSE 'attachment; filename=dir/' || source || '?.md' END AS header FROM documents),
e AS (SELECT *, trim(regexp_extract(header, '(?i)filename\\*=UTF-8''''([^;]+)', 1)) AS enc, trim(regexp_extract(header, '(?i)filename="?([^";]+)"?', 1)) AS plain FROM h),
f AS (SELECT *, coalesce(nullif(url_decode(replace(enc, '+', '%2B')), ''), nullif(plain, '')) AS file FROM e),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(file), '/+$', ''), '([^/]*)$', 1), '[^A-Za-z0-9._ -]', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS clean FROM f)"""


@query(
    "s16_file_names",
    f"""WITH {NAMES_SQL} SELECT doc_id, file, CASE WHEN file IS NULL OR clean = '' THEN source || '.pdf' WHEN ends_with(lower(clean), '.pdf') THEN clean ELSE clean || '.pdf' END AS safe,
    nullif(left({s.strip(f"regexp_replace(text, '{s.SP}+', ' ', 'g')")}, 150), '') AS title,
    CASE WHEN lower(regexp_extract(coalesce(file, ''), '(\\.[^./]+)$', 1)) = '.pdf' THEN 'pdf' WHEN lang = 'es' OR lower(regexp_extract(coalesce(file, ''), '(\\.[^./]+)$', 1)) IN ('.txt', '.md', '.log') THEN 'text' END AS kind FROM b""",
)
def file_names(t: Tables):
    lang, source = F.col("lang"), F.col("source")
    header = (
        F.when(lang == "en", F.concat(F.lit('attachment; filename="'), source, F.lit(' (1).pdf"')))
        .when(lang == "fr", F.concat(F.lit("attachment; filename=x.pdf; filename*=UTF-8''"), source, F.lit("%20%C3%A9+a.txt")))
        .when(lang == "de", "inline")
        .otherwise(F.concat(F.lit("attachment; filename=dir/"), source, F.lit("?.md")))
    )
    named = t.documents.select("doc_id", "source", "lang", "text", urls.header_filename(header).alias("file"))
    return named.select(
        "doc_id", "file", urls.safe_name(F.col("file"), source).alias("safe"), urls.squeezed_title(F.col("text")).alias("title"),
        urls.kind_of(F.when(lang == "es", "text/plain"), F.coalesce("file", F.lit(""))).alias("kind"),
    )


# keyed tables -------------------------------------------------------------------------------------

SESSIONS_SQL = "sessions AS (SELECT c_custkey AS session_id, c_name AS title, TIMESTAMP '2024-01-01' + to_minutes((c_custkey * 37 % 5000)::INT) AS updated_at FROM customer)"


def sessions(t: Tables):
    stamp = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(c_custkey * 37 % 5000))")
    return t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("title"), stamp.alias("updated_at"))


@query(
    "j1_sessions_with_counts",
    f"WITH {SESSIONS_SQL} SELECT s.session_id, title, updated_at, count(m.turn) AS message_count FROM sessions s LEFT JOIN conversations m ON m.conv_id = s.session_id "
    "GROUP BY ALL ORDER BY updated_at DESC, s.session_id LIMIT 200",
)
def sessions_with_counts(t: Tables):
    return upkeep.sessions_with_counts(sessions(t), t.conversations.select(F.col("conv_id").alias("session_id")), 200)


@query(
    "j2_parents_with_children",
    f"WITH {SESSIONS_SQL} SELECT session_id, title, role, text, turn, CASE WHEN turn IS NOT NULL THEN row_number() OVER (PARTITION BY session_id ORDER BY turn) END AS position "
    "FROM sessions LEFT JOIN conversations ON conv_id = session_id",
)
def parents_with_children(t: Tables):
    children = t.conversations.select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    return upkeep.with_children(sessions(t).drop("updated_at"), children, "session_id", "turn").select(
        "session_id", "title", "role", "text", "turn", "position"
    )


@query("j3_notes_with_people", "SELECT doc_id, c_name, left(text, 80) AS highlights FROM documents JOIN customer ON c_custkey = doc_id")
def notes_with_people(t: Tables):
    return t.documents.join(t.customer, F.col("c_custkey") == F.col("doc_id")).select(
        "doc_id", "c_name", F.substring("text", 1, 80).alias("highlights")
    )


@query(
    "j5_orphans",
    "WITH st AS (SELECT o_custkey AS collection_id, count(*) AS n_files FROM orders GROUP BY 1), reg AS (SELECT c_custkey AS collection_id, 'inactive' AS status FROM customer WHERE c_acctbal > 5000) "
    "SELECT collection_id, status, NULL::BIGINT AS n_files FROM reg UNION ALL SELECT collection_id, 'active', n_files FROM st WHERE collection_id NOT IN (SELECT collection_id FROM reg)",
)
def orphan_collections(t: Tables):
    stored = t.orders.groupBy(F.col("o_custkey").alias("collection_id")).agg(F.count(F.lit(1)).alias("n_files"))
    known = t.customer.filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("collection_id"), F.lit("inactive").alias("status"))
    return upkeep.registered_with_orphans(stored, known, "collection_id")


def collections(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("collection_id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("title"),
        F.when(F.col("c_acctbal") > 3000, "active").otherwise("inactive").alias("status"),
    )


@query(
    "p1_active_collections",
    "SELECT c_custkey AS collection_id, c_name AS title FROM customer WHERE c_acctbal > 3000 AND c_custkey IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def active_collections(t: Tables):
    selected = t.labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("collection_id"))
    return upkeep.active(collections(t), selected).select("collection_id", "title")


@query("p2_owned_collections", "SELECT c_custkey AS collection_id, c_name AS title FROM customer WHERE c_nationkey = 3")
def owned_collections(t: Tables):
    return upkeep.owned(collections(t), F.lit(3)).select("collection_id", "title")


def _event_rows(t: Tables, stored: bool):
    rows = t.events.filter(F.col("event_type") == "view" if stored else F.col("event_type") != "view")
    return rows.select("user_id", F.col("event_id").alias("updated_at"), F.col("event_id").alias("created_at"), "event_type", "value")


UPSERTED = """WITH old AS (SELECT user_id, max(event_id) AS updated_at, min(event_id) AS created_at FROM events WHERE event_type = 'view' GROUP BY 1),
    new AS (SELECT user_id, max(event_id) AS updated_at, min(event_id) AS created_at FROM events WHERE event_type <> 'view' GROUP BY 1),
    j AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.created_at, n.created_at) AS created_at, greatest(coalesce(o.updated_at, -1), coalesce(n.updated_at, -1)) AS updated_at FROM old o FULL JOIN new n ON o.user_id = n.user_id)
    SELECT j.user_id, e.event_type, e.value, j.created_at, j.updated_at FROM j JOIN events e ON e.event_id = j.updated_at"""


@query(
    "u3_upserted",
    UPSERTED,
)
def upserted(t: Tables):
    return upkeep.upserted(_event_rows(t, True), _event_rows(t, False), "user_id", ["event_type", "value"])


@query("u3_bucketed_upsert", UPSERTED)
def bucketed_upsert(t: Tables):
    """The stored rows lie in buckets, the batch rewrites those of its keys."""
    place = f"{shared_folder(t.spark).rstrip('/')}/keyed-{uuid.uuid4().hex}"
    stored = _event_rows(t, True)
    buckets.save(upkeep.upserted(stored.limit(0), stored, "user_id", ["event_type", "value"]), place, "user_id", 16)
    buckets.upsert(_event_rows(t, False), place, ["event_type", "value"])
    return buckets.load(t.spark, place)


@query(
    "u4_bucketed_children",
    "WITH fresh AS (SELECT doc_id AS conv_id, 0 AS turn, source AS text FROM documents WHERE lang = 'fr') SELECT conv_id, turn, text FROM conversations "
    "WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND conv_id NOT IN (SELECT conv_id FROM fresh) UNION ALL SELECT * FROM fresh",
)
def bucketed_children(t: Tables):
    """A deletion, then a replacement of children, each in the buckets of its keys only."""
    place = f"{shared_folder(t.spark).rstrip('/')}/keyed-{uuid.uuid4().hex}"
    buckets.save(t.conversations.select("conv_id", "turn", "text"), place, "conv_id", 16)
    buckets.delete(t.labels.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("conv_id")), place)
    fresh = t.documents.filter(F.col("lang") == "fr").select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.col("source").alias("text"))
    buckets.replace_children(fresh, place)
    return buckets.load(t.spark, place)


@query(
    "u4_cascade_delete",
    "SELECT conv_id, turn, text FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def cascade_delete(t: Tables):
    gone = t.labels.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("conv_id"))
    return upkeep.deleted(t.conversations.select("conv_id", "turn", "text"), gone, "conv_id")


@query(
    "u4_replaced_children",
    "WITH fresh AS (SELECT doc_id AS conv_id, 0 AS turn, source AS text FROM documents WHERE lang = 'fr') SELECT conv_id, turn, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM fresh) UNION ALL SELECT * FROM fresh",
)
def replaced_children(t: Tables):
    fresh = t.documents.filter(F.col("lang") == "fr").select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("source").alias("text"))
    return upkeep.children_replaced(t.conversations.select("conv_id", "turn", "text"), fresh, "conv_id")


@query(
    "u5_toggled",
    "SELECT c_custkey AS collection_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'active' WHEN c_acctbal > 3000 THEN 'active' ELSE 'inactive' END AS status, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 99 ELSE c_custkey END AS updated_at FROM customer",
)
def toggled(t: Tables):
    rows = collections(t).withColumn("updated_at", F.col("collection_id")).join(
        t.customer.select(F.col("c_custkey").alias("collection_id"), "c_mktsegment"), "collection_id"
    )
    return upkeep.toggled(rows, F.col("c_mktsegment") == "BUILDING", True, F.lit(99).cast("long")).select("collection_id", "status", "updated_at")


@query(
    "w5_top_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def top_orders(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(20)


@query("w6_first_seen", "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def first_seen(t: Tables):
    rows = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return upkeep.first_seen(rows, [F.col("h")], ["text_hash"], "doc_id").drop("h")


@query("w6_last_seen", "SELECT split_part(url, '/', 3) AS host, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM pages GROUP BY 1")
def last_seen(t: Tables):
    return upkeep.last_seen(t.pages.select("page_id", "url"), [F.split_part("url", F.lit("/"), F.lit(3))], ["host"], "page_id")


@query("a6_distinct_counts", "SELECT source, count(*) AS n_documents, count(DISTINCT lang) AS n_languages, array_to_string(list_sort(list(DISTINCT lang)), '|') AS languages FROM documents GROUP BY source")
def distinct_counts(t: Tables):
    return t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.size(F.collect_set("lang")).cast("long").alias("n_languages"),
        F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("languages"),
    )


@query(
    "u2_token_sets",
    f"WITH w AS (SELECT conv_id, turn, list_distinct({s.words('text')}) AS ws FROM conversations) SELECT a.conv_id, a.turn, len(list_intersect(a.ws, b.ws)) AS shared, "
    "len(list_filter(a.ws, lambda x: NOT list_contains(b.ws, x))) AS own FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1",
)
def token_sets(t: Tables):
    w = t.conversations.select("conv_id", "turn", F.array_distinct(words(F.col("text"))).alias("ws"))
    later = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("next"))
    return w.join(later, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size(F.array_intersect("ws", "next")).alias("shared"), F.size(F.array_except("ws", "next")).alias("own")
    )
