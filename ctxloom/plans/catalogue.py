"""The operators applied to the driver's tables, each with the SQL of its result.

The tables hold no source code, so each operator runs on a shape of the same kind:
urls and synthetic names stand for paths, table relations for dependency edges.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths as P
from ..functions import text as X
from ..operators import audit as A
from ..operators import buckets as B
from ..operators import extract
from ..operators import graph as G
from ..operators import lanes as L
from ..operators import resolve as R
from ..operators import similarity as S
from ..sources import config
from ..sources import diff as D
from ..sources import embeddings as E
from ..sources import tree
from ..storage import shared_folder
from . import bundle, render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shapes shared by Spark and SQL ---------------------------------------------

#: Paths for documents: templates that reach every bucket, by doc_id.
_TEMPLATES = (
    "apps/backend/prisma/migrations/{}/m.sql", "apps/backend/src/app/api/{}.ts", "apps/backend/src/lib/{}.ts",
    "apps/dashboard/src/app/{}.tsx", "apps/dashboard/src/lib/{}.ts", "apps/e2e/{}.ts", "packages/react/{}.ts",
    "apps/mobile/{}.md", "docs/{}.mdx", "packages/other/{}.ts", "src/{}.d.ts", "schema/{}/schema.prisma",
)


def _doc_path(doc_id: Column) -> Column:
    table = F.array(*map(F.lit, _TEMPLATES))
    return F.replace(F.element_at(table, (doc_id % len(_TEMPLATES)).cast("int") + 1), F.lit("{}"), doc_id.cast("string"))


_SQL_PATH = "replace([" + ", ".join(f"'{x}'" for x in _TEMPLATES) + f"][(doc_id % {len(_TEMPLATES)})::INT + 1], '{{}}', doc_id::VARCHAR)"
_STATUSES = ("added", "modified", "deleted", "renamed", "copied")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changed-file rows from documents: path, status, additions, deletions."""
    d = t(spark, sf_dir, "documents")
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), (F.floor(F.col("doc_id") / 7) % 5).cast("int") + 1)
    return d.select(
        F.col("doc_id").alias("ord"), _doc_path(F.col("doc_id")).alias("path"), status.alias("status"),
        (F.col("n_chars") % 100).alias("additions"), (F.col("n_chars") % 37).alias("deletions"), "text", "source", "doc_id",
    ).withColumn("bucket", B.bucket_key(B.bucket_of(F.col("path"))))


_SQL_BUCKET = """CASE
 WHEN contains(path, '/prisma/migrations/') OR path LIKE '%schema.prisma' OR path LIKE '%.sql' THEN '01-db-migrations-and-schema'
 WHEN path LIKE 'apps/backend/src/app/api/%' OR path LIKE 'apps/backend/src/route-handlers/%' THEN '02-backend-api-routes'
 WHEN path LIKE 'apps/backend/src/lib/%' OR path LIKE 'apps/backend/scripts/%' THEN '03-backend-lib'
 WHEN path LIKE 'apps/dashboard/src/app/%' THEN '04-dashboard-pages'
 WHEN path LIKE 'apps/dashboard/src/components/%' OR path LIKE 'apps/dashboard/src/lib/%' THEN '05-dashboard-components-and-lib'
 WHEN path LIKE 'apps/e2e/%' THEN '06-e2e-tests'
 WHEN path LIKE 'packages/react/%' THEN '07-shared-packages'
 WHEN path LIKE 'apps/%' AND path NOT LIKE 'apps/backend/%' AND path NOT LIKE 'apps/dashboard/%' THEN '08-other-apps'
 WHEN path LIKE 'docs/%' OR path LIKE '%.md' OR path LIKE '%.css' THEN '09-config-ci-docs'
 ELSE '99-misc' END"""
_SQL_FILES = f"""files AS (SELECT *, {_SQL_BUCKET} AS bucket FROM (SELECT doc_id AS ord, {_SQL_PATH} AS path,
 ['added','modified','deleted','renamed','copied'][((doc_id // 7) % 5)::INT + 1] AS status,
 n_chars % 100 AS additions, n_chars % 37 AS deletions, text, source, doc_id FROM documents))"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("ord", "href"))


_SQL_LINKS = """links AS (SELECT page_id, (i - 1)::INT AS ord, hrefs[i] AS href FROM (
 SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hrefs FROM pages)))"""


# --- vectors ---------------------------------------------------------------------


def _neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    targets = vectors.filter(F.col("id") % 50 == 0).select(F.col("id").alias("target"), "vec")
    return S.top_k(targets, vectors, k=8)


_SQL_NEIGHBORS = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
 s AS (SELECT a.id AS target, b.id,
   list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2])), lambda x, y: x + y)
   / (sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(a.vec, lambda z: z * z)), lambda x, y: x + y))
    * sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(b.vec, lambda z: z * z)), lambda x, y: x + y))) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
 r AS (SELECT target, id, round(score, 4) AS score FROM s WHERE score > 0),
 n AS (SELECT * FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY score DESC, id)::INT AS rank, id, score FROM r) WHERE rank <= 8)"""


@query(f"WITH {_SQL_NEIGHBORS} SELECT target, rank, id, score FROM n")
def vec2_cosine_topk(spark, sf_dir):
    """VEC1, VEC2, LM1: every 50th vector against all."""
    return _neighbors(spark, sf_dir)


@query(
    f"""WITH {_SQL_NEIGHBORS}, l AS (SELECT vec_id AS id, label FROM embeddings)
 SELECT target, rank, n.id, score, concat_ws('+', CASE WHEN a.label = b.label AND n.id > target THEN 'forward' END,
  CASE WHEN a.label = b.label AND n.id < target THEN 'reverse' END) AS also_in
 FROM n JOIN l a ON a.id = target JOIN l b ON b.id = n.id"""
)
def jn13_lane_tags(spark, sf_dir):
    """JN13, ST5: equal labels stand for edges, to larger ids forward and to smaller ones in reverse."""
    near = _neighbors(spark, sf_dir)
    labels = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    mine = labels.select(F.col("id").alias("target"), F.col("label").alias("own"))
    pairs = near.select("target", "id").join(mine, "target").join(labels, "id").filter("own = label")
    direction = F.when(F.col("id") > F.col("target"), "forward").otherwise("reverse")
    hops = pairs.select(F.col("target").alias("start"), direction.alias("direction"), F.col("id").alias("path"))
    tagged = L.tag_overlap(near, hops)
    return tagged.select("target", "rank", "id", "score", F.array_join("also_in", "+").alias("also_in"))


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256('m' || chr(0) || substring(text, 1, 5000)) END AS key FROM documents")
def vec3_content_key(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.length("text") > 0, S.content_key("m", F.col("text"))).alias("key"))


@query(
    """WITH k AS (SELECT doc_id, substring(text, 1, 5000) AS s FROM documents WHERE length(text) > 0),
 c AS (SELECT DISTINCT s FROM k JOIN labels USING (doc_id))
 SELECT count(c.s)::BIGINT AS hits, (count(*) - count(c.s))::BIGINT AS misses FROM k LEFT JOIN c USING (s)"""
)
def jn14_cache_probe(spark, sf_dir):
    """JN14, AG14: documents against a cache that holds the labelled ones."""
    files = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    labelled = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")).distinct()
    held = files.filter("length(content) > 0").join(labelled, "path", "left_semi")
    cache = held.select(F.lit("m").alias("model"), S.content_key("m", F.col("content")).alias("key"), F.array(F.lit(0.0)).alias("vec"))
    return E.counters(E.probe(files, cache, "m"))


# --- paths, predicates, buckets ----------------------------------------------------


@query(
    f"""WITH {_SQL_FILES} SELECT doc_id, path,
  CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir,
  regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext,
  (regexp_matches(path, '\\.(js|jsx|ts|tsx|mjs|cjs)$') AND NOT regexp_matches(path, '\\.d\\.(ts|mts|cts)$')) AS is_source,
  array_to_string(string_split(path, '/')[1:3], '/') AS prefix3 FROM files"""
)
def src2_path_functions(spark, sf_dir):
    """SRC2, SC5, SC6."""
    p = F.col("path")
    return _files(spark, sf_dir).select(
        "doc_id", "path", P.dirname(p).alias("dir"), P.basename(p).alias("base"), P.extname(p).alias("ext"),
        P.is_source(p).alias("is_source"), P.prefix(p, 3).alias("prefix3"),
    )


@query(
    """WITH p AS (SELECT a.url AS path, b.url AS neighbor FROM pages a JOIN pages b ON b.page_id = a.page_id + 1),
 c AS (SELECT count(*)::BIGINT AS total,
  count(*) FILTER (string_split(path, '/')[1:3] = string_split(neighbor, '/')[1:3])::BIGINT AS same3,
  count(*) FILTER (string_split(path, '/')[1:4] = string_split(neighbor, '/')[1:4])::BIGINT AS same4,
  count(*) FILTER (string_split(path, '/')[1:5] = string_split(neighbor, '/')[1:5])::BIGINT AS same5 FROM p)
 SELECT *, printf('%.1f%%', same3 / total * 100) AS pct3, printf('%.1f%%', same4 / total * 100) AS pct4, printf('%.1f%%', same5 / total * 100) AS pct5 FROM c"""
)
def ag7_prefix_coherence(spark, sf_dir):
    """AG7, SC7: neighbouring pages."""
    pages = t(spark, sf_dir, "pages").select("page_id", "url")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("neighbor"))
    return A.coherence(pages.join(after, "page_id").select(F.col("url").alias("path"), "neighbor"))


@query(f"WITH {_SQL_FILES} SELECT path, bucket FROM files")
def fl5_bucket_of(spark, sf_dir):
    return _files(spark, sf_dir).select("path", "bucket")


@query(
    f"WITH {_SQL_FILES} SELECT bucket, count(*)::BIGINT AS n_files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM files GROUP BY bucket"
)
def ag3_bucket_totals(spark, sf_dir):
    return B.bucket_totals(_files(spark, sf_dir))


@query(f"WITH {_SQL_FILES}, s AS (SELECT bucket, count(*)::BIGINT AS n_files FROM files GROUP BY bucket) SELECT a.bucket, b.bucket AS other, b.n_files FROM s a JOIN s b ON a.bucket <> b.bucket")
def ag5_other_buckets(spark, sf_dir):
    return B.other_buckets(_files(spark, sf_dir))


@query(f"WITH {_SQL_FILES} SELECT bucket, string_agg(path, ',' ORDER BY ord) AS paths FROM files GROUP BY bucket")
def ag2_bucket_members(spark, sf_dir):
    """AG2, LM2: the ordered members of each bucket."""
    return _files(spark, sf_dir).groupBy("bucket").agg(F.array_join(L.ordered(["ord"], F.col("path")), ",").alias("paths"))


@query(
    f"""WITH {_SQL_FILES} SELECT path, status FROM files WHERE contains(path, '/prisma/migrations/') OR path LIKE '%schema.prisma'
  OR path LIKE '%.sql' OR (status = 'added' AND regexp_matches(path, '\\.(js|jsx|ts|tsx|mjs|cjs)$'))"""
)
def fl6_high_signal(spark, sf_dir):
    return _files(spark, sf_dir).filter(B.high_signal(F.col("path"), F.col("status"))).select("path", "status")


@query(
    f"""WITH {_SQL_FILES} SELECT path, status FROM files WHERE length(text) > 200 AND NOT (contains(path, '/prisma/migrations/') OR path LIKE '%schema.prisma'
  OR path LIKE '%.sql' OR (status = 'added' AND regexp_matches(path, '\\.(js|jsx|ts|tsx|mjs|cjs)$')))"""
)
def jn17_signal_antijoin(spark, sf_dir):
    """JN17, FL10: what is left beside the high signals, with something to show."""
    files = _files(spark, sf_dir)
    signal = files.filter(B.high_signal(F.col("path"), F.col("status"))).select("path")
    return files.filter(F.length("text") > 200).join(signal, "path", "left_anti").select("path", "status")


@query(f"WITH {_SQL_FILES} SELECT status, count(*)::BIGINT AS n_files, md5(string_agg(path, ',' ORDER BY ord)) AS digest FROM files GROUP BY status")
def ag6_status_counts(spark, sf_dir):
    """AG6, FL11."""
    return B.status_counts(_files(spark, sf_dir)).select("status", "n_files", F.md5(F.array_join("paths", ",")).alias("digest"))


@query(
    f"""WITH {_SQL_FILES} SELECT path FROM files ORDER BY CASE WHEN length(text) > 200 AND length(text) < 8000 AND additions > 50 THEN 1 ELSE 2 END, ord LIMIT 1"""
)
def fl8_pick(spark, sf_dir):
    """FL7, FL8: a request that matches nothing, then the first good row."""
    good = (F.length("text") > 200) & (F.length("text") < 8000) & (F.col("additions") > 50)
    return B.pick(_files(spark, sf_dir), "no/such/file", good).select("path")


@query(
    """WITH direct AS (SELECT doc_id FROM labels), twins AS (SELECT text, count(*) AS n FROM documents GROUP BY text)
 SELECT count(*) FILTER (l.doc_id IS NULL AND t.n = 1)::BIGINT AS gaps, count(*) FILTER (l.doc_id IS NOT NULL AND t.n = 1)::BIGINT AS partial
 FROM documents d LEFT JOIN direct l USING (doc_id) JOIN twins t USING (text)"""
)
def fl9_context_gap(spark, sf_dir):
    """FL9: a label is a direct lane, a document of equal text a neighbour."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"))
    twins = d.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    labels = t(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("label"))
    lanes = d.join(twins, "h").join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("path"), F.coalesce("label", F.lit(0)).alias("direct"), F.lit(0).alias("hops"), (F.col("n") - 1).alias("near")
    )
    return A.context_gaps(lanes)[1]


# --- texts -------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT doc_id, strlen(text) > 2000 AS truncated, string_split(CASE WHEN strlen(text) > 2000 THEN substring(text, 1, 2000) ELSE text END, chr(10)) AS lines FROM documents)
 SELECT doc_id, truncated, array_to_string(list_transform(range(1, len(lines) + 1), lambda i: lpad(i::VARCHAR, length(len(lines)::VARCHAR)::INT, ' ') || ': ' || lines[i]), chr(10)) AS numbered FROM s"""
)
def sc2_line_numbers(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", X.over_limit(F.col("text"), 2000).alias("truncated"), X.with_line_numbers(F.col("text"), 2000).alias("numbered"))


@query("SELECT doc_id, CASE WHEN length(text) > 800 THEN substring(text, 1, 800) || chr(10) || '... [truncated, file continues]' ELSE text END AS body FROM documents")
def sc3_trimmed(spark, sf_dir):
    """SC3, SC4."""
    return t(spark, sf_dir, "documents").select("doc_id", X.trimmed(F.col("text"), 800).alias("body"))


@query(
    """WITH s AS (SELECT doc_id, strlen(text) > 60000 AS truncated, string_split(CASE WHEN strlen(text) > 60000 THEN substring(text, 1, 60000) ELSE text END, chr(10)) AS lines FROM documents)
 SELECT doc_id, truncated, array_to_string(list_transform(range(1, len(lines) + 1), lambda i: lpad(i::VARCHAR, length(len(lines)::VARCHAR)::INT, ' ') || ': ' || lines[i]), chr(10)) AS numbered FROM s"""
)
def sc2_line_numbers_whole(spark, sf_dir):
    """SC2 at the limit of a run."""
    d, most = t(spark, sf_dir, "documents"), bundle.Options.max_file_bytes
    return d.select("doc_id", X.over_limit(F.col("text"), most).alias("truncated"), X.with_line_numbers(F.col("text"), most).alias("numbered"))


@query(
    """SELECT doc_id, CASE WHEN length(text) > 12000 THEN substring(text, 1, 12000) || chr(10) || '... [truncated, file continues]' ELSE text END AS patch,
 CASE WHEN length(text) > 20000 THEN substring(text, 1, 20000) || chr(10) || '... [truncated, file continues]' ELSE text END AS short_body,
 CASE WHEN length(text) > 45000 THEN substring(text, 1, 45000) || chr(10) || '... [truncated, file continues]' ELSE text END AS body FROM documents"""
)
def sc3_trimmed_whole(spark, sf_dir):
    """SC3, SC4 at the limits of the renderings."""
    caps = {"patch": render.PATCH_CAP, "short_body": render.SHORT_BODY_CAP, "body": render.BODY_CAP}
    return t(spark, sf_dir, "documents").select("doc_id", *(X.trimmed(F.col("text"), most).alias(n) for n, most in caps.items()))


@query(
    """SELECT conv_id, turn, array_to_string(list_filter(string_split(c, chr(10)), lambda x: x LIKE '- %' OR regexp_matches(x, '^##\\s')), chr(10)) AS kept
 FROM (SELECT conv_id, turn, replace(replace(text, '. ', chr(10) || '- '), ', ', chr(10) || '## ') AS c FROM conversations)"""
)
def prs12_memory_lines(spark, sf_dir):
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\n- ")), F.lit(", "), F.lit("\n## "))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", X.memory_lines(text).alias("kept"))


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(replace(text, ' the ', ' export const '), '(?:^|\\s)export\\s+(?:default\\s+)?(?:async\\s+)?(?:function\\*?|class|const|let|var|interface|type|enum)\\s+(\\w+)', 1))), ',') AS names FROM documents"""
)
def prs10_exported_names(spark, sf_dir):
    source = F.replace(F.col("text"), F.lit(" the "), F.lit(" export const "))
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(X.exported_names(source)), ",").alias("names"))


@query(
    """SELECT b.item_id, d.doc_id,
  len(list_filter(list_distinct(string_split(d.text, ' ')), lambda w: NOT list_contains(string_split(b.text, ' '), w)))::INT AS missed,
  len(list_filter(list_distinct(string_split(b.text, ' ')), lambda w: NOT list_contains(string_split(d.text, ' '), w)))::INT AS extra,
  len(list_distinct(list_concat(string_split(d.text, ' '), string_split(b.text, ' '))))::INT AS every
 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"""
)
def ag10_set_differences(spark, sf_dir):
    """AG10, ST2, ST3: words of documents against those of a benchmark item."""
    items = t(spark, sf_dir, "benchmark")
    n = items.count()
    d = t(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("a"), (F.col("doc_id") % max(n, 1)).alias("item_id"))
    both = d.join(items.select("item_id", F.split("text", " ").alias("b")), "item_id")
    return both.select(
        "item_id", "doc_id", F.size(F.array_except("a", "b")).alias("missed"), F.size(F.array_except("b", "a")).alias("extra"), F.size(F.array_union("a", "b")).alias("every")
    )


@query(f"WITH {_SQL_LINKS} SELECT page_id, ord, href FROM links")
def prs_extract_links(spark, sf_dir):
    """The 1-to-n extraction of links from pages."""
    return _links(spark, sf_dir)


# --- sources -------------------------------------------------------------------------

_SQL_STATUS_LINE = "l_returnflag || CASE WHEN l_returnflag = 'R' THEN '087' ELSE '' END || chr(9) || 'f' || l_partkey || chr(9) || 'g' || l_suppkey"


@query(
    """SELECT l_orderkey::INT AS ord, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS status,
  CASE WHEN l_returnflag = 'R' THEN 'g' || l_suppkey ELSE 'f' || l_partkey END AS path, CASE WHEN l_returnflag = 'R' THEN 'f' || l_partkey END AS prev_path FROM lineitem"""
)
def src3_name_status(spark, sf_dir):
    """SRC3, SC14: lines made of flags, parts and suppliers."""
    li = t(spark, sf_dir, "lineitem")
    flag = F.concat(F.col("l_returnflag"), F.when(F.col("l_returnflag") == "R", "087").otherwise(""))
    line = F.concat_ws("\t", flag, F.concat(F.lit("f"), "l_partkey"), F.concat(F.lit("g"), "l_suppkey"))
    return D.parse_name_status(li.select(F.col("l_orderkey").alias("ord"), line.alias("value")))


@query(
    """SELECT 'f' || l_partkey AS path, CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_linenumber END::BIGINT AS additions, l_suppkey::BIGINT AS deletions FROM lineitem"""
)
def src5_numstat(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    added = F.when(F.col("l_linestatus") == "F", "-").otherwise(F.col("l_linenumber").cast("string"))
    return D.parse_numstat(li.select(F.concat_ws("\t", added, F.col("l_suppkey").cast("string"), F.concat(F.lit("f"), "l_partkey")).alias("value")))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '[/:]([^/:]+/[^/:]+?)(?:\\.git)?$', 1), ''), 'none') AS repo FROM pages")
def src7_repo_name(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", D.repo_name(F.col("url"), "none").alias("repo"))


@query(
    """SELECT doc_id, first(quality ORDER BY p) AS quality, min(p)::INT AS source_prio FROM (
  SELECT doc_id, quality, 0 AS p FROM labels UNION ALL SELECT doc_id, NULL, 1 FROM documents) GROUP BY doc_id"""
)
def st1_first_seen(spark, sf_dir):
    """ST1, AG15: labels first, then documents."""
    labels = t(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = t(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("int").alias("quality"))
    return L.first_seen(labels, docs, key="doc_id")


# --- resolution ------------------------------------------------------------------------


def _link_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as relative imports of pages, distinct within a page."""
    links = _links(spark, sf_dir).groupBy("page_id", "href").agg(F.min("ord").alias("ord"))
    return links.select(
        F.concat(F.lit("site/pages/"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), "ord",
        F.concat(F.lit(".."), "href").alias("specifier"), F.lit("static").alias("type"), F.array(F.lit("x")).alias("named_symbols"),
    )


def _link_entries(links: DataFrame) -> DataFrame:
    """What exists for links: by the digest of the name a .ts file, an index below it, or an asset."""
    name = links.select("href").distinct()
    digit = F.substring(F.md5("href"), 1, 1)
    base = F.concat(F.lit("site"), "href")
    path = F.when(digit < "4", F.concat(base, F.lit(".ts"))).when(digit < "8", F.concat(base, F.lit("/index.tsx"))).when(digit < "a", F.concat(base, F.lit(".json")))
    return name.select(path.alias("path"), (digit < "8").alias("indexed")).filter("path is not null")


_SQL_RESOLVED = f"""{_SQL_LINKS}, i AS (SELECT page_id, href, min(ord) AS ord, md5(href)[1:1] AS d FROM links GROUP BY page_id, href),
 e AS (SELECT 'site/pages/' || page_id || '.ts' AS src, ord::INT AS ord, '..' || href AS specifier, CASE WHEN d < '4' THEN 'site' || href || '.ts'
  WHEN d < '8' THEN 'site' || href || '/index.tsx' WHEN d < 'a' THEN 'site' || href || '.json' END AS resolved_path FROM i)"""


def _link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve_imports(_link_imports(spark, sf_dir), _link_entries(_links(spark, sf_dir)))


@query(f"WITH {_SQL_RESOLVED} SELECT src, ord, specifier, CASE WHEN resolved_path IS NULL THEN 'external' ELSE 'internal' END AS kind, resolved_path FROM e")
def jn2_candidate_ladder(spark, sf_dir):
    """JN1, JN2, JN7: links resolved by the candidate ladder."""
    return _link_edges(spark, sf_dir).select("src", "ord", "specifier", "kind", "resolved_path")


@query(f"WITH {_SQL_RESOLVED} SELECT count(resolved_path)::BIGINT AS internal, (count(*) - count(resolved_path))::BIGINT AS external FROM e")
def ag1_edge_count(spark, sf_dir):
    """AG1, FL1, FL2."""
    return _link_edges(spark, sf_dir).agg(F.count_if(F.col("kind") == "internal").alias("internal"), F.count_if(F.col("kind") == "external").alias("external"))


_RESOLUTION_SPECIFIER = "CASE WHEN page_id % 3 = 0 THEN '.' || href WHEN page_id % 3 = 1 THEN '@' || href ELSE substring(href, 2, 100) END"


@query(
    f"""WITH {_SQL_LINKS}, s AS (SELECT {_RESOLUTION_SPECIFIER} AS specifier FROM links)
 SELECT CASE WHEN regexp_matches(specifier, '^(\\./|\\.\\./|/)') THEN 'relative' WHEN specifier LIKE '@/%' THEN 'alias' ELSE 'fine' END AS broken, count(*)::BIGINT AS n FROM s GROUP BY 1"""
)
def fl3_broken_specifiers(spark, sf_dir):
    """FL3, FL4, AG9: links as external specifiers."""
    links = _links(spark, sf_dir).select(F.expr(_RESOLUTION_SPECIFIER).alias("specifier"))
    return links.select(F.coalesce(A.resolution_class(F.col("specifier")), F.lit("fine")).alias("broken")).groupBy("broken").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_SQL_LINKS}, s AS (SELECT DISTINCT '@' || href AS specifier FROM links)
 SELECT specifier, ['app/src' || substring(specifier, 2), 'app/lib' || substring(specifier, 2)] AS targets FROM s WHERE specifier LIKE '@/%'"""
)
def jn3_alias_targets(spark, sf_dir):
    """JN3: links below a pattern with two targets."""
    specifiers = _links(spark, sf_dir).select(F.concat(F.lit("@"), "href").alias("specifier")).distinct().filter(F.col("specifier").startswith("@/"))
    pattern = lambda p, *targets: F.struct(F.lit(p).alias("pattern"), F.array(*map(F.lit, targets)).alias("targets"))
    config = F.struct(F.lit("app").alias("base_dir"), F.array(pattern("@/*", "./src/*", "lib/*"), pattern("exact", "y")).alias("patterns"))
    return specifiers.withColumn("config", config).select("specifier", R.alias_targets(F.col("specifier"), F.col("config")).alias("targets"))


@query(
    f"""WITH {_SQL_FILES}, c AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM files WHERE path LIKE '%/src/%' OR path LIKE '%/react/%' UNION SELECT 'apps' UNION SELECT ''),
 a AS (SELECT path, array_to_string(string_split(path, '/')[1:n], '/') AS dir, n FROM (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS n FROM files))
 SELECT path, arg_max(a.dir, n) AS config FROM a JOIN c USING (dir) GROUP BY path"""
)
def jn4_nearest_ancestor(spark, sf_dir):
    """JN4: the nearest configured directory above each path."""
    files = _files(spark, sf_dir)
    dirs = files.filter("path LIKE '%/src/%' OR path LIKE '%/react/%'").select(P.dirname(F.col("path")).alias("dir")).distinct()
    fixed = spark.createDataFrame([("apps",), ("",)], "dir string")
    configs = dirs.union(fixed).select("dir", F.col("dir").alias("config"))
    return R.nearest_config(files, configs)


@query(
    """SELECT s AS specifier, list(base ORDER BY w, b) AS bases FROM (
  SELECT s, w, unnest(CASE WHEN s = name THEN ['packages/' || name || '/src', 'packages/' || name || '/src/index', 'packages/' || name, 'packages/' || name || '/index']
    ELSE ['packages/' || name || '/src' || substring(s, length(name) + 1), 'packages/' || name || substring(s, length(name) + 1)] END) AS base,
   unnest(CASE WHEN s = name THEN [0, 1, 2, 3] ELSE [0, 1] END) AS b FROM (
   SELECT n_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '/c' || c_custkey END AS s, n_name AS name, n_nationkey AS w FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
 ) GROUP BY s"""
)
def jn6_workspace_targets(spark, sf_dir):
    """JN6, SC16: customers import the package of their nation, whole or in part."""
    nations = t(spark, sf_dir, "nation")
    packages = nations.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.concat(F.lit("packages/"), "n_name").alias("dir"))
    c = t(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    spec = F.concat(F.col("n_name"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("/c"), F.col("c_custkey").cast("string"))))
    found = R.workspace_targets(c.select(spec.alias("specifier")), packages)
    return found.groupBy("specifier").agg(L.ordered(["w_ord"], F.col("base")).alias("bases"))


# --- graph -----------------------------------------------------------------------------


def _supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from suppliers to parts, one a line item."""
    li = t(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.col("l_orderkey").alias("ord"), F.lit("internal").alias("kind"),
        F.lit("static").alias("type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("resolved_path"), F.array(F.col("l_linenumber").cast("string")).alias("named_symbols"),
    )


@query(
    "SELECT 'p' || l_partkey AS path, count(*)::BIGINT AS n, string_agg('s' || l_suppkey, ',' ORDER BY l_orderkey, 's' || l_suppkey) AS importers FROM lineitem GROUP BY 1"
)
def jn8_reverse_edges(spark, sf_dir):
    """JN8: parts and the suppliers that name them, repeats included."""
    back = R.reverse_edges(_supply_edges(spark, sf_dir)).withColumn("by", F.col("importer"))
    return back.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(L.ordered(["ord", "by"], F.col("importer")), ",").alias("importers"))


def _tree_arcs(spark: SparkSession, sf_dir: str, forward: bool) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"), F.col("c_custkey").alias("o"))
    n = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("b"), F.col("n_nationkey").cast("long").alias("o"))
    node, after = ("a", "b") if forward else ("b", "a")
    return c.unionByName(n).select(F.col(node).alias("node"), F.col("o").alias("arc_ord"), F.col(after).alias("next"), F.array().cast("array<string>").alias("symbols"), F.lit("static").alias("type"))


_HOP_COLUMNS = ("start", "hop", "pos", "path", "via")


@query(
    """SELECT 'c' || c_custkey AS start, 1::INT AS hop, 0::INT AS pos, 'n' || c_nationkey AS path, 'c' || c_custkey AS via FROM customer
 UNION ALL SELECT 'c' || c_custkey, 2, 0, 'r' || n_regionkey, 'n' || c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey"""
)
def gr1_bfs_forward(spark, sf_dir):
    """GR1, GR5, GR6: customers to nations to regions."""
    arcs = _tree_arcs(spark, sf_dir, True)
    starts = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"))
    return G.traverse(starts, arcs, "forward").select(*_HOP_COLUMNS)


_SQL_REVERSE = """t1 AS (SELECT * FROM (SELECT 'r' || n_regionkey AS start, 1 AS hop, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos,
   'n' || n_nationkey AS path, 'r' || n_regionkey AS via FROM nation) WHERE pos < 6),
 c2 AS (SELECT t1.start, t1.pos AS ppos, t1.path AS via, c_custkey, row_number() OVER (PARTITION BY t1.start, t1.path ORDER BY c_custkey) AS k
  FROM t1 JOIN customer ON 'n' || c_nationkey = t1.path),
 t2 AS (SELECT * FROM (SELECT start, 2 AS hop, row_number() OVER (PARTITION BY start ORDER BY ppos, c_custkey) - 1 AS pos, 'c' || c_custkey AS path, via FROM c2 WHERE k <= 6) WHERE pos < 15),
 h AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2)"""


def _reverse_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    return G.traverse(starts, _tree_arcs(spark, sf_dir, False), "reverse")


@query(f"WITH {_SQL_REVERSE} SELECT start, hop::INT AS hop, pos::INT AS pos, path, via FROM h")
def gr2_bfs_reverse(spark, sf_dir):
    """GR2 to GR4: regions to nations to customers; both caps bind."""
    return _reverse_hops(spark, sf_dir).select(*_HOP_COLUMNS)


@query(f"WITH {_SQL_REVERSE} SELECT start, string_agg(n::VARCHAR, ',' ORDER BY hop) AS sizes FROM (SELECT start, hop, count(*) AS n FROM h GROUP BY start, hop) GROUP BY start")
def ag16_tier_sizes(spark, sf_dir):
    """AG16: sizes of nested tiers."""
    tiers = G.tiers_of(_reverse_hops(spark, sf_dir), schemas.TIERS_TYPE)
    return tiers.select("start", F.array_join(F.transform("tiers", lambda x: F.size(x).cast("string")), ",").alias("sizes"))


_NODE = "struct_pack(path := ''::VARCHAR, via := ''::VARCHAR)"
_FOLD = f"""list_filter(list_reduce(list_prepend([{_NODE}], list_transform(c, lambda e: [e])),
  lambda acc, e: CASE WHEN len(list_filter(acc, lambda q: q.path = e[1].path)) > 0 OR len(list_filter(acc, lambda q: q.via = e[1].via)) >= 6 THEN acc ELSE list_concat(acc, e) END), lambda q: q.path <> '')"""


@query(
    f"""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_suppkey AS so, l_partkey AS po FROM lineitem),
 t1 AS (SELECT * FROM (SELECT s AS start, p AS path, s AS via, (row_number() OVER (PARTITION BY s ORDER BY po) - 1)::INT AS pos FROM e) WHERE pos < 6),
 c2 AS (SELECT start, list(struct_pack(path := e.s, via := t1.path) ORDER BY t1.pos, e.so) AS c FROM t1 JOIN e ON e.p = t1.path WHERE e.s <> start GROUP BY start),
 f AS (SELECT start, ({_FOLD})[1:15] AS tier FROM c2),
 t2 AS (SELECT start, tier[i].path AS path, tier[i].via AS via, (i - 1)::INT AS pos FROM (SELECT start, tier, unnest(range(1, len(tier) + 1)) AS i FROM f))
 SELECT start, 1::INT AS hop, pos, path, via FROM t1 UNION ALL SELECT start, 2::INT, pos, path, via FROM t2"""
)
def gr3_bfs_capped_shared(spark, sf_dir):
    """GR3, GR4: suppliers and parts share children, so that caps and removal depend on each other."""
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    plain = [F.array().cast("array<string>").alias("symbols"), F.lit("static").alias("type")]
    arcs = li.select(s.alias("node"), F.col("l_partkey").alias("arc_ord"), p.alias("next"), *plain)
    arcs = arcs.unionByName(li.select(p.alias("node"), F.col("l_suppkey").alias("arc_ord"), s.alias("next"), *plain))
    return G.traverse(li.select(s.alias("start")).distinct(), arcs, "forward").select(*_HOP_COLUMNS)


@query(
    f"""WITH {_SQL_REVERSE}, x AS (SELECT start, hop, path, CASE WHEN hop = 2 AND pos % 5 = 4 THEN 'elsewhere' ELSE via END AS via FROM h)
 SELECT count(*) FILTER (via <> 'elsewhere')::BIGINT AS valid, count(*) FILTER (via = 'elsewhere')::BIGINT AS invalid FROM x WHERE hop = 2"""
)
def jn16_hop_integrity(spark, sf_dir):
    """JN16, AG11: hops with some parents made wrong."""
    hops = _reverse_hops(spark, sf_dir)
    wrong = (F.col("hop") == 2) & (F.col("pos") % 5 == 4)
    return A.hop_integrity(hops.withColumn("via", F.when(wrong, "elsewhere").otherwise(F.col("via"))))[1]


# --- lanes ---------------------------------------------------------------------------------


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return t(spark, sf_dir, "customer").select(name.alias("path"), F.col("c_custkey").alias("ord"))


@query(
    """WITH f AS (SELECT 'n' || c_nationkey || '/c' || lpad(c_custkey::VARCHAR, 12, '0') AS path, c_nationkey AS d FROM customer),
 l AS (SELECT d, list(path ORDER BY path)[1:21] AS names FROM f GROUP BY d)
 SELECT path, list_filter(names, lambda x: x <> path)[1:20] AS siblings FROM f JOIN l USING (d)"""
)
def jn10_siblings(spark, sf_dir):
    """JN10, LM4: customers of one nation."""
    files = _customer_files(spark, sf_dir)
    return L.siblings(files, files)


@query("SELECT a.n_name AS path, list(b.n_name ORDER BY b.n_nationkey) AS others FROM nation a JOIN nation b ON a.n_name <> b.n_name GROUP BY a.n_name")
def jn11_other_members(spark, sf_dir):
    return L.other_members(t(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.col("n_nationkey").alias("ord")))


@query(
    """WITH r AS (SELECT 'c' || o_custkey AS path, 'o' || o_orderkey AS caller, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
 SELECT path, list(caller ORDER BY k) AS callers FROM r WHERE k <= 15 GROUP BY path"""
)
def jn9_direct_callers(spark, sf_dir):
    """JN9, LM3: orders of customers."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    o = t(spark, sf_dir, "orders")
    arcs = o.select(key("c", "o_custkey").alias("node"), F.col("o_orderkey").alias("arc_ord"), key("o", "o_orderkey").alias("next"), F.array().cast("array<string>").alias("symbols"), F.lit("static").alias("type"))
    changed = t(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("path"))
    return L.direct_callers(arcs, changed).select("path", F.transform("callers", lambda c: c["path"]).alias("callers"))


@query(
    """SELECT 'n' || n_nationkey AS path, 'r' || r_regionkey AS dependency, '1: ' || r_name AS content, false AS truncated FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def jn12_dependency_contents(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.col("n_nationkey").alias("ord"), F.lit("internal").alias("kind"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("resolved_path"),
    )
    files = t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_name").alias("content"))
    found = L.dependency_contents(n, files, n.select(F.col("src").alias("path")), 1000)
    return found.select("path", F.explode("contents").alias("dependency", "v")).select("path", "dependency", "v.content", "v.truncated")


@query(
    """WITH u AS (SELECT event_type, user_id, min(event_id) AS o FROM events GROUP BY event_type, user_id)
 SELECT event_type AS path, min(o)::BIGINT AS ord, string_agg('u' || user_id, ',' ORDER BY o) AS users FROM u GROUP BY event_type"""
)
def ag4_external_merge(spark, sf_dir):
    """AG4, SC9: the distinct users of an event type, in order of appearance."""
    e = t(spark, sf_dir, "events").select(
        F.col("event_type").alias("src"), F.col("event_id").alias("ord"), F.lit("external").alias("kind"), F.lit("users").alias("specifier"),
        F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("named_symbols"),
    )
    return B.merge_external(e).select("path", "ord", F.array_join("named_symbols", ",").alias("users"))


@query("SELECT count(*)::BIGINT AS checked, count(*) FILTER (l.doc_id IS NULL)::BIGINT AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn15_existence(spark, sf_dir):
    """JN15, AG8, ST4: documents without a label."""
    marked = A.missing_marked(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels"), "doc_id")
    return A.existence_counters(marked)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    severity = F.when(F.col("value") > 60, "error").when(F.col("value") > 20, "warning").otherwise("info")
    return e.select(severity.alias("severity"), F.col("event_type").alias("category"), F.col("event_id").cast("string").alias("file"), F.lit("m").alias("message"))


@query(
    """SELECT event_type AS category, count(*) FILTER (value > 60)::BIGINT AS error, count(*) FILTER (value <= 60 AND value > 20)::BIGINT AS warning,
  count(*) FILTER (value <= 20)::BIGINT AS info FROM events GROUP BY event_type"""
)
def ag12_issue_pivot(spark, sf_dir):
    return A.issue_pivot(_issues(spark, sf_dir))


@query("SELECT CASE WHEN value > 60 THEN 'error' WHEN value > 20 THEN 'warning' ELSE 'info' END AS severity, event_type AS category, event_id::VARCHAR AS file FROM events ORDER BY event_type, severity, event_id::VARCHAR LIMIT 20")
def lm10_issue_sample(spark, sf_dir):
    """LM10: the first issues of a report; the limit is the feature."""
    return _issues(spark, sf_dir).orderBy("category", "severity", "file").limit(20).select("severity", "category", "file")


@query(
    """SELECT count(*)::BIGINT AS checked, count(*) FILTER (n_nationkey % 5 > 1)::BIGINT AS matching FROM nation"""
)
def jn18_drift(spark, sf_dir):
    """JN18: names held against names on disk, of which some changed and some are gone."""
    n = t(spark, sf_dir, "nation")
    held = n.select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("content"))
    now = F.when(F.col("n_nationkey") % 5 == 1, F.lit("changed")).otherwise(F.col("n_name"))
    disk = n.filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("string").alias("name"), now.alias("content"))
    return A.drift(held, disk, "rules")[1]


@query(
    """SELECT o_orderkey, '- `' || 'o' || o_orderkey || '`' || CASE WHEN n > 0 THEN ' { ' || names || ' }' ELSE '' END AS line FROM (
  SELECT o_orderkey, count(l_partkey) AS n, string_agg('p' || l_partkey, ', ' ORDER BY l_linenumber, l_partkey) AS names FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""
)
def sc8_import_lines(spark, sf_dir):
    """SC8, SC10, SC13: an order as an import of parts."""
    li = t(spark, sf_dir, "lineitem").withColumn("p", F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    names = li.groupBy("l_orderkey").agg(L.ordered(["l_linenumber", "l_partkey"], F.col("p")).alias("names"))
    joined = t(spark, sf_dir, "orders").select("o_orderkey").join(names, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    listed = F.coalesce("names", F.array().cast("array<string>"))
    path = X.code(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    return joined.select("o_orderkey", F.concat(F.lit("- "), X.with_symbols(path, listed)).alias("line"))


# --- scanning, admission and rendering ------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each order: it imports parts from suppliers and declares itself."""
    li = t(spark, sf_dir, "lineitem")
    row = F.format_string("import { p%d as x } from './s%d';", F.col("l_partkey"), F.col("l_suppkey"))
    lines = li.groupBy("l_orderkey").agg(L.ordered(["l_linenumber", "l_partkey", "l_suppkey"], row).alias("lines"))
    o = t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n")
    key = F.col("o_orderkey").cast("string")
    body = F.concat(
        head, F.lit("\n// import no from 'no'\nexport const c"), key, F.lit(" = () => `${require('q')}`, d"), key, F.lit(" = 1;\nfunction f"), key,
        F.lit("() { const inner = () => 1 }\nexport default class K"), key, F.lit(" {}\n"),
    )
    return o.select(F.concat(F.lit("o"), key, F.lit(".ts")).alias("path"), body.alias("content"))


@query(
    """WITH i AS (SELECT l_orderkey, count(*) AS n, string_agg('./s' || l_suppkey || '{p' || l_partkey || '}', ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS imports FROM lineitem GROUP BY l_orderkey)
 SELECT 'o' || o_orderkey || '.ts' AS path, 'c' || o_orderkey || ',d' || o_orderkey || ',default' AS exports, 'c' || o_orderkey || ',f' || o_orderkey AS functions,
  'K' || o_orderkey AS classes, coalesce(imports || ';', '') || 'q{}' AS imports FROM orders LEFT JOIN i ON l_orderkey = o_orderkey"""
)
def prs1_scan_sources(spark, sf_dir):
    """PRS1 to PRS9, PRS13: sources made of orders, scanned."""
    found = extract.analyze_files(_sources(spark, sf_dir))
    shown = F.transform("imports", lambda i: F.concat(i["specifier"], F.lit("{"), F.array_join(i["named_symbols"], ","), F.lit("}")))
    names = lambda k: F.array_join(F.col(f"symbols.{k}"), ",").alias(k)
    return found.select("path", names("exports"), names("functions"), names("classes"), F.array_join(shown, ";").alias("imports"))


@query("SELECT 'o' || o_orderkey || '.ts' AS path, 0::INT AS missed, 0::INT AS extra FROM orders")
def ag10_symbol_recall(spark, sf_dir):
    """AG10, PRS11: names that a plain pattern finds in stripped sources against those of the scanner."""
    files = _sources(spark, sf_dir)
    plain = extract.stripped_sources(files).select("path", X.exported_names(F.col("stripped")).alias("plain"))
    both = extract.analyze_files(files).join(plain, "path")
    known = F.array_union(F.array_union("symbols.exports", "symbols.functions"), "symbols.classes")
    # of a list of variables the pattern sees the first; d is the second
    extra = F.filter(F.array_except("symbols.exports", "plain"), lambda n: (n != "default") & ~n.startswith("d"))
    return both.select("path", F.size(F.array_except("plain", known)).alias("missed"), F.size(extra).alias("extra"))


@query(
    f"""WITH {_SQL_FILES}, m AS (SELECT *, CASE WHEN regexp_matches(path, '\\.(js|jsx|ts|tsx|mjs|cjs)$') AND NOT regexp_matches(path, '\\.d\\.(ts|mts|cts)$')
   THEN CASE WHEN path LIKE 'apps/%' THEN 0 WHEN path LIKE 'packages/react/%' THEN 1 END END AS p,
   status NOT IN ('deleted') AND doc_id IN (SELECT doc_id FROM labels) AND regexp_matches(path, '\\.(js|jsx|ts|tsx|mjs|cjs)$') AS forced FROM files)
 SELECT count(*) FILTER (p = 0)::BIGINT AS walked, count(*) FILTER (p = 1)::BIGINT AS packages, count(*) FILTER (p IS NULL AND forced)::BIGINT AS changes FROM m"""
)
def ag15_scope_counters(spark, sf_dir):
    """FL12, FL13, AG15: the index of a scope, a package and changed files."""
    files = _files(spark, sf_dir)
    changed = files.join(t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("path", "status")
    return tree.scope_counters(tree.index_of(files.select("path"), changed, "apps", ["packages/react"]))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file entries of a bundle; their lanes are made of their numbers."""
    d = _files(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    name = lambda p: F.concat(F.lit(p), key)
    edge = lambda kind, spec, path, names: F.struct(
        spec.alias("specifier"), F.lit(kind).alias("kind"), F.lit("static").alias("type"), path.alias("resolvedPath"), names.alias("namedSymbols")
    )
    none = F.array().cast("array<string>")
    hop = F.struct(name("two").alias("path"), name("one").alias("via"), none.alias("viaSymbols"), F.lit("static").alias("type"))
    imports = F.array(
        edge("internal", F.lit("./i"), name("i"), F.array(name("x"), F.lit("y"))), edge("external", F.lit("lib"), F.lit(None).cast("string"), F.array(F.lit("b"))),
        edge("external", F.lit("lib"), F.lit(None).cast("string"), F.array(F.lit("b"), F.lit("c"))), edge("internal", F.lit("./j"), name("j"), none),
    )
    return d.select(
        "doc_id",
        F.struct(
            "path", F.lit(None).cast("string").alias("prevPath"), "status", "additions", "deletions", F.col("text").alias("patch"), F.col("text").alias("fullContent"),
            F.struct(F.array(name("e")).alias("exports"), none.alias("functions"), F.array(F.lit("A"), F.lit("B")).alias("classes")).alias("symbols"),
            imports.alias("directImports"),
            F.array(F.struct(name("caller").alias("path"), F.array(F.lit("u")).alias("importedSymbols"), F.lit("static").alias("type"))).alias("directCallers"),
            F.struct(F.array(F.array(hop), F.array(hop)).alias("forwardTiers"), F.array(F.array(hop)).alias("reverseTiers")).alias("multiHop"),
            F.array(F.struct(name("n").alias("path"), (F.col("additions") / 100).alias("score"), F.array(F.lit("forward"), F.lit("reverse")).alias("alsoIn"))).alias("semanticNeighbors"),
        ).alias("f"),
    )


_N = "chr(10)"
_SQL_HEAD = f"'## `' || path || '`' || {_N} || {_N} || 'Status: **' || status || '**  +' || additions || ' / -' || deletions"
_SQL_SYMBOLS = f"{_N} || {_N} || 'Symbols' || {_N} || '- exports: `e' || doc_id || '`' || {_N} || '- functions: _(none)_' || {_N} || '- classes: `A`, `B`'"
_SQL_CUT = "CASE WHEN length(text) > 12000 THEN substring(text, 1, 12000) || chr(10) || '... [truncated, file continues]' ELSE text END"
_SQL_PATCH = f"{_N} || {_N} || '### Patch' || {_N} || {_N} || '```diff' || {_N} || coalesce(nullif(trim({_SQL_CUT}, ' '), ''), '(no patch)') || {_N} || '```'"


def _sql_body(cap: int) -> str:
    cut = f"CASE WHEN length(text) > {cap} THEN substring(text, 1, {cap}) || {_N} || '... [truncated, file continues]' ELSE text END"
    return f"{_N} || {_N} || '### Body' || {_N} || {_N} || '```' || {_N} || coalesce(nullif(trim({cut}, ' '), ''), '(no body)') || {_N} || '```' || {_N}"


@query(f"WITH {_SQL_FILES} SELECT doc_id, {_SQL_HEAD} || {_SQL_SYMBOLS} || {_SQL_PATCH} || {_sql_body(45_000)} AS section FROM files")
def rn1_quality_section(spark, sf_dir):
    """RN1, SC4, SC13."""
    return _entries(spark, sf_dir).select("doc_id", render.file_section(F.col("f"), "pass1+3").alias("section"))


@query(
    f"""WITH {_SQL_FILES} SELECT doc_id, {_SQL_HEAD} || {_SQL_SYMBOLS} || {_N} || {_N} || '### Imports within the repository' || {_N} || '- `i' || doc_id || '` {{ x' || doc_id || ', y }}'
  || {_N} || '- `j' || doc_id || '`' || {_N} || {_N} || '### Callers' || {_N} || '- `caller' || doc_id || '` uses {{ u }}' || {_N} || {_N} || '### Two hops forward' || {_N}
  || '- `two' || doc_id || '` via `one' || doc_id || '`' || {_N} || {_N} || '### Two hops back' || {_N} || '_(none)_' || {_SQL_PATCH} || {_N} AS section FROM files"""
)
def rn2_contract_section(spark, sf_dir):
    """RN2, SC8, SC10, SC11, LM5, LM6."""
    return _entries(spark, sf_dir).select("doc_id", render.file_section(F.col("f"), "pass2").alias("section"))


@query(
    f"WITH {_SQL_FILES} SELECT doc_id, {_SQL_HEAD} || {_N} || {_N} || '### Outside dependencies' || {_N} || '- `lib` {{ b, c }}' || {_SQL_PATCH} || {_sql_body(20_000)} AS section FROM files"
)
def rn3_outside_section(spark, sf_dir):
    """RN3, SC9."""
    return _entries(spark, sf_dir).select("doc_id", render.file_section(F.col("f"), "pass4").alias("section"))


@query(f"WITH {_SQL_FILES} SELECT doc_id, '  ' || printf('%.3f', additions / 100) || '  n' || doc_id || ' [also in forward+reverse]' AS line FROM files")
def sc12_neighbor_lines(spark, sf_dir):
    """SC12, LM7."""
    return _entries(spark, sf_dir).select("doc_id", render.neighbors(F.col("f")).alias("line"))


@query(
    f"""WITH {_SQL_FILES} SELECT ref, count(*)::BIGINT AS n FROM (
  SELECT path AS ref FROM files WHERE status <> 'deleted' UNION ALL SELECT 'i' || doc_id FROM files UNION ALL SELECT 'j' || doc_id FROM files
  UNION ALL SELECT 'caller' || doc_id FROM files UNION ALL SELECT 'two' || doc_id FROM files CROSS JOIN range(3) UNION ALL SELECT 'n' || doc_id FROM files) GROUP BY ref"""
)
def st4_path_references(spark, sf_dir):
    """ST4, GR5: every path that file entries name."""
    return A.path_references(_entries(spark, sf_dir).select("f.*")).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


# --- sources, caches, picks and renderings on tables made of the driver's ----------------------


@query(
    f"""WITH {_SQL_LINKS}, i AS (SELECT page_id, href, min(ord) AS ord, md5(href)[1:1] AS d FROM links GROUP BY page_id, href)
 SELECT 'site/pages/' || page_id || '.ts' AS src, ord::INT AS ord, CASE page_id % 3 WHEN 0 THEN '..' WHEN 1 THEN '@' ELSE 'w' END || href AS specifier,
  CASE WHEN d < '4' THEN 'site' || href || '.ts' WHEN d < '8' THEN 'site' || href || '/index.tsx' WHEN d < 'a' THEN 'site' || href || '.json' END AS resolved_path FROM i"""
)
def jn1_resolution_cascade(spark, sf_dir):
    """JN1: the same links as relative, aliased and workspace imports, by page, in one resolution."""
    kind = F.substring_index(F.regexp_extract("path", r"(\d+)\.ts$", 1), ".", 1).cast("long") % 3
    lead = F.when(kind == 0, "..").when(kind == 1, "@").otherwise("w")
    imports = _link_imports(spark, sf_dir).withColumn("specifier", F.concat(lead, F.substring("specifier", 3, 1 << 20)))
    configs = spark.createDataFrame([("", ("", [("@/*", ["site/*"])]))], "dir string, config struct<base_dir:string,patterns:array<struct<pattern:string,targets:array<string>>>>")
    packages = spark.createDataFrame([(0, "w", "site")], "ord int, name string, dir string")
    return R.resolve_imports(imports, _link_entries(_links(spark, sf_dir)), configs, packages).select("src", "ord", "specifier", "resolved_path")


@query("SELECT 'n' || n_nationkey AS dir, 'b' || n_regionkey AS base_dir, 'x' || n_regionkey || '/*' AS target FROM nation")
def jn5_inherited_configs(spark, sf_dir):
    """JN5, SRC10: each nation's config extends its region's."""
    n, key = t(spark, sf_dir, "nation"), lambda c: F.col(c).cast("string")
    own = n.select(F.concat(F.lit("n"), key("n_nationkey"), F.lit("/tsconfig.json")).alias("path"), F.format_string('{"extends": "../tsconfig.r%d", } // own', "n_regionkey").alias("content"))
    base = F.format_string('{"compilerOptions": {"baseUrl": "b%1$d", "paths": {"@/*": ["x%1$d/*"]}}}', "n_regionkey")
    over = n.select(F.concat(F.lit("tsconfig.r"), key("n_regionkey"), F.lit(".json")).alias("path"), base.alias("content")).distinct()
    found = config.configs(own.unionByName(over))
    return found.select("dir", F.col("config.base_dir").alias("base_dir"), F.col("config.patterns")[0]["targets"][0].alias("target"))


@query("SELECT '@o/' || n_name AS name, 'packages/p' || n_nationkey AS dir FROM nation")
def src11_workspaces(spark, sf_dir):
    """SRC11: a package for each nation below a listed folder, and others that no list names."""
    n = t(spark, sf_dir, "nation")
    path = lambda folder: F.format_string(f"{folder}/p%d/package.json", "n_nationkey").alias("path")
    content = F.concat(F.lit('{"name": "@o/'), "n_name", F.lit('"}')).alias("content")
    listed = spark.createDataFrame([("pnpm-workspace.yaml", "packages:\n  - 'packages/*' # all\n  - none\n")], "path string, content string")
    return config.workspaces(spark, n.select(path("packages"), content).union(n.select(path("other"), content)).union(listed)).select("name", "dir")


def _length_vectors(texts: list[str]) -> list[list[float]]:
    return [[float(len(x))] for x in texts]


@query("SELECT DISTINCT sha256('m' || chr(0) || substring(text, 1, 5000)) AS key, least(length(text), 5000)::DOUBLE AS first FROM documents WHERE length(text) > 0")
def vec4_embed_missing(spark, sf_dir):
    """VEC4, VEC5: an empty cache, and vectors that hold lengths."""
    files = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    probed = E.probe(files, spark.createDataFrame([], schemas.EMBEDDING_CACHE), "m")
    return E.embed_missing(probed, _length_vectors, "m").select("key", F.col("vec")[0].alias("first"))


@query("SELECT count(*)::BIGINT AS hits, 0::BIGINT AS misses FROM documents WHERE length(text) > 0")
def snk2_embedding_cache(spark, sf_dir):
    """SNK2, SRC15, SRC12: the cache written, read again and probed."""
    files = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    path = f"{shared_folder(spark)}/ctxloom/{spark.sparkContext.applicationId}/cache-{uuid.uuid4().hex}"
    E.append_cache(E.embed_missing(E.probe(files, E.read_cache(spark, path, "m"), "m"), _length_vectors, "m"), path)
    return E.counters(E.probe(files, E.read_cache(spark, path, "m"), "m"))


@query(f"WITH {_SQL_FILES} SELECT path FROM files WHERE length(text) > 200 AND length(text) < 8000")
def fl7_meaty(spark, sf_dir):
    """FL7: files whose every lane has something; only the length of the patch tells them apart here."""
    rows = _entries(spark, sf_dir).select("f.*")
    rows = rows.withColumn("directImports", F.concat("directImports", "directImports"))
    rows = rows.withColumn("semanticNeighbors", F.flatten(F.array_repeat("semanticNeighbors", 3)))
    return rows.filter(B.meaty()).select("path")


@query(f"WITH {_SQL_FILES} SELECT path, status FROM files WHERE path LIKE '%react/6.ts' ORDER BY ord LIMIT 1")
def jn19_requested_file(spark, sf_dir):
    """JN19: the file that a suffix asks for; the one row is the feature."""
    return B.pick(_files(spark, sf_dir), "react/6.ts", F.lit(False)).select("path", "status")


@query(f"WITH {_SQL_FILES} SELECT path, 2::INT AS changed, 3::INT AS every FROM files WHERE status <> 'deleted'")
def fl10_symbol_counts(spark, sf_dir):
    """FL10, SC15: files that declare something."""
    f = _entries(spark, sf_dir).select("f.*").filter("status <> 'deleted'")
    f = f.withColumn("changed", B.symbol_count(F.col("symbols"), "functions", "classes")).withColumn("every", B.symbol_count(F.col("symbols"), "exports", "functions", "classes"))
    return f.filter(F.col("every") > 0).select("path", "changed", "every")


@query("SELECT doc_id::VARCHAR AS name, 'Work in `/w`; all relative paths are below it.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text AS content FROM documents")
def rn8_preamble(spark, sf_dir):
    """RN8, LM8: documents as prompts about a work tree."""
    return render.with_preamble(t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content")), "/w")


@query(
    """SELECT 'rules-and-memory.md' AS name, '# Rules and memory' || chr(10) || chr(10) || '## Memory (`m.md`)' || chr(10) || '```' || chr(10) || '- keep it' || chr(10) || '```' || chr(10)
  || string_agg(chr(10) || '## ' || n_name || chr(10) || '```' || chr(10) || substring(repeat(n_name || '.', 2000), 1, 8000) || chr(10) || '```' || chr(10), '' ORDER BY n_name) AS content FROM nation"""
)
def rn6_rules_and_memory(spark, sf_dir):
    """RN6, LM9: a rule for each nation, over the cap, and a memory."""
    entry = F.struct(F.col("n_name").alias("key"), F.repeat(F.concat("n_name", F.lit(".")), F.lit(2000)).alias("value"))
    rules = t(spark, sf_dir, "nation").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("rules"))
    note = F.struct(F.lit("m.md").alias("path"), F.lit(" - keep it ").alias("content"))
    return render.rules_and_memory(rules.withColumn("memory", note))
