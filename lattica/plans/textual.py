"""Queries over texts: chunks, content kinds, primitives, overlaps, ids and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import ids
from lattica.functions import text as tx
from lattica.functions.packers import packed_chunks
from lattica.functions.vector import norm
from lattica.operators import chunking, cluster, encode, fulltext, pairs
from lattica.plans.graph import r6
from lattica.plans.registry import CHUNKS, PAPERS, query
from lattica.sources import tables as tb
from lattica.sources.scratch import settle, shared_folder


def _any(column: str, signs: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, s.replace("'", "''")) for s in signs) + ")"


def _sum(column: str, signs: list[str]) -> str:
    return "(" + " + ".join("(length({0}) - length(replace({0}, '{1}', ''))) / {2}".format(column, s.replace("'", "''"), len(s)) for s in signs) + ")"


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, unnest(range(0, len(w), 512)) // 512 AS chunk_index, sha256(unnest(list_transform(range(0, len(w), 512), lambda i: array_to_string(w[i + 1:i + 512], ' ')))) AS digest FROM w""")
def word_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(tx.word_windows(F.col("text"), 512)).alias("i", "t")).select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.sha2("t", 256).alias("digest"))


@query(rf"""WITH {CHUNKS} SELECT paper_id, chunk_index, paper_id || '_chunk_' || chunk_index AS chunk_id, text, len(string_split(text, ' '))::INTEGER AS tokens FROM chunks""")
def paper_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.chunks(spark, sf_dir).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)))::INTEGER AS sentences, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::INTEGER AS words FROM documents""")
def sentence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("sentences"), tx.n_words(F.col("text")).alias("words"))


TYPED = f"""{CHUNKS}, fl AS (SELECT *, {_any("text", tx.MATH_SIGNS)} AS m, {_any("text", tx.CODE_SIGNS)} AS c, {_any("text", tx.FIGURE_SIGNS)} AS f, {_any("text", tx.TABLE_SIGNS)} AS b FROM chunks),
ty AS (SELECT *, CASE WHEN m AND {_sum("text", tx.MATH_SIGNS)} / length(text) > 0.1 THEN 'equation' WHEN c AND (contains(text, '```') OR {_sum("text", tx.CODE_SIGNS)} > 5) THEN 'code' WHEN c THEN 'mixed'
  WHEN f AND (contains(text, '\\begin{{figure}}') OR {_sum("text", ["Fig"])} > 2) THEN 'figure_caption' WHEN b AND (contains(text, '\\begin{{table}}') OR contains(text, '\\begin{{tabular}}')) THEN 'table'
  WHEN m::INTEGER + c::INTEGER + f::INTEGER + b::INTEGER > 1 THEN 'mixed' ELSE 'text' END AS chunk_type FROM fl)"""


@query(f"WITH {TYPED} SELECT chunk_type, count(*) AS n, count(*) FILTER (m) AS math, count(*) FILTER (c) AS code, count(*) FILTER (f) AS figures, count(*) FILTER (b) AS tables FROM ty GROUP BY 1")
def chunk_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    c = tb.chunks(spark, sf_dir).select("text", tx.has_math(t).alias("m"), tx.has_code(t).alias("c"), tx.has_figures(t).alias("f"), tx.has_tables(t).alias("b"))
    c = c.select(tx.chunk_type(t, tuple(map(F.col, "mcfb"))).alias("chunk_type"), "m", "c", "f", "b")
    return c.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("m").alias("math"), F.count_if("c").alias("code"), F.count_if("f").alias("figures"), F.count_if("b").alias("tables"))


LINE = r"""regexp_replace(l, '^\s+|\s+$', '', 'g')"""


@query(rf"""WITH li AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:10], lambda l: {LINE}) AS ls FROM documents)
SELECT doc_id, list_filter(list_transform(ls, lambda l: CASE WHEN l = '' OR length(l) > 100 THEN NULL WHEN starts_with(l, '#') THEN trim(regexp_replace(l, '^#+|#+$', '', 'g'))
  WHEN regexp_matches(l, '^\\(sub)?(sub)?(section|chapter|paragraph)\{{.+\}}') THEN regexp_extract(l, '\{{(.+)\}}', 1) WHEN regexp_matches(l, '^\d+\.?\d*\s+[A-Z][a-zA-Z\s]+$') THEN l END), lambda x: x IS NOT NULL)[1] AS header,
  len(ls)::INTEGER AS lines FROM li""")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked and numbered headers, as the SQL has them; those in capitals are tested apart, since cases of letters differ between engines."""
    d = tb.table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.size(F.slice(F.split("text", "\n"), 1, 10))
    return d.select("doc_id", tx.section_header(F.col("text"), in_capitals=False).alias("header"), lines.alias("lines"))


@query(rf"""SELECT page_id, len(regexp_extract_all(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1))::INTEGER AS sections, len(regexp_extract_all(html, '<img '))::INTEGER AS images, len(regexp_extract_all(html, '<table'))::INTEGER AS tables,
len(regexp_extract_all(html, '<p[ >]'))::INTEGER AS paragraphs, length(html)::INTEGER AS n_chars FROM pages""")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of structured documents, counted."""
    n = lambda p, g=0: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(g)))
    return tb.table(spark, sf_dir, "pages").select("page_id", n(r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>", 1).alias("sections"), n("<img ").alias("images"), n("<table").alias("tables"), n("<p[ >]").alias("paragraphs"), F.length("html").alias("n_chars"))


@query("SELECT count(*) AS pages, sum(len(regexp_extract_all(html, '<img ')))::BIGINT AS images, sum(len(regexp_extract_all(html, '<table')))::BIGINT AS tables, round(avg(length(html)) FILTER (length(html) > 0), 6) AS mean_chars FROM pages")
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_parts(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("pages"), F.sum("images").alias("images"), F.sum("tables").alias("tables"), F.round(F.avg(F.when(F.col("n_chars") > 0, F.col("n_chars"))), 6).alias("mean_chars"))


#: Patterns in the invented language of the test documents; the fixed table is for real text.
#: Word edges are spelled out, since engines differ on them beside letters with accents.
SOUNDS = {"action": r"tion([^a-z]|$)", "past": r"ed([^a-z]|$)", "going": r"ing([^a-z]|$)", "article": r"(^|[^a-z])(the|der|die|le|la|el)([^a-z]|$)", "link": r"(^|[^a-z])(and|und|et|y)([^a-z]|$)"}
SOUND_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in sorted(SOUNDS.items()))
FOUND = f"{CHUNKS}, fo AS (SELECT paper_id, chunk_index, list_filter([{SOUND_SQL}], lambda x: x IS NOT NULL) AS ps FROM chunks)"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.chunks(spark, sf_dir).select("paper_id", "chunk_index", F.array_sort(tx.primitives(F.col("text"), SOUNDS)).alias("ps"))


@query(f"WITH {FOUND} SELECT p AS primitive, count(*) AS n, round(count(*) / (SELECT count(*) FROM fo)::DOUBLE, 6) AS per_chunk FROM (SELECT unnest(ps) AS p FROM fo) GROUP BY 1")
def primitive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags are summed in one pass over the chunks; no row is exploded."""
    f = _found(spark, sf_dir)
    one = f.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.array_contains("ps", n)).alias(n) for n in SOUNDS])
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("primitive"), F.col(n).alias("n")) for n in SOUNDS]))
    return one.select("all", rows).where("n > 0").select("primitive", "n", F.round(F.col("n") / F.col("all"), 6).alias("per_chunk"))


@query(f"WITH {FOUND} SELECT array_to_string(ps, '+') AS combination, count(*) AS n FROM fo WHERE len(ps) > 1 GROUP BY 1 ORDER BY n DESC, combination LIMIT 20")
def primitive_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _found(spark, sf_dir).where(F.size("ps") > 1)
    return f.groupBy(F.array_join("ps", "+").alias("combination")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "combination").limit(20)


@query(f"""WITH {FOUND}, t AS (SELECT array_to_string(ps, '+') AS c, any_value(ps) AS ps, count(*) AS n FROM fo WHERE len(ps) > 1 GROUP BY 1 ORDER BY n DESC, c LIMIT 20)
SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT n, a, unnest(ps) AS b FROM (SELECT n, ps, unnest(ps) AS a FROM t)) WHERE a <> b GROUP BY 1, 2""")
def primitive_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = primitive_combinations(spark, sf_dir).select("n", F.split("combination", r"\+").alias("ps"))
    return top.select("n", "ps", F.explode("ps").alias("a")).select("n", "a", F.explode("ps").alias("b")).where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))


#: Clusters of vectors by density; -1 are those in none.
DBSCAN = f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), near AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS sim FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {1 - 0.65!r}),
w AS (SELECT src, dst, sim FROM near UNION ALL SELECT dst, src, sim FROM near), cores AS (SELECT src AS id FROM w GROUP BY 1 HAVING count(*) + 1 >= 5),
reach AS (SELECT id, id AS root FROM cores UNION SELECT w.dst, root FROM reach JOIN w ON w.src = reach.id JOIN cores ON cores.id = w.dst), own AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1),
border AS (SELECT src AS id, cluster FROM w JOIN own ON own.id = w.dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) = 1),
db AS (SELECT v.id, coalesce(own.cluster, border.cluster, -1)::BIGINT AS cluster FROM v LEFT JOIN own USING (id) LEFT JOIN border USING (id))"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(dbscan_clusters(spark, sf_dir), "clusters")


@query(f"""WITH RECURSIVE {DBSCAN}, {FOUND}, x AS (SELECT coalesce(cluster, -1) AS cluster, unnest(ps) AS p FROM fo LEFT JOIN db ON db.id = paper_id), k AS (SELECT cluster, p, count(*) AS n FROM x GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT cluster FROM k), (SELECT DISTINCT p FROM k)),
t AS (SELECT cluster, sum(n) AS t FROM k GROUP BY 1 ORDER BY t DESC, cluster LIMIT 5)
SELECT g.cluster, g.p AS primitive, round(coalesce(n, 0) / (t + 1e-10), 6) AS share FROM t JOIN g USING (cluster) LEFT JOIN k ON k.cluster = g.cluster AND k.p = g.p""")
def cluster_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of primitives in the clusters, by density of their papers' vectors, with most of them; -1 are papers in none."""
    f = _found(spark, sf_dir).join(_clusters(spark, sf_dir).withColumnRenamed("id", "paper_id"), "paper_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    by = f.groupBy("cluster").agg(*[F.count_if(F.array_contains("ps", n)).alias(n) for n in SOUNDS]).withColumn("t", sum((F.col(n) for n in SOUNDS), F.lit(0)))
    top = by.orderBy(F.desc("t"), "cluster").limit(5)
    return top.select("cluster", "t", F.inline(F.array(*[F.struct(F.lit(n).alias("primitive"), F.col(n).alias("n")) for n in SOUNDS]))).select("cluster", "primitive", F.round(F.col("n") / (F.col("t") + 1e-10), 6).alias("share"))


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9_]+'), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "], w)))"


@query(f"""WITH {PAPERS}, e AS (SELECT a.paper_id AS src, b.paper_id AS dst, a.title AS ta, b.title AS tb FROM papers a JOIN papers b ON a.paper_id < b.paper_id WHERE list_cosine_similarity(a.v, b.v) > 0.3),
k AS (SELECT src, dst, {TOKENS.format("ta")} AS x, {TOKENS.format("tb")} AS y FROM e)
SELECT src, dst, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END, 6) AS jaccard FROM k""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the titles of similar papers."""
    from lattica.plans.graph import edges

    return edges(spark, sf_dir, k=tx.overlap_tokens(F.col("title"))).select("src", "dst", r6(tx.jaccard(F.col("src_k"), F.col("dst_k")), "jaccard"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''))) AS token FROM documents), q AS (SELECT item_id, string_split_regex(text, '\s+')[1] AS token FROM benchmark)
SELECT item_id, count(doc_id) AS n FROM q LEFT JOIN t USING (token) GROUP BY 1""")
def inverted_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first word of each item, by a token index."""
    q = tb.table(spark, sf_dir, "benchmark").select("item_id", F.split("text", r"\s+")[0].alias("token"))
    return q.join(inverted_index(tb.table(spark, sf_dir, "documents"), "doc_id", "text"), "token", "left").groupBy("item_id").agg(F.count("doc_id").alias("n"))


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """token, id: each distinct token of each text."""
    return docs.select(id_col, F.explode(F.array_distinct(tx.words(F.col(text_col)))).alias("token")).select("token", id_col)


TERMS = r"""d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents),
q AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS t FROM benchmark)"""


def full_text_index(spark: SparkSession, sf_dir: str) -> fulltext.Index:
    return fulltext.Index.build(tb.table(spark, sf_dir, "documents"), shared_folder(spark, "full-text"), "doc_id", "text")


@query(rf"""WITH {TERMS}, c AS (SELECT item_id, doc_id, t, w FROM q, d WHERE len(t) > 0 AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(t, ' ') || ' ')),
p AS (SELECT item_id, doc_id, list_filter(range(1, len(w) - len(t) + 2), lambda p: w[p:p + len(t) - 1] = t) AS ps FROM c)
SELECT item_id, doc_id, len(ps)::BIGINT AS n, ps[1]::BIGINT - 1 AS first FROM p""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark item, by the positions in a full-text index."""
    found = full_text_index(spark, sf_dir).phrases(tb.table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.withColumnsRenamed({"query": "item_id", "id": "doc_id"})


@query(rf"""WITH {TERMS}, n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d), a AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(t) AS term FROM q) GROUP BY ALL),
p AS (SELECT doc_id, len, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM a JOIN p USING (term) JOIN f USING (term), n GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 10""")
def full_text_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that fit each benchmark item best."""
    found = full_text_index(spark, sf_dir).ranked(tb.table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), r6("score"))


IDS = "('2310.08560'), ('hep-th/9901001'), ('math-ph1'), ('abc'), ('cs/0112017.v1'), ('0704.0001'), ('astro-ph/9203001')"


@query(f"""SELECT id, replace(replace(id, '.', '_'), '/', '_') AS key, CASE WHEN contains(id, '/') THEN string_split(id, '/')[1] WHEN regexp_matches(id, '^(astro|cond|hep|math|physics)') THEN string_split(id, '-')[1] ELSE 'uncategorized' END AS category,
CASE WHEN regexp_matches(id, '^\\d{{4}}\\.[\\d.]*\\d$') THEN '20' || substr(id, 1, 2) || '-' || substr(id, 3, 2) || '-01' WHEN regexp_matches(id, '/\\d{{4}}') THEN CASE WHEN substr(string_split(id, '/')[2], 1, 2)::INTEGER > 90 THEN '19' ELSE '20' END || substr(string_split(id, '/')[2], 1, 2) || '-' || substr(string_split(id, '/')[2], 3, 2) || '-01' ELSE '2020-01-01' END AS date,
string_split(id, '/')[-1] AS tail FROM (VALUES {IDS}) v(id)""".replace("\\\\", "\\"))
def id_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, x = spark.sql(f"SELECT id FROM VALUES {IDS} AS v(id)"), F.col("id")
    return v.select("id", ids.safe_key(x).alias("key"), ids.infer_categories(x)[0].alias("category"), ids.infer_date(x).alias("date"), ids.last_part(x).alias("tail"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, date_trunc('month', ts)::DATE::VARCHAR AS month, year(ts)::INTEGER AS year, (props IS NOT NULL AND json_valid(props)) AS has_props, len(json_keys(props))::INTEGER AS n_props FROM events""")
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select("event_id", day.alias("day"), F.date_trunc("month", ids.iso_time(F.concat(day, F.lit("T00:00:00Z")))).cast("date").cast("string").alias("month"), ids.year_of(day).alias("year"), F.json_object_keys("props").isNotNull().alias("has_props"), F.size(F.json_object_keys("props")).alias("n_props"))


@query(f"""WITH {PAPERS}, f AS (SELECT paper_id, 'Title: ' || title || chr(10) || chr(10) || 'Categories: ' || array_to_string(categories, ', ') || chr(10) || chr(10) || 'Abstract: ' || abstract || chr(10) || chr(10) || body || chr(10) || chr(10) || 'References: ' || primary_category AS t FROM papers)
SELECT paper_id, length(t)::INTEGER AS n, sha256(t) AS digest FROM f""")
def full_text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.papers(spark, sf_dir)
    t = tx.full_text(F.col("title"), F.col("categories"), F.col("abstract"), F.col("body"), F.array("primary_category"))
    return p.select("paper_id", t.alias("t")).select("paper_id", F.length("t").alias("n"), F.sha2("t", 256).alias("digest"))


def _sentences(column: str) -> str:
    return rf"string_split(regexp_replace({column}, '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30))"


BREAK = "chr(10) || chr(10)"
_N_WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"
#: The packers' states, a step for each piece: an open chunk is its pieces and its size; a step closes one chunk at most.
BY_WORDS = rf"""RECURSIVE s AS (SELECT doc_id, x.t AS t, x.n - 1 AS sec FROM (SELECT doc_id, unnest(list_transform(string_split(regexp_replace(text, '(?m)(^## |\n## )', chr(30), 'g'), chr(30)), lambda t, i: {{'t': t, 'n': i}})) AS x FROM documents) WHERE trim(x.t, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
g AS (SELECT doc_id, sec, x.t AS t, x.n AS pos FROM (SELECT doc_id, sec, unnest(list_transform(string_split(CASE WHEN sec > 0 THEN '## ' ELSE '' END || t, {BREAK}), lambda t, i: {{'t': regexp_replace(t, '^\s+|\s+$', '', 'g'), 'n': i}})) AS x FROM s) WHERE x.t <> ''),
h AS (SELECT doc_id, sec, pos, {_N_WORDS.format("t")} > 512 AS long, t FROM g),
q AS (SELECT doc_id, sec, pos, long, x.t AS t, x.n AS nth FROM (SELECT doc_id, sec, pos, long, unnest(list_transform(CASE WHEN long THEN {_sentences("t")} ELSE [t] END, lambda t, i: {{'t': t, 'n': i}})) AS x FROM h)),
p AS (SELECT doc_id, sec, long, t, {_N_WORDS.format("t")} AS k, row_number() OVER (PARTITION BY doc_id ORDER BY sec, pos, nth) AS i FROM q),
r AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS sec, []::VARCHAR[] AS now, 0::BIGINT AS size, NULL::STRUCT(section BIGINT, tokens BIGINT, n_chars BIGINT) AS closed FROM (SELECT DISTINCT doc_id FROM p)
UNION ALL SELECT doc_id, i, sec, list_append(CASE WHEN len(tail) > 0 THEN [array_to_string(tail, ' ')] WHEN shut THEN []::VARCHAR[] ELSE now END, t), k + CASE WHEN shut THEN len(tail) ELSE size END,
  CASE WHEN shut THEN {{'section': was, 'tokens': size, 'n_chars': length(array_to_string(now, ' '))}} END
  FROM (SELECT *, CASE WHEN shut AND sec = was AND long AND len(now) > 1 THEN list_filter(string_split_regex(array_to_string(now, ' '), '\s+'), lambda w: w <> '')[-50:] ELSE []::VARCHAR[] END AS tail
    FROM (SELECT p.*, r.sec AS was, now, size, len(now) > 0 AND (p.sec <> r.sec OR size + k > 512) AS shut FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1))),
c AS (SELECT doc_id, i, closed FROM r WHERE closed IS NOT NULL UNION ALL SELECT doc_id, i + 1, {{'section': sec, 'tokens': size, 'n_chars': length(array_to_string(now, ' '))}} FROM r QUALIFY i = max(i) OVER (PARTITION BY doc_id))"""
BY_CHARS = rf"""RECURSIVE g AS (SELECT doc_id, x.t AS t, x.n AS pos FROM (SELECT doc_id, unnest(list_transform(string_split(text, {BREAK}), lambda t, i: {{'t': t, 'n': i}})) AS x FROM documents WHERE text <> '')),
q AS (SELECT doc_id, pos, long, x.t AS t, x.n AS nth FROM (SELECT doc_id, pos, length(t) > 1000 AS long, unnest(list_transform(CASE WHEN length(t) > 1000 THEN {_sentences("t")} ELSE [t] END, lambda t, i: {{'t': t, 'n': i}})) AS x FROM g)),
p AS (SELECT doc_id, long, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos, nth) AS i FROM q),
r AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS now, 0::BIGINT AS size, 0::BIGINT AS pos, NULL::STRUCT(a BIGINT, b BIGINT) AS closed FROM (SELECT DISTINCT doc_id FROM p)
UNION ALL SELECT doc_id, i, list_append(CASE WHEN tail <> '' THEN [tail] WHEN shut THEN []::VARCHAR[] ELSE now END, t), length(t) + CASE WHEN shut THEN length(tail) ELSE size END, CASE WHEN shut THEN pos + length(joined) - length(tail) ELSE pos END,
  CASE WHEN shut THEN {{'a': pos, 'b': pos + length(joined)}} END
  FROM (SELECT *, array_to_string(now, ' ') AS joined, CASE WHEN shut AND long THEN array_to_string(CASE WHEN len(now) > 2 THEN now[-2:] ELSE now[-1:] END, ' ') ELSE '' END AS tail
    FROM (SELECT p.*, now, size, pos, len(now) > 0 AND size + length(t) > 1000 AS shut FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1))),
c AS (SELECT doc_id, i, closed FROM r WHERE closed IS NOT NULL UNION ALL SELECT doc_id, i + 1, {{'a': pos, 'b': pos + length(array_to_string(now, ' '))}} FROM r QUALIFY i = max(i) OVER (PARTITION BY doc_id))"""


@query(f"""WITH {BY_WORDS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, closed.section::INTEGER AS section, closed.tokens::INTEGER AS tokens, closed.n_chars::INTEGER AS n_chars FROM c""")
def packed_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_chunks(tb.table(spark, sf_dir, "documents"), by="words").select("doc_id", "chunk_index", "section", "tokens", F.length("text").alias("n_chars"))


@query(f"""WITH {BY_CHARS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, closed.a::INTEGER AS start_char, closed.b::INTEGER AS end_char FROM c""")
def packed_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_chunks(tb.table(spark, sf_dir, "documents"), by="chars").select("doc_id", "chunk_index", "start_char", "end_char")


@query(f"""WITH {TYPED} SELECT paper_id || '_chunk_' || chunk_index AS chunk_id, paper_id AS doc_id, chunk_index, len(string_split(text, ' '))::INTEGER AS tokens, m AS has_equations, c AS has_code, f AS has_figures, b AS has_tables, chunk_type FROM ty""")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chunking.chunk_records(tb.table(spark, sf_dir, "documents"), size=64, overlap=16)
    flags = [f"metadata.{c}" for c in ("has_equations", "has_code", "has_figures", "has_tables", "chunk_type")]
    return r.select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "tokens", *flags)


def _hashed(dim: int) -> str:
    """SQL of the stand-in encoder: e (id, d, s), the entries of vectors but for their length, of texts x (id, t)."""
    words = "regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z_\\x{80}-\\x{10FFFF}]+')"
    return f"""e AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS d, sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END)::DOUBLE AS s FROM (SELECT id, unnest({words}) AS w FROM x) GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(s * s)) AS n FROM e GROUP BY 1)"""


@query(f"""WITH {CHUNKS.replace("48", "824").replace("i + 64", "i + 1024")}, x AS (SELECT paper_id || '_chunk_' || chunk_index AS id, text AS t FROM chunks), {_hashed(32)}
SELECT x.id AS chunk_id, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END AS norm, round(CASE WHEN n > 0 THEN coalesce(s, 0) / n ELSE 0.0::DOUBLE END, 6) AS first FROM x LEFT JOIN n USING (id) LEFT JOIN e ON e.id = x.id AND d = 0""")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all chunks, by the stand-in encoder, as their norm and first entry."""
    v = chunking.embedded_chunks(chunking.chunk_records(tb.table(spark, sf_dir, "documents")), encode.hashing_encoder(32))
    return v.select("chunk_id", r6(norm(F.col("v")), "norm"), r6(F.col("v")[0], "first"))


@query(f"""WITH x AS (SELECT item_id AS id, text AS t FROM benchmark), {_hashed(64)}, p AS (SELECT a.id AS src, b.id AS dst, sum(a.s * b.s) AS dot FROM e a JOIN e b ON a.d = b.d AND a.id < b.id GROUP BY 1, 2)
SELECT src, dst, round(dot / (a.n * b.n), 6) AS sim FROM p JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.n > 0 AND b.n > 0 AND dot / (a.n * b.n) > 0.3""")
def encoded_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder and pair join together, over the benchmark items."""
    v = encode.encode(tb.table(spark, sf_dir, "benchmark"), "item_id", "text", encode.hashing_encoder())
    return pairs.similar_pairs(v, 0.3).withColumn("sim", F.round("sim", 6))


@query(f"""WITH RECURSIVE {DBSCAN} SELECT id, cluster FROM db""")
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(tb.vectors(spark, sf_dir), 0.65, 5)


@query()
def kmeans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans(tb.vectors(spark, sf_dir), 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def spectral_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tb.vectors(spark, sf_dir)
    return cluster.spectral(pairs.similar_pairs(v, 0.2), 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
