"""Queries over records: filters, lookups, counts, checks, samples, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import ids
from lattica.functions import text as tx
from lattica.functions.vector import norm, usable
from lattica.operators import sampling as sm
from lattica.plans.graph import edges, r6
from lattica.plans.registry import CHUNKS, EDGES, PAPERS, query
from lattica.sources import store
from lattica.sources import tables as tb
from lattica.sources.scratch import shared_folder
from lattica.streaming import metrics


@query(f"""WITH {PAPERS} SELECT primary_category, count(*) AS n, round(avg(year), 6) AS mean_year, round(avg((len(v) > 0)::INTEGER), 6) AS embedded, round(avg((length(body) > 1000)::INTEGER), 6) AS long_rate FROM papers GROUP BY 1""")
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.papers(spark, sf_dir)
    return p.groupBy("primary_category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("year"), 6).alias("mean_year"), F.round(F.avg((F.size("embedding") > 0).cast("int")), 6).alias("embedded"), F.round(F.avg((F.length("body") > 1000).cast("int")), 6).alias("long_rate"))


@query(f"WITH {PAPERS} SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM papers) GROUP BY 1")
def category_explode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.papers(spark, sf_dir).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAPERS} SELECT year, count(*) AS n FROM papers GROUP BY 1")
def year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.papers(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAPERS} SELECT year, count(*) AS n FROM papers GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def last_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return year_counts(spark, sf_dir).orderBy(F.desc("year")).limit(5)


@query(f"WITH {PAPERS} SELECT coalesce(categories[1], 'unknown') AS primary_category, year, count(*) AS n FROM papers GROUP BY 1, 2")
def primary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.papers(spark, sf_dir).groupBy(ids.first_category(F.col("categories")).alias("primary_category"), "year").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE list_has_any([o_orderpriority, o_orderstatus], ['1-URGENT', 'P']) AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1996-06-30'""")
def category_filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of a row's categories is wanted, and its date lies within both bounds."""
    o = tb.table(spark, sf_dir, "orders")
    wanted = F.arrays_overlap(F.array("o_orderpriority", "o_orderstatus"), F.array(F.lit("1-URGENT"), F.lit("P")))
    lo, hi = F.lit("1995-01-01").cast("date"), F.date_add(F.lit("1996-06-30").cast("date"), 1)
    # Bounds on the stored column, so that the scan can skip row groups.
    return o.where((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi)).where(wanted).select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def exclude_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return tb.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(out, "doc_id", "left_anti")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = tb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return tb.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(some, "doc_id", "left_semi")


@query("SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE known AND quality = 1")
def missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As soon as a filter on metadata is given, rows without metadata are out."""
    d, m = tb.table(spark, sf_dir, "documents").select("doc_id"), tb.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return with_metadata(d, m, "doc_id", F.col("quality") == 1)


def with_metadata(df: DataFrame, meta: DataFrame, key: str, condition=None) -> DataFrame:  # noqa: ANN001
    """``df`` with its metadata; rows without any stay only if no condition is given."""
    if condition is None:
        return df.join(meta, key, "left")
    return df.join(meta.where(condition), key)


@query(f"WITH {PAPERS} SELECT paper_id, title FROM papers WHERE contains(lower(title), 'tion') OR contains(lower(abstract), 'keit')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.papers(spark, sf_dir).where(tx.mentions(F.col("title"), ["tion"]) | tx.mentions(F.col("abstract"), ["keit"])).select("paper_id", "title")


@query("SELECT doc_id, length(trim(text))::INTEGER AS n FROM documents WHERE length(trim(text)) >= 100")
def least_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.trim("text"))
    return tb.table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n >= 100")


@query("""SELECT doc_id, replace(replace(source || '/' || doc_id || '.v1', '.', '_'), '/', '_') AS paper_id, coalesce(nullif(lang, ''), 'unknown') AS lang, substr(text, 1, 5000) AS preview, length(text)::INTEGER AS content_length, coalesce(quality, -1)::INTEGER AS quality
FROM documents LEFT JOIN labels USING (doc_id)""")
def record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.table(spark, sf_dir, "documents").join(tb.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    key = ids.safe_key(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v1")))
    return d.select("doc_id", key.alias("paper_id"), ids.first_truthy(F.col("lang"), F.lit("unknown")).alias("lang"), F.substring("text", 1, 5000).alias("preview"), F.length("text").alias("content_length"), F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT e.event_id, e.user_id, c.c_name, c.c_mktsegment FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def dereference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that an id points to, null where there is none."""
    c = tb.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    e = tb.table(spark, sf_dir, "events").select("event_id", "user_id")
    return e.join(c, e["user_id"] == c["c_custkey"], "left").drop("c_custkey")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a total order."""
    return tb.table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").offset(50).limit(100)


@query(f"WITH {CHUNKS} SELECT paper_id, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, paper_id LIMIT 5")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.chunks(spark, sf_dir).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "paper_id").limit(5)


@query(f"WITH {CHUNKS} SELECT paper_id, text FROM chunks WHERE chunk_index = 0")
def first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each paper that has one; found by a window over indexes, kept general for tables whose numbers don't start at 0."""
    w = Window.partitionBy("paper_id").orderBy("chunk_index")
    return tb.chunks(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("paper_id", "text")


@query(f"""WITH {EDGES} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM papers) AS papers, count(*) AS edges,
round(2.0::DOUBLE * count(*) / (SELECT count(*) FROM papers), 6) AS edges_per_paper, count(*) FILTER (pow(sim, 1.5) > 0.2) AS strong FROM edges""")
def run_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    e = edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.pow("sim", F.lit(1.5)) > 0.2).alias("strong"))
    one = n(tb.table(spark, sf_dir, "documents"), "documents").crossJoin(n(tb.table(spark, sf_dir, "embeddings"), "embeddings")).crossJoin(n(tb.papers(spark, sf_dir), "papers")).crossJoin(e)
    return one.select("documents", "embeddings", "papers", "edges", F.round(2.0 * F.col("edges") / F.col("papers"), 6).alias("edges_per_paper"), "strong")


@query("""SELECT label, count(*) AS n, count(*) FILTER (list_bool_or(list_transform(embedding::DOUBLE[], lambda x: isnan(x) OR isinf(x)))) AS broken, round(min(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS least_norm,
round(max(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS most_norm FROM embeddings GROUP BY 1""")
def embedding_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    n = e.select("label", norm(F.col("v")).alias("n"), (~usable(F.col("v"))).alias("broken"))
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("broken").alias("broken"), F.round(F.min("n"), 6).alias("least_norm"), F.round(F.max("n"), 6).alias("most_norm")).withColumnRenamed("n", "n")


@query("""WITH e AS (SELECT o_orderkey, unnest(range(1, 8)) AS line FROM orders), a AS (SELECT l_orderkey, l_linenumber FROM lineitem)
SELECT 'missing' AS kind, count(*) AS n FROM e ANTI JOIN a ON l_orderkey = o_orderkey AND l_linenumber = line UNION ALL SELECT 'extra', count(*) FROM a ANTI JOIN e ON l_orderkey = o_orderkey AND l_linenumber = line
UNION ALL SELECT 'expected', count(*) FROM e UNION ALL SELECT 'actual', count(*) FROM a""")
def chunk_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected parts of a whole against those there: orders with up to seven lines stand in for documents with chunks."""
    expected = tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("i"))
    actual = tb.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("i"))
    return integrity(expected, actual, ["k", "i"])


def integrity(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """kind, n: expected, actual, missing and extra keys; one join of counted keys."""
    both = expected.groupBy(*key).agg(F.count(F.lit(1)).alias("e")).join(actual.groupBy(*key).agg(F.count(F.lit(1)).alias("a")), key, "full")
    s = both.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("expected"), F.coalesce(F.sum("a"), F.lit(0)).alias("actual"), F.coalesce(F.sum(F.when(F.col("a").isNull(), F.col("e"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("e").isNull(), F.col("a"))), F.lit(0)).alias("extra"))
    return s.unpivot([], ["expected", "actual", "missing", "extra"], "kind", "n")


@query(f"""WITH {CHUNKS}, r AS (SELECT paper_id, string_agg(text, chr(10) ORDER BY chunk_index) AS full_text, count(*) AS n FROM chunks GROUP BY 1)
SELECT doc_id, lang, n AS chunks, length(full_text)::INTEGER AS n_chars, sha256(full_text) AS digest FROM documents JOIN r ON paper_id = doc_id""")
def reconstruct_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata joined with the text made of ordered chunks."""
    c = tb.chunks(spark, sf_dir).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("l"))
    full = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    d = tb.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.join(c, d["doc_id"] == c["paper_id"]).select("doc_id", "lang", F.size("l").cast("long").alias("chunks"), full.alias("t")).select("doc_id", "lang", "chunks", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query(f"WITH {CHUNKS}, c AS (SELECT paper_id, count(*) AS n, sum(length(text)) AS l FROM chunks GROUP BY 1) SELECT count(*) AS papers, sum(n)::BIGINT AS chunks, round(avg(n), 6) AS mean_chunks, max(n) AS most, round(sum(l) / sum(n), 6) AS mean_chars FROM c")
def verification_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.chunks(spark, sf_dir).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("l"))
    return c.agg(F.count(F.lit(1)).alias("papers"), F.sum("n").alias("chunks"), F.round(F.avg("n"), 6).alias("mean_chunks"), F.max("n").alias("most"), F.round(F.sum("l") / F.sum("n"), 6).alias("mean_chars"))


@query(f"WITH {PAPERS}, t AS (SELECT count(*) AS t FROM papers) SELECT primary_category, year, count(*) AS size, least(count(*), greatest(1, floor(100 * count(*) / any_value(t))))::BIGINT AS quota FROM papers, t GROUP BY 1, 2")
def diverse_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.quotas(tb.papers(spark, sf_dir), 100, ["primary_category", "year"])


@query("SELECT doc_id, day FROM (SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate FROM orders) ORDER BY o_orderdate, doc_id LIMIT 100")
def sequential_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    return sm.sequential_sample(o, 100, "o_orderdate", "doc_id").select("doc_id", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


#: The draws of samples in SQL.
def _draw(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || paper_id::VARCHAR), 1, 13))::BIGINT"


@query(f"WITH {PAPERS} SELECT paper_id, primary_category FROM papers ORDER BY {_draw(42)}, paper_id LIMIT 100")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.random_sample(tb.papers(spark, sf_dir).select("paper_id", "primary_category"), 100, "paper_id")


@query(f"""WITH {PAPERS}, t AS (SELECT count(*) AS t FROM papers), q AS (SELECT primary_category, year, least(count(*), greatest(1, floor(100 * count(*) / any_value(t)))) AS quota FROM papers, t GROUP BY 1, 2),
r AS (SELECT paper_id, primary_category, year, quota, row_number() OVER (PARTITION BY primary_category, year ORDER BY {_draw(42)}, paper_id) AS rank FROM papers JOIN q USING (primary_category, year))
SELECT paper_id, primary_category, year FROM r ORDER BY rank > quota, {_draw(43)}, paper_id LIMIT 100""")
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.diverse_sample(tb.papers(spark, sf_dir).select("paper_id", "primary_category", "year"), 100, ["primary_category", "year"], "paper_id")


@query(f"""WITH {PAPERS}, s AS (SELECT primary_category, count(*) AS size FROM papers GROUP BY 1)
SELECT paper_id, primary_category, year FROM papers JOIN s USING (primary_category) ORDER BY -ln(({_draw(42)} + 1) / {(1 << 52) + 1}.0::DOUBLE) * size, paper_id LIMIT 100""")
def rare_first_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.rare_first_sample(tb.papers(spark, sf_dir).select("paper_id", "primary_category", "year"), 100, ["primary_category"], "paper_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "documents").select("doc_id").exceptAll(tb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("SELECT 'union' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings) UNION ALL SELECT 'intersection', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings) UNION ALL SELECT 'languages', count(DISTINCT lang) FROM documents")
def set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tb.table(spark, sf_dir, "documents").select("doc_id"), tb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    n = lambda df, name: df.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "intersection")).unionByName(n(tb.table(spark, sf_dir, "documents").select("lang").distinct(), "languages"))


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER w AS k, epoch(ts) - epoch(first_value(ts) OVER w) AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CASE WHEN t > 0 THEN k / t END AS rate FROM o) SELECT event_id, k, round(avg(rate) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS moving_rate FROM r""")
def progress_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items a second so far, as a moving mean of a hundred such rates, for each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    o = tb.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.row_number().over(w).alias("k"), (secs - F.first(secs).over(w)).alias("t"))
    rate = F.when(F.col("t") > 0, F.col("k") / F.col("t"))
    return o.select("event_id", F.col("k").cast("long").alias("k"), F.round(F.avg(rate).over(w.rowsBetween(-99, 0)), 9).alias("moving_rate"))


@query("""WITH m AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (event_type = 'error')::DOUBLE AS errors, sum(value)::DOUBLE AS total, count(DISTINCT user_id)::DOUBLE AS users FROM events)
SELECT 'events' AS run, unnest(['rows', 'errors', 'total']) AS measure, round(unnest([n, errors, total]), 4) AS value FROM m""")
def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run, taken while its rows are written."""
    measures = {"rows": F.count(F.lit(1)), "errors": F.count_if(F.col("event_type") == "error"), "total": F.sum("value")}
    figures = metrics.observed_write(tb.table(spark, sf_dir, "events"), shared_folder(spark, "observed"), "events", measures)
    return figures.withColumn("value", F.round("value", 4))


NEW = "(SELECT doc_id + 900 AS doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang || '2' END AS lang FROM documents)"


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = tb.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return old, old.select((F.col("doc_id") + 900).alias("doc_id"), F.when(F.col("doc_id") % 3 != 0, F.concat("lang", F.lit("2"))).alias("lang"))


@query(f"SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM {NEW} WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def merge_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge(*_old_and_new(spark, sf_dir), "doc_id", "ignore")


@query(f"SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {NEW}) UNION ALL SELECT doc_id, lang FROM {NEW}")
def merge_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge(*_old_and_new(spark, sf_dir), "doc_id", "replace")


@query(f"SELECT coalesce(n.doc_id, d.doc_id) AS doc_id, coalesce(n.lang, d.lang) AS lang FROM documents d FULL JOIN {NEW} n ON n.doc_id = d.doc_id")
def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge(*_old_and_new(spark, sf_dir), "doc_id", "update")


@query(f"SELECT count(*) FILTER (d.doc_id IS NULL) AS inserted, count(*) FILTER (d.doc_id IS NOT NULL) AS duplicates, 0::BIGINT AS errors, count(*) AS total FROM {NEW} n LEFT JOIN documents d ON d.doc_id = n.doc_id")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge_counts(*_old_and_new(spark, sf_dir), "doc_id")


REPEATED = "(SELECT l_orderkey AS k, l_linenumber AS line, l_quantity AS q FROM lineitem)"


@query(f"WITH o AS (SELECT o_orderkey AS k, 0 AS line, -1.0::DOUBLE AS q FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT * FROM {REPEATED} QUALIFY row_number() OVER (PARTITION BY k ORDER BY line DESC, q DESC) = 1) SELECT k, line::INTEGER AS line, q::DOUBLE AS q FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)")
def merge_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders replaced by their lines, whose keys repeat: the last line stays."""
    return store.merge(*_orders_and_lines(spark, sf_dir), "k", "replace", order=["line", "q"])


@query(f"WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT k, count(*) AS n, k IN (SELECT k FROM o) AS old FROM {REPEATED} GROUP BY k) SELECT count(*) FILTER (NOT old) AS inserted, sum(CASE WHEN old THEN n ELSE n - 1 END)::BIGINT AS duplicates, 0::BIGINT AS errors, sum(n)::BIGINT AS total FROM n")
def merge_repeated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge_counts(*_orders_and_lines(spark, sf_dir), "k")


def _orders_and_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = tb.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("line"), F.lit(-1.0).alias("q"))
    new = tb.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("double").alias("q"))
    return old, new


@query("SELECT event_id, event_type, value FROM events WHERE NOT coalesce(event_type = 'error' OR value > 50, false)")
def delete_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete(tb.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), (F.col("event_type") == "error") | (F.col("value") > 50))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pending(tb.table(spark, sf_dir, "documents").select("doc_id", "lang"), tb.table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {EDGES} SELECT src, dst, round(CASE WHEN src % 2 = 0 THEN 0.9::DOUBLE ELSE sim END, 6) AS context_original, round(CASE WHEN src % 2 = 0 THEN 0.5::DOUBLE ELSE pow(sim, 1.5) END, 6) AS context_amplified FROM edges")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that were amplified before keep their values."""
    from lattica.operators.graph import amplified

    done = F.col("src") % 2 == 0
    e = edges(spark, sf_dir).withColumns({"context_original": F.when(done, 0.9), "context_amplified": F.when(done, 0.5), "alpha_used": F.when(done, 1.2)})
    return amplified(e).select("src", "dst", r6("context_original"), r6("context_amplified"))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O' GROUP BY 1")
def parameterised_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.execute(spark, "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status GROUP BY 1", {"least": 100000, "status": "O"}, orders=tb.table(spark, sf_dir, "orders"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1 ORDER BY n DESC, label LIMIT 5")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = tb.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    e = tb.table(spark, sf_dir, "embeddings").select("vec_id", "label").join(bad, "vec_id", "left_anti")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(5)


@query("SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def monthly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


@query("""SELECT l.doc_id, implemented, coalesce(n_events, 0) AS n_events FROM (SELECT DISTINCT doc_id, quality = 1 AS implemented FROM labels) l LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) e ON e.user_id = l.doc_id""")
def accessor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables as keyed lookups, joined instead of collected."""
    lab = tb.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("implemented")).distinct()
    e = tb.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_events"))
    return lab.join(e, "doc_id", "left").fillna(0, ["n_events"])
