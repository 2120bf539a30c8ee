"""Retrieval over every script, fusion of aliased hits, filtered vectors, and scalar functions of dates and amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import chunks, text
from filigree.operators import relational
from filigree.operators import retrieval as R
from filigree.plans.registry import query
from filigree.session import load_table, materialize
from filigree.sources import markup

_T = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{2,}')"
_BM25 = f"""w AS (SELECT doc_id AS doc, {_T} AS w FROM documents), size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
  p AS (SELECT doc, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY 1, 2),
  asked AS (SELECT DISTINCT item_id AS query, unnest({_T}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  s AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN p USING (term) JOIN df USING (term), size GROUP BY 1, 2),
  bm AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM s) WHERE rank <= 10)"""


def every_script(s: SparkSession, d: str) -> DataFrame:
    return R.bm25(load_table(s, d, "documents"), "doc_id", "text", load_table(s, d, "benchmark"), "item_id", "text", 10, R.EVERY_SCRIPT)


query("r4_bm25_every_script", f"WITH {_BM25} SELECT query, doc, rank, round(score, 4) AS score FROM bm")(lambda s, d: every_script(s, d).select("query", "doc", "rank", F.round("score", 4).alias("score")))
query("t4_ordered_fusion", f"""WITH {_BM25}, f AS (SELECT query, doc, round(1.0::DOUBLE / (60 + rank) + CASE WHEN rank > 5 THEN 1.0::DOUBLE / (60 + 11 - rank) - 1.0::DOUBLE / (60 + rank) ELSE 0 END, 9) AS rrf, round(-score, 4) AS score FROM bm)
  SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY rrf DESC, score, doc) AS INT) AS rank FROM f QUALIFY rank <= 8""")(
    lambda s, d: R.ordered_fusion(
        (b := materialize(every_script(s, d), "ranking")).select("query", "doc", F.round(1.0 / (60 + F.when(F.col("rank") > 5, 11 - F.col("rank")).otherwise(F.col("rank"))), 9).alias("rrf")), b.select("query", "doc", F.round(-F.col("score"), 4).alias("score")), 8
    ).select("query", "doc", "rank")
)
query("r15_fused_slots", """WITH r AS (SELECT o_custkey AS query, o_orderstatus AS slot, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS variant, year(o_orderdate) AS doc, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS rank FROM orders),
  k AS (SELECT query, slot, variant, doc, min(rank) AS rank FROM r WHERE variant < 4 AND rank <= 30 GROUP BY ALL), f AS (SELECT query, slot, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM k GROUP BY ALL)
  SELECT query, slot, CAST(doc AS INT) AS doc, rrf, CAST(row_number() OVER (PARTITION BY query, slot ORDER BY rrf DESC, doc) AS INT) AS rank FROM f QUALIFY rank <= 3""")(
    lambda s, d: R.fused_slots(
        R.rank(
            load_table(s, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderstatus").alias("slot"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("variant"), F.year("o_orderdate").alias("doc"), "o_orderkey"),
            ["query", "slot", "variant"], [F.asc("o_orderkey")], 1 << 30,
        ).drop("o_orderkey"), 3,
    )
)
query("r8_fused_aliases")(
    lambda s, d: R.fuse_aliased(
        every_script(s, d).select("query", F.lit("sparse").alias("ranking"), "rank", F.lit(None).cast("string").alias("chunk_id"), F.col("doc").cast("string").alias("evidence_id"), F.lit(None).cast("array<string>").alias("evidence_ids")).unionByName(
            every_script(s, d).select("query", F.lit("zdense").alias("ranking"), (11 - F.col("rank")).alias("rank"), F.concat(F.lit("c"), F.floor(F.col("doc") / 2).cast("string")).alias("chunk_id"), F.lit(None).cast("string").alias("evidence_id"), F.array(F.col("doc").cast("string")).alias("evidence_ids"))
        ), 10,
    )
)
query("r5_trigram_search", "SELECT item_id AS needle_id, n AS needle, doc_id AS doc FROM (SELECT item_id, lower(left(text, 12)) AS n FROM benchmark) JOIN documents ON contains(lower(text), n)")(
    lambda s, d: R.trigram_search(
        R.trigram_index(load_table(s, d, "documents"), "doc_id", "text"), load_table(s, d, "documents"), "doc_id", "text", load_table(s, d, "benchmark").select(F.lower(F.substring("text", 1, 12)).alias("needle")).distinct()
    ).join(load_table(s, d, "benchmark").select(F.col("item_id").alias("needle_id"), F.lower(F.substring("text", 1, 12)).alias("needle")), "needle").select("needle_id", "needle", "doc")
)
query("r11_unit_vectors", "SELECT vec_id FROM embeddings WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-4")(lambda s, d: R.unit_vectors(load_table(s, d, "embeddings")).select("vec_id"))
query("r12_filtered_vectors", """WITH v AS (SELECT * FROM embeddings WHERE label IN (1, 3, 5)), q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
  c AS (SELECT query, vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS score FROM v, q WHERE vec_id <> query)
  SELECT query, vec_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS rank FROM c QUALIFY rank <= 5""")(
    lambda s, d: R.filtered_vector_search(load_table(s, d, "embeddings"), s.createDataFrame([(1,), (3,), (5,)], "label int"), load_table(s, d, "embeddings").filter("vec_id % 20 = 0"), "label", 5)
)
query("r1_r2_query_terms", f"""WITH t AS (SELECT item_id, list_distinct(list_filter({_T}, lambda x: NOT regexp_matches(x, '^[0-9]{{1,4}}$') AND x NOT IN ('the', 'of', 'and'))) AS t FROM benchmark)
  SELECT item_id, CAST(len(t) AS INT) AS n FROM t""")(
    lambda s, d: load_table(s, d, "benchmark").select("item_id", F.size(R.query_terms(F.col("text"), ["the", "of", "and"], [], [])).alias("n"))
)
query("x21_won_amounts", "SELECT o_orderkey, CAST(floor(o_totalprice / 10000) * 10000 + CAST(o_orderkey % 7 + 1000 AS DOUBLE) AS DECIMAL(28,4)) AS first_amount, 2 AS n FROM orders WHERE o_totalprice >= 10000")(
    lambda s, d: load_table(s, d, "orders").filter("o_totalprice >= 10000").select(
        "o_orderkey",
        text.amounts(F.concat(F.year("o_orderdate").cast("string"), F.lit("년 12% "), F.format_number(F.floor(F.col("o_totalprice") / 10000), 0), F.lit("만 그리고 "), (F.col("o_orderkey") % 7 + 1000).cast("string"), F.lit("원"))).alias("a"),
    ).select("o_orderkey", (F.col("a")[0] + F.col("a")[1]).cast("decimal(28,4)").alias("first_amount"), F.size("a").alias("n"))
)
query("x21_amount_parts", """WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS n, CAST(o_custkey % 4 AS INT) AS shape, CAST(o_orderkey % 2000 AS BIGINT) AS small FROM orders)
  SELECT o_orderkey, unnest(generate_series(0, len(a) - 1))::INT AS at, CAST(unnest(a) AS DECIMAL(38,4)) AS amount FROM (SELECT o_orderkey, CASE shape WHEN 0 THEN [n * 100000000 + small * 10000]
    WHEN 1 THEN [n * 1000000000000 + small] WHEN 2 THEN list_concat(CASE WHEN small >= 1000 THEN [small] ELSE [] END, [n * 10000000]) ELSE [n * 10000, n * 1000000] END AS a FROM t)""")(
    lambda s, d: load_table(s, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("string").alias("n"), (F.col("o_custkey") % 4).alias("shape"), (F.col("o_orderkey") % 2000).cast("string").alias("small")).select(
        "o_orderkey",
        F.posexplode(text.amounts(
            F.when(F.col("shape") == 0, F.concat(F.lit("1996년 "), F.col("n"), F.lit("억 "), F.col("small"), F.lit("만 원, 12% 증가")))
            .when(F.col("shape") == 1, F.concat(F.lit("약 "), F.col("n"), F.lit("조 "), F.col("small"), F.lit("원")))
            .when(F.col("shape") == 2, F.concat(F.col("small"), F.lit(" 원과 1.2.3 그리고 "), F.col("n"), F.lit("천만 원")))
            .otherwise(F.concat(F.col("n"), F.lit("만 "), F.col("n"), F.lit("백만"))),
        )).alias("at", "amount"),
    )
)
query("g_threshold", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN CAST(CAST(round(s_acctbal, 2) AS DECIMAL(18,2)) * 100000000 AS DECIMAL(38,4)) END AS least FROM supplier")(
    lambda s, d: load_table(s, d, "supplier").select("s_suppkey", text.threshold(F.concat(F.lit("매출 "), F.when(F.col("s_acctbal") >= 0, F.round("s_acctbal", 2).cast("decimal(18,2)").cast("string")).otherwise("많이"), F.lit("억원 이상인 회사"))).alias("least"))
)
query("g_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS at, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders")(
    lambda s, d: load_table(s, d, "orders").select(
        "o_orderkey", text.first_date(F.concat(F.lit("최초제출일: "), F.year("o_orderdate"), F.lit("년 "), F.month("o_orderdate"), F.lit(" 월"), F.dayofmonth("o_orderdate"), F.lit("일"))).alias("at"), text.month_end(F.year("o_orderdate"), F.month("o_orderdate")).alias("month_end")
    )
)
query("g_suffix", "SELECT p_partkey, CASE WHEN p_type LIKE '____%OMY' THEN left(p_type, length(p_type) - 3) WHEN p_type LIKE '____%UM' THEN left(p_type, length(p_type) - 2) ELSE p_type END AS core FROM part")(
    lambda s, d: load_table(s, d, "part").select("p_partkey", text.without_suffix(F.col("p_type"), ["OMY", "UM"]).alias("core"))
)
query("g_longest_name", "SELECT c_custkey, max_by(n_name, (length(n_name), n_name)) AS name FROM customer JOIN nation ON contains(c_mktsegment || ' ' || c_name || ' ' || (SELECT string_agg(n_name, ' ' ORDER BY n_name) FROM nation n2 WHERE n2.n_nationkey <= c_nationkey), n_name) GROUP BY 1")(
    lambda s, d: (lambda n: load_table(s, d, "customer").join(
        n.alias("a").join(n.alias("b"), F.col("b.n_nationkey") <= F.col("a.n_nationkey")).groupBy(F.col("a.n_nationkey").alias("c_nationkey")).agg(F.array_join(F.array_sort(F.collect_list("b.n_name")), " ").alias("names")), "c_nationkey"
    ).select("c_custkey", text.longest_name(F.concat_ws(" ", "c_mktsegment", "c_name", "names"), n.orderBy("n_nationkey").toPandas()["n_name"].tolist()).alias("name")))(load_table(s, d, "nation"))
)
query("c1_c6_chunk_counts", "SELECT doc_id AS doc, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS tokens FROM documents WHERE regexp_matches(text, '\\S')")(
    lambda s, d: load_table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.size(chunks.tokens("text")).cast("long").alias("tokens")).filter("tokens > 0")
)
query("a18_value_by_index", "SELECT event_type, list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT) + 1, count(*))] AS value FROM events WHERE value IS NOT NULL GROUP BY 1")(
    lambda s, d: relational.value_by_index(load_table(s, d, "events"), "event_type", "value", 0.95)
)
query("a18_rounded", "SELECT event_type, round(quantile_disc(value, 0.95), 6) AS nearest, quantile_disc(value, 0.95) AS high, round(quantile_cont(value, 0.5), 2) AS middle FROM events GROUP BY 1")(
    lambda s, d: load_table(s, d, "events").groupBy("event_type").agg(
        relational.percentile_nearest_rounded("value", 0.95, 6).alias("nearest"), relational.percentile_mixed("value", 0.95).alias("high"), relational.percentile_mixed("value", 0.5).alias("middle")
    )
)
query("u5_equal_multisets", "SELECT o_custkey, list_sort(list(o_orderstatus)) = list_sort(list(CASE WHEN o_totalprice > 250000 THEN 'F' ELSE o_orderstatus END)) AS equal FROM orders GROUP BY 1")(
    lambda s, d: relational.equal_multisets(load_table(s, d, "orders"), "o_custkey", F.col("o_orderstatus"), F.when(F.col("o_totalprice") > 250000, "F").otherwise(F.col("o_orderstatus")))
)
query("u4_ordered_dedupe", "SELECT doc_id, list_distinct(regexp_extract_all(lower(left(text, 40)), '[a-z]')) IS NOT NULL AS there, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z]'))) AS INT) AS n FROM documents")(
    lambda s, d: load_table(s, d, "documents").select("doc_id", F.lit(True).alias("there"), F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z])")))).alias("n"))
)

# ---- tables of pages that hold one: each order's line items as an HTML table ----------------

_ROWS = "SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS r, l_shipinstruct, q FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted 1' ELSE 'none' END AS l_shipinstruct FROM lineitem)"


def table_pages(s: SparkSession, d: str) -> DataFrame:
    """A page per order: a head row over two columns, then per line item its flag in words and its quantity."""
    word = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted 1").otherwise("none")
    rows = load_table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_extendedprice", word.alias("w"), F.col("l_quantity").cast("int").cast("string").alias("q")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(F.lit("<tr><td>"), x["w"], F.lit("</td><td>"), x["q"], F.lit("</td></tr>"))), "")
    return rows.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.concat(F.lit("<p>단위: 천원</p><table><tr><th colspan=2>Items</th></tr>"), body, F.lit("</table>")).alias("html"))


query("s7_order_cells", f"""WITH r AS ({_ROWS}) SELECT page_id, CAST(r AS INT) AS row_index, 0 AS column_index, 'data' AS cell_kind, l_shipinstruct AS text FROM r UNION ALL SELECT page_id, CAST(r AS INT), 1, 'data', q FROM r UNION ALL SELECT DISTINCT page_id, 0, 0, 'header', 'Items' FROM r""")(
    lambda s, d: markup.cells(table_pages(s, d)).select("page_id", "row_index", "column_index", "cell_kind", "text")
)
query("s8_order_header_paths", f"WITH r AS ({_ROWS}) SELECT page_id, CAST(r AS INT) AS row_index, c AS column_index, 'Items' AS column_path FROM r, (VALUES (0), (1)) t(c)")(
    lambda s, d: markup.header_paths(markup.cells(table_pages(s, d))).select("page_id", "row_index", "column_index", F.array_join("column_path", "/").alias("column_path"))
)
query("s9_order_labels", f"WITH r AS ({_ROWS}) SELECT page_id, CAST(r AS INT) AS row_index, l_shipinstruct AS text FROM r WHERE l_shipinstruct <> 'accepted 1'")(
    lambda s, d: markup.promote_labels(markup.cells(table_pages(s, d))).filter("cell_kind = 'header' and row_index > 0").select("page_id", "row_index", "text")
)
query("s11_order_facts", f"WITH r AS ({_ROWS}) SELECT page_id, CAST(r AS INT) AS row_index, l_shipinstruct AS predicate, q AS value FROM r")(
    lambda s, d: markup.key_value_facts(markup.cells(table_pages(s, d))).select("page_id", "row_index", "predicate", "value")
)
query("c4_table_units", f"WITH r AS ({_ROWS}) SELECT page_id, 'Items' AS header, CAST(r AS INT) AS row_index, l_shipinstruct || ' | ' || q AS text FROM r")(
    lambda s, d: chunks.table_units(markup.cells(table_pages(s, d))).select("page_id", "header", "row_index", "text")
)
query("c3_c6_prefixes", "SELECT p_partkey, 'Section: ' || p_brand || ' > ' || p_type || chr(10) || 'Caption: <none>' || chr(10) || 'Header: ' || p_name || chr(10) || 'Unit: 원' AS prefix, CASE WHEN p_size < 40 AND p_retailprice < 1500 THEN 'verified' ELSE 'unverified' END AS quality FROM part")(
    lambda s, d: load_table(s, d, "part").select(
        "p_partkey", chunks.prefix(F.array("p_brand", "p_type"), F.lit(""), F.col("p_name"), F.lit("원")).alias("prefix"),
        chunks.quality(F.when(F.col("p_size") >= 40, "pdf").otherwise("xml"), F.when(F.col("p_retailprice") < 1500, "success").otherwise("partial")).alias("quality"),
    )
)
query("s10_unit_caption", """WITH b AS (SELECT *, row_number() OVER w AS n, lag(o_orderpriority) OVER w AS p1, lag(o_orderpriority, 2) OVER w AS p2, lag(o_orderpriority, 3) OVER w AS p3, lag(o_orderpriority, 4) OVER w AS p4, lag(o_orderstatus) OVER w AS s1, lag(o_orderstatus, 2) OVER w AS s2, lag(o_orderstatus, 3) OVER w AS s3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
  SELECT o_orderkey AS table_no, CASE WHEN o_totalprice > 300000 THEN '원' WHEN '2-HIGH' IN (coalesce(p1, ''), coalesce(p2, ''), coalesce(p3, ''), coalesce(p4, '')) THEN '천원' END AS unit, CASE WHEN s1 = 'F' THEN p1 WHEN s2 = 'F' THEN p2 WHEN s3 = 'F' THEN p3 END AS head FROM b WHERE o_orderstatus = 'O'""")(
    lambda s, d: markup.unit_and_caption(
        load_table(s, d, "orders").select(
            F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("sequence_no"), F.when(F.col("o_orderstatus") == "O", "table").when(F.col("o_orderstatus") == "F", "paragraph").otherwise("note").alias("kind"), F.col("o_orderkey").alias("table_no"),
            F.when(F.col("o_totalprice") > 300000, " 원 ").alias("declared_unit"), F.when(F.col("o_orderpriority") == "2-HIGH", F.concat("o_orderpriority", F.lit(" (단위 : 천원)"))).otherwise(F.col("o_orderpriority")).alias("text"),
        )
    ).select("table_no", "unit", F.regexp_replace("caption", r" \(단위.*$", "").alias("head"))
)
