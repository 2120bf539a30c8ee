"""Filings in the XML dialect, made of customers: well formed ones and ones that need repair; and sources in two charsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.plans.registry import query
from filigree.session import load_table
from filigree.sources import dialect

_BAL = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)"
_FRAGMENTS = f"""WITH c AS (SELECT c_custkey, c_mktsegment AS seg, 'Account ' || CASE c_custkey % 5 WHEN 1 THEN '& ' WHEN 4 THEN '< ' ELSE '' END || c_name || CASE WHEN c_custkey % 5 = 2 THEN ' Balance ' || {_BAL} || ' inside' ELSE '' END AS p, 'Balance ' || {_BAL} AS te FROM customer),
  f AS (SELECT c_custkey, 0 AS sequence_no, 'heading' AS kind, 'TITLE' AS tag, seg AS section_path, seg AS text FROM c UNION ALL SELECT c_custkey, 1, 'paragraph', 'P', seg, p FROM c UNION ALL SELECT c_custkey, 2, 'paragraph', 'TE', seg || '/SECTION-2', te FROM c)"""


def filings(s: SparkSession, d: str) -> DataFrame:
    """A filing per customer; of five one is well formed, the others have a stray &, an unclosed P, a stray end tag, a stray <."""
    kind = F.col("c_custkey") % 5
    lead = F.when(kind == 1, "Account & ").when(kind == 4, "Account < ").otherwise("Account ")
    parts = [
        F.lit("<?xml version='1.0' encoding='EUC-KR'?>\n<DOCUMENT><SECTION-1><TITLE>"), F.col("c_mktsegment"), F.lit("</TITLE>"), F.when(kind == 3, "</TU>").otherwise(""), F.lit("\n<P>"), lead, F.col("c_name"), F.when(kind == 2, "").otherwise("</P>"),
        F.lit("<SECTION-2><TITLE> </TITLE><TE>Balance<B>"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("</B></TE></SECTION-2><TABLE><TR><TD><P>inside</P></TD></TR></TABLE><IMG SRC='a>b'/></SECTION-1></DOCUMENT>"),
    ]
    return load_table(s, d, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(*parts).alias("body"))


query("s6_dialect_fragments", f"{_FRAGMENTS} SELECT c_custkey AS page_id, sequence_no, kind, tag, section_path, text FROM f")(
    lambda s, d: dialect.read_filings(filings(s, d))[2].withColumn("section_path", F.array_join("section_path", "/"))
)
query("s5_parser_warnings", """WITH k AS (SELECT c_custkey, c_custkey % 5 AS k FROM customer WHERE c_custkey % 5 > 0)
  SELECT c_custkey AS page_id, 0 AS n, 'strict' AS phase, 'FATAL' AS level, CASE WHEN k IN (1, 4) THEN 'not well-formed (invalid token)' ELSE 'mismatched tag' END AS message, CASE k WHEN 3 THEN 2 ELSE 3 END AS line FROM k
  UNION ALL SELECT c_custkey, 1, 'recovery', 'ERROR', CASE k WHEN 1 THEN 'unescaped &' WHEN 2 THEN 'unclosed P' WHEN 3 THEN 'end tag without start TU' ELSE 'unescaped <' END, CASE k WHEN 3 THEN 2 ELSE 3 END FROM k""")(
    lambda s, d: dialect.read_filings(filings(s, d))[1].select("page_id", "n", "phase", "level", "message", "line")
)
query("s5_parse_statuses", "SELECT CASE c_custkey % 5 WHEN 0 THEN 'success' ELSE 'recovered' END AS status, 1 AS images, count(*) AS filings FROM customer GROUP BY 1")(
    lambda s, d: dialect.read_filings(filings(s, d))[0].groupBy("status", "images").agg(F.count("*").alias("filings"))
)


def sources(s: SparkSession, d: str) -> DataFrame:
    """Bytes per customer: Korean in either charset or bytes of neither, at once or across the border of the first 8 KiB (where the first byte alone may still be a cut character)."""
    k = F.col("c_custkey")
    words = F.when(k % 3 == 0, F.unhex(F.lit("EAB3A0EAB09D"))).when(k % 3 == 1, F.unhex(F.lit("B0EDB0B4"))).otherwise(F.unhex(F.lit("FFFF")))
    pad = F.when(k % 2 == 0, F.col("c_name")).otherwise(F.rpad("c_name", dialect.HEAD - 1, "x")).cast("binary")
    return load_table(s, d, "customer").select("c_custkey", F.concat(pad, words).alias("content"))


query("s3_charsets", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'utf-8' WHEN c_custkey % 6 <> 2 THEN 'cp949' END AS charset, CASE WHEN c_custkey % 3 < 2 THEN left(c_name, 3) || '고객' WHEN c_custkey % 6 = 5 THEN left(c_name, 3) || chr(65533) || chr(65533) END AS ends FROM customer")(
    lambda s, d: sources(s, d).select("c_custkey", dialect.decoded("content").alias("x")).select("c_custkey", "x.charset", F.concat(F.left("x.text", F.lit(3)), F.right("x.text", F.lit(2))).alias("ends"))
)
