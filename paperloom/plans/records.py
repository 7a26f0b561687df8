"""Queries on decoded records: documents written as old and new JSON texts, some of them broken, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.embedded import by_key, embedded
from ..sources.records import decode

WORDS = ("beginner", "advanced", "Frontier", "unheard")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents under old names; of every seven one is cut, one in a list, one without id, one of a wrong year."""
    n = F.col("doc_id")
    old, turn = n % 2 == 0, n % 7
    word = F.element_at(F.array(*map(F.lit, WORDS)), (n % 8 / 2 + 1).cast("int"))
    record = F.struct(
        F.when(turn != 2, F.concat(F.lit("doc:"), n.cast("string"))).alias("id"), F.col("text").alias("abstract"), F.col("lang").alias("venue"), F.when(turn == 3, "n/a").otherwise((2000 + n % 20).cast("string")).alias("year"),
        F.when(old, F.concat(F.lit("https://old/"), n.cast("string"))).alias("url"), F.when(~old, F.concat(F.lit("https://new/"), n.cast("string"))).alias("paper_url"), F.when(old, word).alias("difficulty"),
        F.when(~old & (turn != 5), "L4").alias("difficulty_level"), F.when(n % 3 == 0, F.array(F.col("source"), F.lit("x"))).alias("tags"), F.lit("ignored").alias("unknown"),
    )
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").withColumn("j", F.to_json(record))
    cut, listed = F.expr("left(j, length(j) - 1)"), F.concat(F.lit("["), F.col("j"), F.lit("]"))
    return whole.select("doc_id", F.when(turn == 0, cut).when(turn == 1, listed).otherwise(F.col("j")).alias("value"))


def decode_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each text, or its fault."""
    rows = decode(_texts(spark, sf_dir), "paper")
    r = F.col("record")
    return rows.select("doc_id", "fault", r["id"].alias("id"), F.md5(r["abstract"].cast("binary")).alias("abstract_md5"), r["venue"].alias("venue"), r["year"].alias("year"), r["paper_url"].alias("paper_url"), r["difficulty_level"].alias("level"), F.array_join(r["tags"], "|").alias("tags"), r["source_type"].alias("source_type"))


def embedded_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an array of two venues in a script after their own; of the venues of one name the last."""
    n = F.col("page_id")
    script = F.concat(
        F.lit("<script>const VENUES = [{short: 'V"), (n % 40).cast("string"), F.lit("', name: \"It's [one], {"), n.cast("string"), F.lit("}\", /* short: 'no' */ top: "), F.when(n % 2 == 0, "true").otherwise("false"),
        F.lit("}, // next\n{ short: ' v"), (n % 7).cast("string"), F.lit("', name: 'a \\'b\\' "), n.cast("string"), F.lit("' }];</script>"),
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null").select("page_id", F.concat(F.coalesce("html", F.lit("")), script).alias("html"))
    found = by_key(embedded(pages, "VENUES"), "page_id")
    return found.select("id", F.try_element_at("fields", F.lit("name")).alias("name"), F.try_element_at("fields", F.lit("top")).alias("top"))


QUERIES = {"decode_papers": decode_papers, "embedded_venues": embedded_venues}

_OK = "doc_id % 7 > 3"
ORACLE_SQL = {
    "decode_papers": f"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'no id' WHEN 3 THEN 'year: not bigint' END AS fault, CASE WHEN {_OK} THEN 'doc:' || doc_id END AS id,
      CASE WHEN {_OK} THEN md5(coalesce(text, '')) END AS abstract_md5, CASE WHEN {_OK} THEN coalesce(lang, '') END AS venue, CASE WHEN {_OK} THEN 2000 + doc_id % 20 END AS year,
      CASE WHEN {_OK} THEN CASE WHEN doc_id % 2 = 0 THEN 'https://old/' || doc_id ELSE 'https://new/' || doc_id END END AS paper_url,
      CASE WHEN {_OK} THEN CASE WHEN doc_id % 8 = 0 THEN 'L1' WHEN doc_id % 8 = 2 THEN 'L3' WHEN doc_id % 2 = 1 AND doc_id % 7 <> 5 THEN 'L4' ELSE 'L2' END END AS level,
      CASE WHEN {_OK} THEN CASE WHEN doc_id % 3 = 0 THEN concat_ws('|', source, 'x') ELSE '' END END AS tags, CASE WHEN {_OK} THEN 'preprint' END AS source_type FROM documents WHERE doc_id IS NOT NULL""",
    "embedded_venues": """SELECT id, arg_max(name, k) AS name, nullif(arg_max(top, k), 'absent') AS top FROM (
      SELECT 'v' || page_id % 40 AS id, page_id * 2 AS k, 'It''s [one], {' || page_id || '}' AS name, CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END AS top FROM pages
      UNION ALL SELECT 'v' || page_id % 7, page_id * 2 + 1, 'a ''b'' ' || page_id, 'absent' FROM pages) t WHERE id IS NOT NULL GROUP BY id""",
}
