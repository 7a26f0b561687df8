"""Parsers from landed files to papers: BibTeX, Atom and OAI XML, JSON records, HTML listings.

Fetching is not part of the library: each source is a folder of raw files, read by
Spark's own readers, and one of these projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import with_defaults

# Category codes and their tags.
CATEGORIES = {
    "cs.AI": "Artificial Intelligence", "cs.CL": "NLP", "cs.CV": "Computer Vision", "cs.LG": "Machine Learning", "cs.NE": "Neural Networks", "cs.RO": "Robotics", "cs.IR": "Information Retrieval", "cs.SE": "Software Engineering", "cs.DB": "Databases", "cs.CR": "Cryptography & Security",
    "cs.HC": "Human-Computer Interaction", "cs.MA": "Multi-Agent Systems", "cs.GR": "Computer Graphics", "cs.MM": "Multimedia", "cs.SY": "Systems & Control", "cs.DC": "Distributed Computing", "cs.PL": "Programming Languages", "cs.GT": "Game Theory", "cs.DS": "Data Structures & Algorithms",
}
# Anthology keys, venues and ranks.
ANTHOLOGY = {
    "acl": ("ACL", "A*"), "emnlp": ("EMNLP", "A*"), "naacl": ("NAACL", "A*"), "eacl": ("EACL", "A"), "coling": ("COLING", "A"),
    "conll": ("CoNLL", "A"), "tacl": ("TACL", "A"), "cl": ("CL", "A"), "findings": ("Findings", "A"),
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def category_tags(categories: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(categories, lambda c: _lookup(CATEGORIES, c)), lambda t: t.isNotNull()))


def _one_line(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def year_of(raw: Column) -> Column:
    return F.coalesce(F.left(F.trim(raw), F.lit(4)).try_cast("int"), F.lit(0))


ATOM = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_href:string,_type:string>>"


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    return atom_papers(spark.read.format("xml").schema(ATOM).option("rowTag", "entry").load(path))


def atom_papers(entries: DataFrame) -> DataFrame:
    """Atom entries; those outside computer science are dropped."""
    number = F.substring_index("id", "/abs/", -1)
    terms = F.transform("category", lambda c: c["_term"])
    rows = entries.where(F.exists(terms, lambda c: c.startswith("cs.")))
    pdf = F.get(F.filter("link", lambda x: x["_type"] == "application/pdf"), F.lit(0))["_href"]
    return with_defaults(rows.select(
        F.concat(F.lit("arxiv:"), number).alias("id"), F.lit("arxiv").alias("source"), F.lit("preprint").alias("source_type"), F.lit("arXiv").alias("venue"), _one_line(F.col("title")).alias("title"), _one_line(F.col("summary")).alias("abstract"),
        F.transform("author", lambda a: a["name"]).alias("authors"), year_of(F.col("published")).alias("year"), F.left("published", F.lit(10)).alias("published_date"), F.col("id").alias("paper_url"), F.coalesce(pdf, F.lit("")).alias("pdf_url"), category_tags(terms).alias("tags"),
    ))


OAI = "header struct<_status:string>, id string, created string, title string, abstract string, categories string, authors struct<author:array<struct<keyname:string,forenames:string>>>"


def oai_papers(records: DataFrame) -> DataFrame:
    """Harvested records; deleted ones, those without id and those outside computer science are dropped."""
    cats = F.split(F.coalesce("categories", F.lit("")), " ")
    live = (F.coalesce(F.col("header._status"), F.lit("")) != "deleted") & (F.coalesce("id", F.lit("")) != "") & F.exists(cats, lambda c: c.startswith("cs."))
    names = F.transform("authors.author", lambda a: F.trim(F.concat_ws(" ", a["forenames"], a["keyname"])))
    return with_defaults(records.where(live).select(
        F.concat(F.lit("arxiv:"), F.col("id")).alias("id"), F.lit("arxiv").alias("source"), F.lit("preprint").alias("source_type"), F.lit("arXiv").alias("venue"), _one_line(F.col("title")).alias("title"), _one_line(F.col("abstract")).alias("abstract"),
        names.alias("authors"), year_of(F.col("created")).alias("year"), F.col("created").alias("published_date"), F.concat(F.lit("https://arxiv.org/abs/"), F.col("id")).alias("paper_url"), category_tags(cats).alias("tags"),
    ))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of (compressed) BibTeX files, one row each: the files are split at the entries, not read whole."""
    return spark.read.option("lineSep", "\n@").text(path)


def bibtex_records(entries: DataFrame) -> DataFrame:
    """``key`` and the usual fields of each entry; accents and braces are stripped."""

    def field(name: str) -> Column:
        braced = F.regexp_extract("value", rf"(?s)\n\s*{name}\s*=\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", 1)
        quoted = F.regexp_extract("value", rf'(?s)\n\s*{name}\s*=\s*"((?:[^"{{}}]|\{{[^{{}}]*\}})*)"', 1)
        raw = F.coalesce(F.nullif(braced, F.lit("")), quoted)
        return _one_line(F.regexp_replace(F.regexp_replace(raw, r"\\[a-zA-Z'`^\"~=.]+\s*", ""), r"[{}]", "")).alias(name)

    key = F.regexp_extract("value", r"^@?\w+\{\s*([^,\s]+)\s*,", 1)
    names = ["title", "author", "abstract", "year", "url", "booktitle", "journal"]
    return entries.select("value", key.alias("key")).where("key <> ''").select("key", *[field(n) for n in names])


def anthology_key(key: Column) -> Column:
    """``2024.acl-long.1`` gives ``acl``; legacy J and Q give ``cl`` and ``tacl``."""
    modern = F.split_part(F.split_part(F.lower(key), F.lit("."), F.lit(2)), F.lit("-"), F.lit(1))
    return F.when(key.rlike(r"^\d{4}\."), modern).when(key.startswith("J"), "cl").when(key.startswith("Q"), "tacl").otherwise("")


def anthology_papers(records: DataFrame, min_year: int = 2020) -> DataFrame:
    """Anthology records of the known venues from ``min_year`` on; the first of an id counts."""
    venue = anthology_key(F.col("key"))
    rows = records.withColumn("_venue", venue).withColumn("_year", year_of(F.col("year")))
    rows = rows.where(F.col("_venue").isin(list(ANTHOLOGY)) & (F.col("_year") >= min_year) & (F.col("title") != "")).dropDuplicates(["key"])
    return with_defaults(rows.select(
        F.concat(F.lit("acl:"), F.col("key")).alias("id"), F.lit("acl_anthology").alias("source"), F.lit("conference").alias("source_type"), "title", "abstract", F.filter(F.split("author", r"\s+and\s+"), lambda a: a != "").alias("authors"), F.col("_year").alias("year"),
        _lookup({k: v for k, (v, _) in ANTHOLOGY.items()}, F.col("_venue")).alias("venue"), _lookup({k: r for k, (_, r) in ANTHOLOGY.items()}, F.col("_venue")).alias("conference_rank"), F.col("url").alias("paper_url"), F.concat(F.col("url"), F.lit(".pdf")).alias("pdf_url"),
    ))


RECORD = "paperId string, title string, abstract string, year int, venue string, citationCount long, authors array<struct<name:string,affiliations:array<string>>>, externalIds struct<ArXiv:string,DOI:string>, fieldsOfStudy array<string>, openAccessPdf struct<url:string>"


def record_papers(records: DataFrame) -> DataFrame:
    """Scholar records: affiliations flattened in order, url from arXiv, DOI or the service, tags from the first four fields."""
    rows = records.where(F.coalesce("title", F.lit("")) != "")
    places = F.array_distinct(F.filter(F.flatten(F.transform("authors", lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>")))), lambda x: x.isNotNull()))
    url = F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), F.col("externalIds.ArXiv")), F.concat(F.lit("https://doi.org/"), F.col("externalIds.DOI")), F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.col("paperId")))
    return with_defaults(rows.select(
        F.concat(F.lit("s2:"), F.col("paperId")).alias("id"), F.lit("s2").alias("source"), F.lit("conference").alias("source_type"), "title", "abstract", F.transform("authors", lambda a: a["name"]).alias("authors"), places.alias("affiliations_raw"), "year", "venue",
        F.col("citationCount").alias("citations"), url.alias("paper_url"), F.col("openAccessPdf.url").alias("pdf_url"), F.slice(F.coalesce("fieldsOfStudy", F.array().cast("array<string>")), 1, 4).alias("tags"),
    ))


def note_papers(notes: DataFrame, venue: str, rank: str, year: int) -> DataFrame:
    """Review-site notes as JSON text in ``value``; a field is a value or an object that holds one.  Untitled notes are dropped."""
    v = F.try_parse_json("value")

    def field(name: str, kind: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.content.{name}.value", kind), F.try_variant_get(v, f"$.content.{name}", kind))

    title = F.trim(F.coalesce(field("title", "string"), F.lit("")))
    ident = F.try_variant_get(v, "$.id", "string")
    rows = notes.select(ident.alias("i"), title.alias("title"), field("abstract", "string").alias("abstract"), field("authors", "array<string>").alias("authors")).where("title <> ''")
    return with_defaults(rows.select(
        F.concat(F.lit("openreview:"), F.col("i")).alias("id"), F.lit("openreview").alias("source"), F.lit("conference").alias("source_type"), "title", "abstract", "authors", F.lit(venue).alias("venue"), F.lit(rank).alias("conference_rank"), F.lit(year).alias("year"),
        F.concat(F.lit("https://openreview.net/forum?id="), F.col("i")).alias("paper_url"), F.concat(F.lit("https://openreview.net/pdf?id="), F.col("i")).alias("pdf_url"),
    ))


def listing_papers(pages: DataFrame, html: str = "html") -> DataFrame:
    """``title, authors, abstract, href`` of each ``div.paper`` of listing pages."""
    blocks = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r'(?s)<div class="paper">(.*?)</div>'), F.lit(1))).alias("b"))

    def inner(cls: str) -> Column:
        return _one_line(F.regexp_replace(F.regexp_extract("b", rf'(?s)class="{cls}"[^>]*>(.*?)</(?:p|span|div)>', 1), "<[^>]+>", ""))

    authors = inner("authors")
    split = F.when(F.contains(authors, F.lit("·")), F.split(authors, "·")).otherwise(F.filter(F.split(authors, ","), lambda a: F.length(F.trim(a)) > 1))
    return blocks.select(inner("title").alias("title"), F.filter(F.transform(split, lambda a: F.trim(a)), lambda a: a != "").alias("authors"), inner("abstract").alias("abstract"), F.regexp_extract("b", r'href="([^"]+)"', 1).alias("href")).where("title <> ''")


def recent(papers: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """The rolling store: papers of no conference not older than ``days``; undated ones stay."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days).cast("string")
    own = ~F.coalesce("venue", F.lit("")).isin("", "arXiv", "Unknown")
    return papers.where(~own & (F.coalesce(F.nullif("published_date", F.lit("")), F.lit("9999-01-01")) >= cutoff))


def enrich(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Affiliations from ``found`` (arxiv_id, affiliations) for papers that have none."""
    number = F.regexp_extract("id", r"^arxiv:([0-9]{4}\.[0-9]{4,5})", 1)
    rows = papers.join(found.select(F.col("arxiv_id").alias("_a"), F.array_distinct("affiliations").alias("_f")), number == F.col("_a"), "left")
    better = (F.size("affiliations_raw") == 0) & (F.coalesce(F.size("_f"), F.lit(0)) > 0)
    return rows.withColumn("affiliations_raw", F.when(better, F.col("_f")).otherwise(F.col("affiliations_raw"))).drop("_a", "_f")
