"""The papers relation derived from the documents table: deterministic, a pure function of each row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.dialect import Spark
from ..functions.told import Told, register

TITLES = [
    "with Large Language Models", "by Chain of Thought Reasoning", "for Machine Translation", "with Graph Neural Networks", "through Diffusion Models", "in Reinforcement Learning", "for Question Answering", "with Retrieval Augmented Generation",
    "for Object Detection", "under Federated Learning", "and Knowledge Graphs", "for Code Generation", "of Speech Recognition", "a Survey", "and Fairness", "Multimodal Learning",
]
SENTENCES = [
    "We propose a novel approach that outperforms the state of the art.", "This survey gives an overview of recent work.", "We prove a theorem on convergence with a simple proof.", "A limitation is that the method does not scale to long documents.",
    "Future work should address robustness under distribution shift.", "We study low resource languages and multilingual transfer.", "Our model is interpretable, simple and easy to deploy in production.", "Surprisingly, we find that bias and fairness remain open questions, and the puzzle is practical.",
    "In this paper we introduce a benchmark and a dataset with annotation.", "The approach is computationally expensive and fails to generalise beyond a single domain.", "Work done at Stanford and Google Research with OpenAI.", "We use a variational autoencoder with a latent space and contrastive pretraining.",
    "The tutorial is accessible and starts from scratch for beginners.", "Attention mechanism and transformer architectures are widely used foundational tools.", "Reinforcement learning from human feedback improves alignment and jailbreak defence.", "We present a scalable system for deployment in industry.",
    "However, hallucination and factuality cannot be measured by one leaderboard.", "We conduct experiments on general, diverse and broad few shot tasks.", "Image generation by a diffusion model needs few steps.", "An open problem is how the agent framework handles tool use, and it struggles with long horizons.",
    "Researchers at MIT and Carnegie Mellon report a negative result.", "We argue for a new model of dialogue.", "Visual question answering with a vision language model is challenging to evaluate and remains hard.", "Message passing on a knowledge graph helps information retrieval.",
]
NAMES = [
    "Ada Moreau", "Bo Lindqvist", "Carla Stein", "Dmitri Olsen", "Elif Kaya", "Farid Nasser", "Greta Holm", "Hiro Tanabe", "Ines Duarte", "Jonas Weber", "Keiko Mori", "Liam Byrne",
    "Mina Patel", "Noor Haddad", "Oskar Falk", "Paula Reyes", "Yoshua Bengio", "Percy Liang", "Mike Lewis", "Kaiming He", "Quentin Roux", "Rosa Vidal", "Sven Dahl", "Tara Singh",
]
AFFILIATIONS = ["Stanford University", "Google Research", "University of Oxford", "Tsinghua University", "DeepMind", "Small College", "Microsoft Research", "Cornell University", "University of Toronto", "IBM Research"]
VENUES = [
    ("arXiv", "arxiv", "preprint", ""), ("NeurIPS", "openreview", "conference", "A*"), ("ACL", "acl_anthology", "conference", "A*"), ("CVPR", "cvf", "conference", "A*"),
    ("arXiv", "arxiv", "preprint", ""), ("ICML", "pmlr", "conference", "A*"), ("EACL", "acl_anthology", "conference", "A"), ("AISTATS", "pmlr", "conference", "A"),
]


COLUMNS = "pos, id, title, abstract, authors, affiliations_raw, year, published_date, venue, source, source_type, conference_rank, paper_url, pdf_url, citations"


def papers(d: Spark) -> str:
    if d.relation:
        return f"SELECT {COLUMNS}, tags AS tags0 FROM {d.relation}"
    venue = [d.pick(d.texts([v[i] for v in VENUES]), "doc_id % 8 + 1") for i in range(4)]
    name = [d.pick(d.texts(NAMES), f"(doc_id * {m} + {a}) % {len(NAMES)} + 1") for m, a in ((1, 0), (7, 3), (11, 5), (13, 7))]
    site = [d.pick(d.texts(AFFILIATIONS), f"(doc_id * {m} + {a}) % {len(AFFILIATIONS)} + 1") for m, a in ((1, 0), (3, 1))]
    none = d.texts([])
    arxiv = "(doc_id % 8 IN (0, 4) OR doc_id % 10 IN (8, 9))"
    number = "lpad(CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS string), 5, '0')"
    version = "CASE WHEN doc_id % 10 = 9 THEN 'v2' ELSE 'v1' END"
    body = "coalesce(text, '')"
    head = d.join(d.slice(d.split("trim(body)", r"\s+", 9), 8), " ")
    return f"""
    SELECT doc_id AS pos,
      CASE WHEN {arxiv} THEN concat('arxiv:2401.', {number}, {version}) ELSE concat({venue[1]}, ':', CAST(doc_id AS string)) END AS id,
      concat({head}, ' ', {d.pick(d.texts(TITLES), "doc_id % 16 + 1")}) AS title,
      concat(body, ' ', {d.pick(d.texts(SENTENCES), "doc_id % 24 + 1")}, ' ', {d.pick(d.texts(SENTENCES), "(doc_id * 5 + 11) % 24 + 1")}) AS abstract,
      CASE doc_id % 4 WHEN 0 THEN {d.array(name[0])} WHEN 1 THEN {d.array(*name[:2])} WHEN 2 THEN {d.array(*name[:3])} ELSE {d.array(*name)} END AS authors,
      CASE WHEN doc_id % 3 = 0 THEN {d.array(*site)} ELSE {none} END AS affiliations_raw,
      CAST(2015 + doc_id % 12 AS int) AS year,
      concat(CAST(2015 + doc_id % 12 AS string), '-0', CAST(1 + doc_id % 9 AS string), '-1', CAST(doc_id % 10 AS string)) AS published_date,
      {venue[0]} AS venue, {venue[1]} AS source, {venue[2]} AS source_type, {venue[3]} AS conference_rank,
      concat('https://papers.example.org/', CAST(doc_id AS string)) AS paper_url,
      CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('https://papers.example.org/', CAST(doc_id AS string), '.pdf') END AS pdf_url,
      CAST(coalesce(n_chars, 0) % 500 AS bigint) AS citations,
      CASE doc_id % 5 WHEN 0 THEN {d.texts(["Machine Learning"])} WHEN 1 THEN {d.texts(["NLP", "Custom Topic"])} WHEN 2 THEN {d.texts(["Computer Vision"])} ELSE {none} END AS tags0
    FROM (SELECT {f"/*+ REPARTITION({d.spread}) */ " if d.spread else ""}doc_id, text, n_chars, {body} AS body FROM {d.table('documents')}) docs"""


#: Below this size a table is likely to be a row group or two, which are read by as many tasks.
SMALL_BYTES = 256 << 20


def corpus(spark: SparkSession, folder: str) -> Spark:
    """The dialect over a folder; a small table of documents is dealt over all cores, since the rules cost far more than moving it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/documents.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    small = files.exists(path) and files.getContentSummary(path).getLength() < SMALL_BYTES
    register(spark)
    return Told(folder, spread=spark.sparkContext.defaultParallelism if small else 0)
