"""Records of any age as JSON text, decoded into one schema for each entity; what can't be is set apart with its fault.

A text is parsed once into a VARIANT, and fields are taken from it by type.  Unknown
fields are left out; absent and null ones take the default.  A field under its old name
counts only where the new name is absent.  A list or a map of another type becomes empty;
a number, a text or a flag of another type is a fault, as is a record without its key.
Numbers in quotes are numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"beginner": "L1", "intermediate": "L2", "advanced": "L3", "frontier": "L4"}


@dataclass(frozen=True)
class Entity:
    key: str
    texts: str
    lists: str = ""
    longs: str = ""
    doubles: str = ""
    maps: dict[str, str] = field(default_factory=dict)
    #: Defaults other than blank, zero and empty.
    defaults: dict[str, object] = field(default_factory=dict)
    #: New name to old name.
    aliases: dict[str, str] = field(default_factory=dict)

    def fields(self) -> Iterator[tuple[str, str, Column]]:
        """Name, type and default of each field."""
        for kind, names, empty in (("string", self.texts, ""), ("bigint", self.longs, 0), ("double", self.doubles, 0.0)):
            for name in names.split():
                yield name, kind, F.lit(self.defaults.get(name, empty)).cast(kind)
        for name in self.lists.split():
            yield name, "array<string>", F.array().cast("array<string>")
        for name, kind in self.maps.items():
            yield name, f"map<string,{kind}>", F.from_json(F.lit("{}"), f"map<string,{kind}>")


# Names of fields, their defaults and their old names.
ENTITIES = {
    "paper": Entity(
        "id",
        "id canonical_id source source_type title abstract published_date venue conference_rank paper_url pdf_url cluster_id paper_type difficulty_level difficulty_reason maturity_stage summary key_contribution why_it_matters"
        " content_hook plain_english_explanation technical_summary tweet_thread linkedin_post newsletter_blurb video_script_outline one_line_takeaway biggest_caveat read_this_if fetched_at",
        "authors author_ids affiliations_raw lab_ids university_ids topics tags prerequisites limitations future_work research_gap_signals",
        "year citations",
        "paper_score read_first_score content_potential_score interestingness_score hype_score evidence_strength",
        {"score_breakdown": "string"},
        {"source_type": "preprint", "difficulty_level": "L2", "maturity_stage": "emerging"},
        {"paper_url": "url", "difficulty_level": "difficulty"},
    ),
    "author": Entity("author_id", "author_id name summary_profile", "aliases affiliations paper_ids recent_paper_ids topics lab_ids university_ids", "h_index", "avg_paper_score momentum_score", {"momentum_breakdown": "double", "conference_counts": "bigint"}, aliases={"author_id": "id", "topics": "top_topics"}),
    "lab": Entity("lab_id", "lab_id name university summary_profile", "aliases authors paper_ids recent_papers topics", "a_star_output", "avg_paper_score momentum_score", aliases={"lab_id": "id"}),
    "university": Entity("university_id", "university_id name summary_profile", "aliases authors papers topics", "", "momentum_score", {"conference_output": "bigint"}),
    "topic": Entity("id", "id name gap_summary difficulty", "keywords paper_ids starter_pack_ids frontier_pack_ids prerequisites related_topics", "", "trend_score", defaults={"difficulty": "intermediate"}),
    "gap": Entity("gap_id", "gap_id topic title description gap_type starter_idea", "evidence_paper_ids suggested_projects", "frequency", "confidence", defaults={"gap_type": "explicit", "frequency": 1, "confidence": 0.5}, aliases={"gap_id": "id", "evidence_paper_ids": "source_paper_ids"}),
}


def decode(rows: DataFrame, entity: str, column: str = "value") -> DataFrame:
    """``rows`` with ``record``, a struct of the entity's fields, and ``fault``; one of the two is null.

    Columns of ``rows`` stay; of its own columns only those two names are taken, so rows
    that have one of them are refused.  Faults: ``not JSON`` (null and blank texts too),
    ``not an object``, ``no <key>``, and ``<field>: not <type>``, the first that applies.
    """
    taken = {"record", "fault", "_parsed", "_given"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    what = ENTITIES[entity]
    parsed = rows.withColumn("_parsed", F.try_parse_json(F.nullif(F.trim(column), F.lit(""))))
    whole = F.col("_parsed")

    def under(name: str) -> Column:
        return F.try_variant_get(whole, f"$.{name}", "variant")

    given = []
    for name, _, _ in what.fields():
        old = what.aliases.get(name)
        raw = under(name)
        if old:
            # A blank key counts as absent.
            there = raw.isNotNull() if name != what.key else F.coalesce(F.try_variant_get(whole, f"$.{name}", "string"), F.lit("")) != ""
            raw = F.when(there, raw).otherwise(under(old))
            if (name, old) == ("difficulty_level", "difficulty"):
                words = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
                level = F.coalesce(F.try_element_at(words, F.try_variant_get(whole, f"$.{old}", "string")), F.lit("L2"))
                raw = F.when(there, under(name)).when(under(old).isNotNull(), F.try_parse_json(F.concat(F.lit('"'), level, F.lit('"'))))
        given.append(raw.alias(name))
    taken_out = parsed.withColumn("_given", F.struct(*given))
    values, faults = [], []
    for name, kind, default in what.fields():
        raw = F.col("_given")[name]
        value = F.try_variant_get(raw, "$", kind)
        if kind == "string":
            # Nested values would come out as JSON.
            value = F.when(~F.schema_of_variant(raw).rlike("^(OBJECT|ARRAY)"), value)
        values.append(F.coalesce(value, default).alias(name))
        if kind in ("string", "bigint", "double"):
            faults.append(F.when(raw.isNotNull() & ~F.is_variant_null(raw) & value.isNull(), f"{name}: not {kind}"))
    key = F.coalesce(F.try_variant_get(F.col("_given")[what.key], "$", "string"), F.lit(""))
    fault = F.coalesce(F.when(whole.isNull(), "not JSON"), F.when(~F.schema_of_variant(whole).startswith("OBJECT"), "not an object"), *faults, F.when(key == "", f"no {what.key}"))
    judged = taken_out.withColumn("fault", fault)
    return judged.withColumn("record", F.when(F.col("fault").isNull(), F.struct(*values))).drop("_parsed", "_given")


def records(decoded: DataFrame) -> DataFrame:
    return decoded.where("fault is null").select("record.*")


def quarantine(decoded: DataFrame, column: str = "value") -> DataFrame:
    """Texts that gave no record, and why."""
    return decoded.where("fault is not null").select(F.col(column).alias("value"), "fault")


def with_old_names(rows: DataFrame, entity: str) -> DataFrame:
    """Canonical rows with the fields that readers of old files look for."""
    what = ENTITIES[entity]
    out = {old: F.col(new) for new, old in what.aliases.items()}
    if entity == "paper":
        words = F.create_map(*[F.lit(x) for word, level in LEVELS.items() for x in (level, word)])
        out["difficulty"] = F.coalesce(F.try_element_at(words, F.col("difficulty_level")), F.lit("intermediate"))
    if entity in ("author", "lab"):
        out["top_topics"] = F.slice("topics", 1, 5)
    return rows.withColumns(out) if out else rows
