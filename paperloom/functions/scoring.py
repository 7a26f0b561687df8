"""Classification and scores of a paper as expressions over its columns.

All take a dialect and give SQL text; columns are those of the papers relation.
"""

from __future__ import annotations

from ..rules import tables as R
from .dialect import Spark
from .text import words

TEXT = "concat(title, ' ', abstract)"
#: Letters and digits beyond ASCII: to some engines they end a word for ``\b``, to others they don't.
FOREIGN = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{M}]"


def folded(d: Spark, x: str) -> str:
    """Text for the rules, whose patterns are ASCII: a foreign letter stays part of its word and matches nothing."""
    return d.replace(x, FOREIGN, "_")


def matched_tags(d: Spark) -> str:
    found = d.array(*[f"CASE WHEN {d.has('tags0', d.text(t))} OR {d.like('txt', p)} THEN {d.text(t)} END" for t, p in R.TAGS])
    return d.filter(found, "x IS NOT NULL")


def superseded(d: Spark, tags: str) -> str:
    """Custom tags pass through; the pairs are applied one after the other."""
    for tag, gone in R.SUPERSEDED:
        tags = f"CASE WHEN {d.has(tags, d.text(tag))} THEN {d.filter(tags, f'x NOT IN ({", ".join(map(d.text, gone))})')} ELSE {tags} END"
    return tags


def custom_tags(d: Spark) -> str:
    return d.filter("tags0", f"x NOT IN ({', '.join(d.text(t) for t, _ in R.TAGS)})")


def cascade(d: Spark, x: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    """The name of the first pattern that matches."""
    return "CASE " + " ".join(f"WHEN {d.like(x, p)} THEN {d.text(n)}" for n, p in rules) + f" ELSE {otherwise} END"


def level(d: Spark) -> str:
    l1, l3 = (d.overlap("tags", d.texts(x)) for x in (R.L1_TAGS, R.L3_TAGS))
    return f"""CASE WHEN {d.like('txt', R.L1_PATTERN)} THEN 'L1'
      WHEN paper_type IN ('survey', 'tutorial') AND NOT {d.like('txt', R.L3_PATTERN)} THEN 'L1'
      WHEN {l1} AND NOT {d.like('txt', R.L3_PATTERN)} AND NOT {d.like('txt', R.L4_PATTERN)} THEN 'L1'
      WHEN {d.like('txt', R.L4_PATTERN)} THEN 'L4'
      WHEN {d.like('txt', R.L3_PATTERN)} OR {l3} THEN 'L3' ELSE 'L2' END"""


def level_reason(d: Spark) -> str:
    def named(names: list[str]) -> str:
        return d.join(d.slice(d.sort(d.filter("tags", f"x IN ({', '.join(map(d.text, names))})")), 2), ", ")

    l3 = d.overlap("tags", d.texts(R.L3_TAGS))
    return f"""CASE difficulty_level WHEN 'L1' THEN
        CASE WHEN {d.like('txt', R.L1_PATTERN)} THEN 'Survey, tutorial, or introductory material — accessible to beginners.'
             WHEN paper_type IN ('survey', 'tutorial') AND NOT {d.like('txt', R.L3_PATTERN)} THEN concat({d.text("Paper type is '")}, paper_type, {d.text("' with no advanced technical content.")})
             ELSE concat('Applied NLP/ML topic (', {named(R.L1_TAGS)}, ') with no advanced math.') END
      WHEN 'L4' THEN concat('Requires deep theoretical background — uses ', lower({d.first('txt', R.L4_PATTERN)}), ' and related concepts.')
      WHEN 'L3' THEN CASE WHEN {l3} THEN concat('Advanced topic (', {named(R.L3_TAGS)}, ') requiring graduate-level background.')
             ELSE concat('Uses ', lower({d.first('txt', R.L3_PATTERN)}), ' — requires solid ML/DL background.') END
      ELSE 'Intermediate: suitable for readers with undergraduate ML/NLP background.' END"""


def recency(as_of_year: int) -> str:
    age = f"({as_of_year} - year)"
    return f"CASE WHEN coalesce(year, 0) = 0 OR {age} >= 10 THEN 0.0e0 WHEN {age} <= 0 THEN 10.0e0 ELSE 10.0e0 * (1 - {age} / 10.0e0) END"


def novelty(d: Spark) -> str:
    return f"greatest(least(1.5e0 * {d.count('txt', R.NOVELTY_UP)}, 10.0e0) - least(2.0e0 * {d.count('txt', R.NOVELTY_DOWN)}, 5.0e0), 0.0e0)"


def rank_score() -> str:
    return "CASE conference_rank " + " ".join(f"WHEN '{r}' THEN {s}e0" for r, s in R.RANKS) + " ELSE 0.0e0 END"


def quality_hint() -> str:
    cite = "least(10.0e0 * ln(1 + citations) / ln(1001), 10.0e0)"
    return two_places(f"CASE WHEN {rank_score()} > 0 THEN 0.7e0 * {rank_score()} + 0.3e0 * {cite} ELSE {cite} END")


def completeness(d: Spark) -> str:
    return f"""CASE WHEN abstract <> '' THEN 3.0e0 ELSE 0e0 END + CASE WHEN {d.size('authors')} > 0 THEN 2.0e0 ELSE 0e0 END + CASE WHEN pdf_url <> '' THEN 1.0e0 ELSE 0e0 END
      + CASE WHEN {d.size('tags')} > 0 THEN 1.5e0 ELSE 0e0 END"""


def housing(d: Spark) -> str:
    """Where institutions are looked for."""
    return f"CASE WHEN {d.size('affiliations_raw')} > 0 THEN {d.join('affiliations_raw', ' ')} ELSE abstract END"


def institution(d: Spark) -> str:
    where = folded(d, housing(d))
    return "CASE " + " ".join(f"WHEN {d.like(where, p)} THEN {s}e0" for s, p in R.INSTITUTIONS) + " ELSE 0.0e0 END"


def author(d: Spark) -> str:
    lowered = d.map("authors", "lower(x)")
    parts = []
    for score, sure, unsure in R.AUTHORS:
        parts.append(f"WHEN {d.overlap(lowered, d.texts([n.lower() for n in sure]))} THEN {score}e0")
        parts.append(f"WHEN institution_prestige > 0 AND {d.overlap(lowered, d.texts([n.lower() for n in unsure]))} THEN {score}e0")
    return "CASE " + " ".join(parts) + " ELSE 0.0e0 END"


def capped(d: Spark, pattern: str, weight: float) -> str:
    return f"least({weight}e0 * {d.count('txt', pattern)}, 10.0e0)"


def clarity(d: Spark) -> str:
    return f"least(({words(d, 'abstract', 125)}) / 25.0e0, 5.0e0) + least(1.5e0 * {d.count(folded(d, 'abstract'), R.CLARITY)}, 5.0e0)"


def accessibility() -> str:
    return "CASE difficulty_level WHEN 'L1' THEN 10.0e0 WHEN 'L2' THEN 7.0e0 WHEN 'L3' THEN 4.0e0 WHEN 'L4' THEN 1.5e0 ELSE 5.0e0 END"


def hot(d: Spark) -> str:
    return f"least(2.5e0 * {d.size(d.filter('tags', f'x IN ({", ".join(map(d.text, R.HOT_TAGS))})'))}, 10.0e0)"


def two_places(x: str) -> str:
    """Half up; to six places first, so that ties don't hang on the order of additions, and in integers, as engines round doubles differently."""
    return f"floor((CAST(round(({x}) * 1000000) AS bigint) + 5000) / 10000.0e0) / 100.0e0"


def one_place(x: str) -> str:
    return f"floor((CAST(round(({x}) * 100) AS bigint) + 5) / 10.0e0) / 10.0e0"


def clamped(raw: str) -> str:
    return two_places(f"least(greatest({raw}, 0.0e0), 10.0e0)")


#: Weights of paper_score: as configured (sum 1.25) and as built in (sum 1.00).
WEIGHTS = {
    "configured": {"recency": 0.35, "novelty": 0.30, "quality_hint": 0.25, "completeness": 0.10, "institution_prestige": 0.15, "author_prestige": 0.10},
    "builtin": {"recency": 0.28, "novelty": 0.22, "quality_hint": 0.18, "completeness": 0.07, "institution_prestige": 0.15, "author_prestige": 0.10},
}


def weighted(weights: dict[str, float]) -> str:
    return clamped(" + ".join(f"{w}e0 * {c}" for c, w in weights.items()))
