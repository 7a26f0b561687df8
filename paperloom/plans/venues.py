"""Deadlines and the venue recommender as SQL text for either dialect."""

from __future__ import annotations

from ..functions import scoring as S
from ..functions import text as T
from ..functions.dialect import Spark
from ..rules import tables as R
from ..sources.corpus import VENUES
from .corpus import AS_OF, QUERIES, chain, query
from .corpus import _tokens as tokens
from .corpus import tfidf_profile

AREAS = list(R.VENUE_HINTS)


def deadlines(d: Spark) -> str:
    """Two editions of a venue for each nation, some dates missing; a pure function of the key."""
    shift = "(n_nationkey * 17 + ed * 61) % 240 - 90"
    area = d.pick(d.texts(AREAS), f"n_nationkey % {len(AREAS)} + 1")
    return f"""WITH editions AS (SELECT n_nationkey, n_name, {d.explode(d.array('0', '1'))} AS ed FROM {d.table('nation')}),
    dated AS (SELECT concat(n_name, ' ', CAST(2026 + ed AS string)) AS name, n_name AS short, ed, {area} AS area, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE {d.plus(AS_OF, shift)} END AS paper_deadline,
      CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE {d.plus(AS_OF, shift + ' - 7')} END AS abstract_deadline, CASE WHEN n_nationkey % 11 = 10 THEN NULL ELSE {d.plus(AS_OF, shift + ' + 90')} END AS conf_start, {d.plus(AS_OF, shift + ' + 94')} AS conf_end FROM editions),
    counted AS (SELECT *, CAST({d.days('paper_deadline', AS_OF)} AS bigint) + 1 AS paper_days, CAST({d.days('abstract_deadline', AS_OF)} AS bigint) + 1 AS abstract_days FROM dated),
    enriched AS (SELECT *, CASE WHEN abstract_days >= 0 THEN 'Abstract Deadline' ELSE 'Paper Deadline' END AS primary_label, CASE WHEN abstract_days >= 0 THEN abstract_days ELSE paper_days END AS primary_days FROM counted)"""


COUNTDOWN = "CASE WHEN primary_days IS NULL THEN '-' WHEN primary_days < 0 THEN concat(CAST(-primary_days AS string), 'd ago') WHEN primary_days = 0 THEN 'Today!' WHEN primary_days = 1 THEN '1 day' ELSE concat(CAST(primary_days AS string), ' days') END"
URGENCY = "CASE WHEN primary_days IS NULL OR primary_days < 0 THEN 'passed' WHEN primary_days <= 7 THEN 'urgent' WHEN primary_days <= 30 THEN 'soon' ELSE 'upcoming' END"
NEXT = f"""CASE WHEN paper_deadline >= {AS_OF} THEN 1 WHEN conf_start >= {AS_OF} THEN 2 ELSE 3 END"""

QUERIES["deadline_enrich"] = lambda d: f"{deadlines(d)}\nSELECT name, area, primary_label, primary_days, {COUNTDOWN} AS countdown, {URGENCY} AS urgency FROM enriched"
QUERIES["deadline_sort"] = lambda d: f"""{deadlines(d)}
    SELECT name, CAST(row_number() OVER (ORDER BY CASE WHEN primary_days >= 0 THEN 0 ELSE 1 END, abs(coalesce(primary_days, -100000)), name) AS int) AS place FROM enriched WHERE area <> 'HCI'"""
QUERIES["deadline_filter"] = lambda d: f"{deadlines(d)}\nSELECT name, primary_days FROM enriched WHERE area = 'NLP' AND primary_days >= 0"


def _next(d: Spark) -> str:
    soon = f"CASE {NEXT} WHEN 1 THEN {d.days('paper_deadline', AS_OF)} WHEN 2 THEN {d.days('conf_start', AS_OF)} ELSE coalesce({d.days(AS_OF, 'conf_start')}, 100000) END"
    return f"{deadlines(d)}, next_event AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY short ORDER BY {NEXT}, {soon}, name) AS rn FROM enriched) t WHERE rn = 1)"


QUERIES["next_event"] = lambda d: f"{_next(d)}\nSELECT short, name, {NEXT} AS kind FROM next_event"
QUERIES["venue_status"] = lambda d: f"""{_next(d)}
    SELECT short, CASE WHEN conf_start <= {AS_OF} AND conf_end >= {AS_OF} THEN 'Active' WHEN paper_deadline >= {AS_OF} THEN 'Open' WHEN conf_start >= {AS_OF} THEN 'Upcoming' ELSE concat('done ', right(name, 4)) END AS status FROM next_event"""
QUERIES["recommender_deadline"] = lambda d: f"{deadlines(d)}\nSELECT name, CASE WHEN paper_days IS NULL THEN 'unknown' WHEN paper_days < 0 THEN 'passed' WHEN paper_days <= 30 THEN 'urgent' WHEN paper_days <= 75 THEN 'soon' ELSE 'ok' END AS cls FROM enriched"


def _hints(d: Spark, hints: dict[str, list[str]]) -> str:
    rows = [f"({d.text(f)}, {d.text(t)}, {i})" for i, (f, ts) in enumerate(hints.items()) for t in ts]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS v(field, hint, place))"


def _best(d: Spark, key: str, rows: str) -> str:
    """The field with most hits of a key, the first of the table on a tie; ML without any."""
    return f"SELECT {key}, field FROM (SELECT {key}, field, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, place) AS rn FROM (SELECT {key}, field, place, count(*) AS n FROM {rows} GROUP BY {key}, field, place) c) r WHERE rn = 1"


@query
def field_infer(d: Spark) -> str:
    met = f"(SELECT terms.pos, field, place FROM (SELECT DISTINCT pos, term FROM terms) terms JOIN {_hints(d, R.DRAFT_HINTS)} h ON term = hint) m"
    return f"{tokens(d)}, best AS ({_best(d, 'pos', met)})\nSELECT papers.pos, coalesce(field, 'ML') AS field FROM papers LEFT JOIN best ON papers.pos = best.pos"


@query
def venue_field(d: Spark) -> str:
    met = f"(SELECT venue, field, place FROM terms JOIN {_hints(d, R.VENUE_HINTS)} h ON term = hint) m"
    return f"{tokens(d)}, best AS ({_best(d, 'venue', met)})\nSELECT v.venue, coalesce(field, 'ML') AS field FROM (SELECT DISTINCT venue FROM papers) v LEFT JOIN best ON v.venue = best.venue"


def _recommended(d: Spark) -> str:
    """Every paper taken as a draft, scored against every venue's profile."""
    profile = tfidf_profile(d)
    profile = profile[: profile.rindex("SELECT venue, term")] .rstrip() + ", profile AS (SELECT venue, term, greatest(weight, 0.0001e0) AS weight FROM ranked WHERE rn <= 85)"
    fields = f"(SELECT terms.pos, field, place FROM (SELECT DISTINCT pos, term FROM terms) terms JOIN {_hints(d, R.DRAFT_HINTS)} h ON term = hint) m"
    areas = f"(SELECT venue, field, place FROM terms JOIN {_hints(d, R.VENUE_HINTS)} h ON term = hint) m"
    starred = ", ".join(sorted({d.text(v[0]) for v in VENUES if v[3] == "A*"}))
    return f"""{profile}, drafts AS ({_best(d, 'pos', fields)}), places AS ({_best(d, 'venue', areas)}),
    overlap AS (SELECT t.pos, p.venue, sum(12.0e0 * weight) AS s, count(*) AS k FROM (SELECT DISTINCT pos, term FROM terms) t JOIN profile p ON t.term = p.term GROUP BY t.pos, p.venue),
    fits AS (SELECT o.pos, o.venue, k, round(greatest(0.0e0, s + CASE WHEN coalesce(drafts.field, 'ML') = coalesce(places.field, 'ML') THEN 8 ELSE -4 END + CASE WHEN o.venue IN ({starred}) THEN 2 ELSE 0 END), 4) AS score FROM overlap o LEFT JOIN drafts ON o.pos = drafts.pos LEFT JOIN places ON o.venue = places.venue),
    placed AS (SELECT pos, venue, k, score, CAST(row_number() OVER (PARTITION BY pos ORDER BY score DESC, venue) AS int) AS rn FROM fits)"""


QUERIES["recommend_venues"] = lambda d: f"{_recommended(d)}\nSELECT pos, rn, venue, k, score, CASE WHEN score >= 24 THEN 'Strong fit' WHEN score >= 14 THEN 'Moderate fit' ELSE 'Stretch fit' END AS fit FROM placed WHERE rn <= 8"

# --- pages ---


@query
def html_parse(d: Spark) -> str:
    def inner(pattern: str) -> str:
        return f"regexp_extract(html, {d.text(pattern)}, 1)"

    return f"SELECT page_id, trim({inner('<title>([^<]*)</title>')}) AS title, {inner('<html lang=\"([a-z]+)\"')} AS lang, {d.size(d.all('html', '<a href=', exact=True))} AS n_links FROM {d.table('pages')}"


@query
def similar_papers(d: Spark) -> str:
    """For every paper as a draft: the five accepted papers of its own venue that share most of their 32 main terms and, twice, their tags."""
    accepted = "SELECT pos AS a_pos, venue, tags AS a_tags FROM (SELECT pos, venue, tags, row_number() OVER (PARTITION BY venue ORDER BY paper_score DESC, year DESC, pos) AS rn FROM scored) r WHERE rn <= 18"
    main = "main AS (SELECT a_pos, a.venue, term FROM (SELECT pos, term, row_number() OVER (PARTITION BY pos ORDER BY n DESC, term) AS rn FROM counted) m JOIN accepted a ON m.pos = a.a_pos WHERE rn <= 32)"
    tagged = f"tagged_words AS (SELECT a_pos, venue, lower(tag) AS tag FROM (SELECT a_pos, venue, {d.explode('a_tags')} AS tag FROM accepted) e)"
    counted = "counted AS (SELECT t.pos, t.term, count(*) AS n FROM terms t JOIN accepted a ON t.pos = a.a_pos GROUP BY t.pos, t.term)"
    hits = "hits AS (SELECT w.pos, m.a_pos, count(*) AS k FROM words w JOIN main m ON w.term = m.term AND w.venue = m.venue WHERE w.pos <> m.a_pos GROUP BY w.pos, m.a_pos)"
    if d.name == "spark":
        # Only words of accepted papers are counted, and of those of all papers only the ones that a main term or a tag of their venue meets are dealt out.
        told = T.tokens(d, S.TEXT)
        every = f"(SELECT pos, venue, explode(array_distinct(ws)) AS term FROM (SELECT pos, venue, {told} AS ws FROM papers) s)"
        met = "(SELECT venue, term FROM main UNION SELECT venue, tag FROM tagged_words)"
        steps = f"""{chain(d, 'scored')}, accepted AS ({accepted}), terms AS (SELECT pos, explode(ws) AS term FROM (SELECT papers.pos, {told} AS ws FROM papers LEFT SEMI JOIN accepted ON papers.pos = accepted.a_pos) s),
    {counted},
    {main},
    {tagged},
    words AS (SELECT /*+ BROADCAST(m) */ DISTINCT t.pos, t.venue, t.term FROM {every} t JOIN {met} m ON t.venue = m.venue AND t.term = m.term),
    {hits},"""
    else:
        steps = f"""{chain_with_tokens(d)}, accepted AS ({accepted}),
    {counted},
    {main},
    words AS (SELECT DISTINCT pos, venue, term FROM terms), {hits},
    {tagged},"""
    return f"""{steps}
    tag_hits AS (SELECT w.pos, t.a_pos, count(*) AS k FROM words w JOIN tagged_words t ON w.term = t.tag AND w.venue = t.venue WHERE w.pos <> t.a_pos GROUP BY w.pos, t.a_pos),
    sims AS (SELECT hits.pos, hits.a_pos, hits.k + 2 * coalesce(tag_hits.k, 0) AS sim FROM hits LEFT JOIN tag_hits ON hits.pos = tag_hits.pos AND hits.a_pos = tag_hits.a_pos)
    SELECT pos, rn, a_pos, sim FROM (SELECT pos, a_pos, sim, CAST(row_number() OVER (PARTITION BY pos ORDER BY sim DESC, a_pos) AS int) AS rn FROM sims) s WHERE rn <= 5"""


def chain_with_tokens(d: Spark) -> str:
    return f"{chain(d, 'scored')}, tokens AS (SELECT pos, venue, {T.tokens(d, S.TEXT)} AS ws FROM papers), terms AS (SELECT pos, venue, {d.explode('ws')} AS term FROM tokens)"


@query
def graph_inputs(d: Spark) -> str:
    """The graph's papers: of the 30 strongest topics, within the filters, the 75 best; and how many more there are."""
    from .corpus import _topic_sums

    return f"""{chain(d, 'topics')}, strong AS (SELECT tag FROM ({_topic_sums(d)}) t ORDER BY trend_score DESC, n DESC, tag LIMIT 30),
    fitting AS (SELECT DISTINCT id, pos, title, paper_score FROM topics WHERE tag IN (SELECT tag FROM strong) AND (year = 0 OR year BETWEEN 2018 AND 2026) AND paper_score >= 2 AND read_first_score >= 1 AND lower(concat(title, ' ', abstract)) LIKE '%model%')
    SELECT id, paper_score, (SELECT count(*) FROM fitting) - 75 AS n_hidden FROM fitting ORDER BY paper_score DESC, title, pos LIMIT 75"""


def escaped(d: Spark, x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, {d.text(raw)}, {d.text(safe)})"
    return x


QUERIES["html_escape"] = lambda d: f"SELECT page_id, {d.md5(escaped(d, 'html'))} AS digest, {d.chars(escaped(d, 'html'))} AS n FROM {d.table('pages')}"
