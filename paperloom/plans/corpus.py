"""The corpus pipeline as a chain of named relations, and the queries on top of it.

Each query is SQL text for a dialect: Spark runs it over the Parquet tables, and
the same text in the other dialect is what it is held against.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import scoring as S
from ..functions import text as T
from ..functions.dialect import Spark
from ..functions.told import Told
from ..rules import tables as R
from ..sources.corpus import papers

AS_OF_YEAR = 2026
AS_OF = "DATE '2026-06-01'"


def chain(d: Spark, upto: str = "content") -> str:
    """WITH clauses of the relations up to the named one."""
    steps: list[tuple[str, str]] = [("papers", papers(d))]
    steps.append(("spoken", f"SELECT *, {d.telling() if isinstance(d, Told) else f'{S.folded(d, S.TEXT)} AS txt'} FROM papers"))
    steps.append(("matched", f"SELECT *, {S.matched_tags(d)} AS hit_tags FROM spoken"))
    for i, (tag, gone) in enumerate(R.SUPERSEDED):
        before = "matched" if i == 0 else f"super{i - 1}"
        source = "hit_tags" if i == 0 else "kept_tags"
        kept = f"CASE WHEN {d.has(source, d.text(tag))} THEN {d.filter(source, f'x NOT IN ({", ".join(map(d.text, gone))})')} ELSE {source} END"
        cols = "*" if i == 0 else ("* EXCEPT (kept_tags)" if d.name == "spark" else "* EXCLUDE (kept_tags)")
        steps.append((f"super{i}", f"SELECT {cols}, {kept} AS kept_tags FROM {before}"))
    steps.append(("labelled", f"SELECT *, {d.slice(d.concat('kept_tags', S.custom_tags(d)), 5)} AS tags, {S.cascade(d, 'txt', R.PAPER_TYPES, d.text(R.DEFAULT_TYPE))} AS paper_type FROM super{len(R.SUPERSEDED) - 1}"))
    # Filters on tags would be pushed below the rules and each use of a tag replaced by all of them; they don't pass a generator.
    steps.append(("tagged", "SELECT inline_outer(array(struct(*))) FROM labelled" if d.name == "spark" else "SELECT * FROM labelled"))
    steps.append(("levelled", f"SELECT *, {S.level(d)} AS difficulty_level FROM tagged"))
    steps.append(("measured", f"""SELECT *, {S.recency(AS_OF_YEAR)} AS recency, {S.novelty(d)} AS novelty, {S.quality_hint()} AS quality_hint, {S.completeness(d)} AS completeness,
      {S.institution(d)} AS institution_prestige, {S.clarity(d)} AS clarity, {S.capped(d, R.FOUNDATIONAL, 3.0)} AS foundational, {S.accessibility()} AS accessibility, {S.hot(d)} AS topic_centrality,
      {S.capped(d, R.SURPRISE, 3.0)} AS surprise, {S.capped(d, R.PRACTICAL, 1.5)} AS practical_value, {S.capped(d, R.EXPLAIN, 2.0)} AS explainability, {S.capped(d, R.BROAD, 1.5)} AS broad_relevance FROM levelled"""))
    steps.append(("prestiged", f"SELECT *, {S.author(d)} AS author_prestige FROM measured"))
    steps.append(("scored", f"""SELECT *, {S.weighted(S.WEIGHTS['configured'])} AS paper_score,
      {S.clamped('0.3e0 * clarity + 0.25e0 * foundational + 0.25e0 * accessibility + 0.2e0 * topic_centrality')} AS read_first_score,
      {S.clamped('0.25e0 * surprise + 0.25e0 * practical_value + 0.2e0 * explainability + 0.2e0 * broad_relevance + 0.1e0 * topic_centrality')} AS content_score FROM prestiged"""))
    steps.append(("topics", f"SELECT *, {d.explode('tags')} AS tag FROM scored"))
    steps.append(("content", f"SELECT *, {d.sentences('abstract')} AS sentences FROM scored"))
    if d.scored and upto in ("scored", "topics", "content"):
        # The rules have run: papers and all that follows are read from what they left.
        steps = [("scored", f"SELECT * FROM {d.scored}"), ("papers", "SELECT * FROM scored"), *steps[-2:]]
    names = [n for n, _ in steps]
    stop = max(names.index(upto), names.index("papers")) + 1
    if upto == "content":
        steps = [s for s in steps if s[0] != "topics"]
        stop = len(steps)
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in steps[:stop])


Query = Callable[[Spark], str]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def simple(name: str, upto: str, columns: Callable[[Spark], str], tail: str = "") -> None:
    QUERIES[name] = lambda d: f"{chain(d, upto)}\nSELECT {columns(d)} FROM {upto} {tail}"


def _flat(d: Spark, arr: str) -> str:
    return d.join(arr, "|")


simple("papers_view", "papers", lambda d: f"pos, id, title, abstract, {_flat(d, 'authors')} AS authors, {_flat(d, 'affiliations_raw')} AS affiliations, year, published_date, venue, source, source_type, conference_rank, pdf_url, citations, {_flat(d, 'tags0')} AS tags0")
simple("tag_assign", "tagged", lambda d: f"pos, {_flat(d, 'tags')} AS tags")
simple("tag_supersede", "tagged", lambda d: f"pos, {_flat(d, 'hit_tags')} AS before, {_flat(d, 'kept_tags')} AS after", "WHERE cardinality(hit_tags) <> cardinality(kept_tags)")
simple("paper_type", "tagged", lambda d: "pos, paper_type")
simple("difficulty", "levelled", lambda d: f"pos, difficulty_level, {S.level_reason(d)} AS difficulty_reason")
simple("paper_score", "scored", lambda d: f"pos, round(recency, 6) AS recency, round(novelty, 6) AS novelty, round(quality_hint, 6) AS quality_hint, round(completeness, 6) AS completeness, paper_score, {S.weighted(S.WEIGHTS['builtin'])} AS paper_score_builtin")
simple("read_first_score", "scored", lambda d: "pos, round(clarity, 6) AS clarity, foundational, accessibility, topic_centrality, read_first_score")
simple("content_potential", "scored", lambda d: "pos, surprise, practical_value, explainability, broad_relevance, content_score")
simple("interestingness", "scored", lambda d: "pos, round(CAST(round(50 * paper_score + 50 * content_score) AS bigint) / 100.0e0, 2) AS interestingness")
simple("author_prestige", "prestiged", lambda d: "pos, author_prestige", "WHERE author_prestige > 0")
simple("institution_prestige", "measured", lambda d: "pos, institution_prestige", "WHERE institution_prestige > 0")
simple("quality_hint", "measured", lambda d: "pos, conference_rank, citations, round(quality_hint, 6) AS quality_hint")


def _reason(parts: list[tuple[str, str]], otherwise: str, lead: str, score: str) -> Callable[[Spark], str]:
    def sql(d: Spark) -> str:
        items = d.filter(d.array(*[f"CASE {cond} END" for cond, _ in parts]), "x IS NOT NULL")
        text = d.join(items, ", ")
        return f"pos, CASE WHEN {d.size(items)} = 0 THEN {d.text(lead + otherwise)} ELSE concat({d.text(lead)}, {text}) END AS reason"

    return sql


simple("paper_reason", "scored", _reason([
    ("WHEN recency >= 7 THEN 'recently published' WHEN recency <= 2 THEN 'older work'", ""),
    ("WHEN novelty >= 7 THEN 'strong novelty signals' WHEN novelty <= 3 THEN 'limited novelty language'", ""),
    ("WHEN quality_hint >= 7 THEN 'high-quality venue / citation count'", ""),
    ("WHEN author_prestige >= 8 THEN 'renowned author' WHEN institution_prestige >= 8 THEN 'top-tier lab or university' WHEN institution_prestige >= 5 OR author_prestige >= 5 THEN 'reputable institution'", ""),
], "average on all dimensions", "Paper scores — ", "paper_score"))
simple("read_reason", "scored", _reason([
    ("WHEN clarity >= 7 THEN 'well-written abstract'", ""), ("WHEN foundational >= 6 THEN 'foundational concepts'", ""),
    ("WHEN accessibility >= 7 THEN 'accessible for most readers' WHEN accessibility <= 3 THEN 'requires significant background'", ""),
], "average readability and accessibility", "Read-first — ", "read_first_score"))

# --- generated texts ---


def contribution(d: Spark) -> str:
    told = d.filter("sentences", d.like(S.folded(d, "x"), R.CONTRIBUTION))
    return f"trim(coalesce({d.at(told, 1)}, {d.at('sentences', 1)}, ''))"


def caveat(d: Spark) -> str:
    return f"coalesce(nullif(trim({d.first('abstract', R.CAVEAT)}), ''), {d.text(R.NO_CAVEAT)})"


def first_tag(d: Spark) -> str:
    return d.at("tags", 1)


def why(d: Spark) -> str:
    named = d.at(d.filter("tags", f"x IN ({', '.join(map(d.text, R.WHY))})"), 1)
    return "concat(title, ' ', CASE " + named + " " + " ".join(f"WHEN {d.text(t)} THEN {d.text(w)}" for t, w in R.WHY.items()) + f" ELSE {d.text(R.WHY_DEFAULT)} END, '.')"


def hook(d: Spark) -> str:
    def told(text: str, value: str) -> str:
        before, found, after = text.partition("{}")
        return f"concat({d.text(before)}, {value}, {d.text(after)})" if found else d.text(text)

    named = " ".join(f"WHEN {d.text(t)} THEN {told(x, 'lower(title)')}" for t, x in R.HOOKS.items())
    first = f"coalesce({first_tag(d)}, '_default')"
    return f"CASE {first} {named} ELSE {told(R.HOOK_DEFAULT, first)} END"


def url() -> str:
    return "coalesce(nullif(paper_url, ''), pdf_url, '')"


def one_liner(d: Spark) -> str:
    return T.truncate(d, f"coalesce(nullif({contribution(d)}, ''), title)", 120)


NL = "chr(10)"
simple("content_summary", "content", lambda d: f"pos, {d.join(d.slice('sentences', 2), ' ')} AS summary, concat('In plain terms: ', {d.join(d.slice('sentences', 3), ' ')}) AS plain_english, {T.truncate(d, 'abstract', 500)} AS technical_summary")
simple("content_key_contribution", "content", lambda d: f"pos, {contribution(d)} AS key_contribution, {one_liner(d)} AS one_liner")
simple("content_why_hook", "content", lambda d: f"pos, {why(d)} AS why_it_matters, {hook(d)} AS hook")
simple("content_caveat", "content", lambda d: f"pos, {caveat(d)} AS biggest_caveat")
simple("content_read_this_if", "content", lambda d: f"pos, concat('Read this if you are ', CASE difficulty_level WHEN 'L1' THEN 'a beginner' WHEN 'L2' THEN 'familiar with ML' WHEN 'L3' THEN 'an advanced practitioner' WHEN 'L4' THEN 'a researcher at the frontier' ELSE 'interested in AI' END, ' and want to understand recent progress in ', coalesce({first_tag(d)}, 'this area'), '.') AS read_this_if")
BLANK = "chr(10), chr(10)"
simple("content_reason", "scored", lambda d: f"""pos, concat('Content potential ', CAST(CAST({S.one_place('content_score')} AS decimal(4, 1)) AS string), '/10 — ', coalesce(nullif({d.join(d.filter(d.array("CASE WHEN surprise >= 6 THEN 'surprising or unexpected results' END", "CASE WHEN practical_value >= 6 THEN 'clear practical applications' END", "CASE WHEN topic_centrality >= 7 THEN 'hot topic right now' END"), "x IS NOT NULL"), ', ')}, ''), 'solid but not especially viral'), '.') AS reason""")
simple("content_tweet", "content", lambda d: f"pos, concat('🧵 1/ ', {hook(d)}, {BLANK}, '2/ Key finding: ', {one_liner(d)}, {BLANK}, '3/ Why it matters: ', {why(d)}, {BLANK}, '4/ Main caveat: ', {caveat(d)}, {BLANK}, '5/ Paper: ', title, {NL}, 'Authors: ', {d.join(d.slice('authors', 3), ', ')}, CASE WHEN {d.size('authors')} > 3 THEN ' et al.' ELSE '' END, {NL}, {url()}) AS tweet_thread")
simple("content_linkedin", "content", lambda d: f"pos, concat({hook(d)}, {BLANK}, {why(d)}, {BLANK}, 'Key contribution: ', {one_liner(d)}, {BLANK}, 'Read the paper: ', title, {NL}, {url()}, {BLANK}, {d.join(d.map(d.slice('tags', 4), "concat('#', replace(replace(x, ' ', ''), '/', ''))"), ' ')}) AS linkedin_post")
simple("content_newsletter", "content", lambda d: f"pos, concat('**', title, '** (', CASE WHEN coalesce(venue, '') <> '' THEN concat(venue, ', ') ELSE '' END, CAST(year AS string), ')', {BLANK}, {d.join(d.slice('sentences', 2), ' ')}, {BLANK}, '*Why it matters:* ', {why(d)}, {BLANK}, '[Read the paper →](', {url()}, ')') AS newsletter_blurb")
simple("content_video", "content", lambda d: f"""pos, concat('## Video Script Outline: ', title, {BLANK}, '**Hook (0–15s):** ', {hook(d)}, {BLANK}, '**Problem (15–45s):** What gap does this paper address?', {NL}, {caveat(d)}, {BLANK}, '**Solution (45–90s):** ', {contribution(d)}, {BLANK},
      '**Why it matters (90–120s):** ', {why(d)}, {BLANK}, '**Key result (120–150s):** ', {one_liner(d)}, {BLANK}, '**Caveats (150–180s):** ', {caveat(d)}, {BLANK}, '**Call to action (180–210s):** Read the full paper and try it yourself.', {NL}, 'Link: ', {url()}) AS video_script""")

# --- topics ---

RECENT = f"{AS_OF_YEAR} - year <= 2"


def _topic_sums(d: Spark) -> str:
    trending = ", ".join(map(d.text, R.TRENDING))
    return f"""SELECT tag, count(*) AS n, {d.count_if(RECENT)} AS n_recent, round(round(least(CASE WHEN tag IN ({trending}) THEN 10.0e0 ELSE 5.0e0 END * {d.count_if(RECENT)} / count(*) + 0.01e0 * count(*), 10.0e0), 6), 2) AS trend_score,
      min(pos) AS seen FROM topics GROUP BY tag"""


@query
def topic_trend(d: Spark) -> str:
    return f"{chain(d, 'topics')}\nSELECT tag, n, n_recent, trend_score FROM ({_topic_sums(d)}) t ORDER BY trend_score DESC, n DESC, tag"


def topic_keywords(d: Spark) -> str:
    return "CASE tag " + " ".join(f"WHEN {d.text(t)} THEN {d.text('|'.join(x))}" for t, x in R.TOPIC_KEYWORDS.items()) + " ELSE lower(tag) END"


@query
def topic_agg(d: Spark) -> str:
    levels = "CASE tag " + " ".join(f"WHEN {d.text(t)} THEN '{x}'" for t, x in R.TOPIC_LEVELS.items()) + " ELSE 'L2' END"
    needs = "CASE tag " + " ".join(f"WHEN {d.text(t)} THEN {d.text('|'.join(x))}" for t, x in R.PREREQUISITES.items()) + " ELSE '' END"
    return f"""{chain(d, 'topics')}
    SELECT tag, {T.topic_slug(d, 'tag')} AS topic_id, count(*) AS n, {levels} AS level, {needs} AS prerequisites, {topic_keywords(d)} AS keywords, {_flat(d, d.gather('id', '-paper_score', 'pos', where='place <= 10'))} AS first_ids
    FROM (SELECT tag, id, paper_score, pos, row_number() OVER (PARTITION BY tag ORDER BY paper_score DESC, pos, id) AS place FROM topics) placed GROUP BY tag"""


def _pack(levels: str, score: str) -> Query:
    return lambda d: f"""{chain(d, 'topics')}
    SELECT tag, rn, id, {score} AS score FROM (SELECT tag, id, {score}, CAST(row_number() OVER (PARTITION BY tag ORDER BY {score} DESC, paper_score DESC, pos) AS int) AS rn FROM topics WHERE difficulty_level IN ({levels})) p WHERE rn <= 5"""


QUERIES["topic_starter_pack"] = _pack("'L1', 'L2'", "read_first_score")
QUERIES["topic_frontier_pack"] = _pack("'L3', 'L4'", "paper_score")


@query
def topic_related(d: Spark) -> str:
    # The five tags with most papers other than the tag itself are among the first six of all.
    return f"""{chain(d, 'topics')}, sums AS (SELECT tag, count(*) AS n FROM topics GROUP BY tag),
    six AS (SELECT tag AS other, n FROM sums ORDER BY n DESC, tag LIMIT 6)
    SELECT sums.tag, {_flat(d, d.slice(d.gather('other', '-six.n', 'other'), 5))} AS related FROM sums CROSS JOIN six WHERE sums.tag <> six.other GROUP BY sums.tag"""


@query
def topic_gap_summary(d: Spark) -> str:
    """Papers of a tag with limitations and with future work, read from their sentences."""
    said = {n: d.size(d.filter("sentences", f"x LIKE {d.text(f'%{w}%')}")) for n, w in (("limitations", "limitation"), ("future_work", "uture work"))}
    lim, fut = (d.count_if(f"{x} > 0") for x in said.values())
    return f"""{chain(d, 'topics')}, split AS (SELECT tag, {d.sentences('abstract')} AS sentences FROM topics), counted AS (SELECT tag, CAST({lim} AS bigint) AS n_limitations, CAST({fut} AS bigint) AS n_future_work FROM split GROUP BY tag)
    SELECT tag, n_limitations, n_future_work, CASE WHEN n_limitations = 0 AND n_future_work = 0 THEN concat('No explicit gaps extracted yet for ', tag, '.')
      ELSE concat(CAST(n_limitations AS string), ' papers in ', tag, ' report explicit limitations; ', CAST(n_future_work AS string), ' describe future work directions.') END AS summary FROM counted"""


# --- gaps ---


def _ideas() -> dict[str, list[str]]:
    """Starter ideas by tag, short names included."""
    return R.STARTERS | {short: R.STARTERS[name] for short, name in R.STARTER_ALIASES.items()}


def starter(d: Spark, tags: str) -> str:
    ideas = _ideas()
    named = d.at(d.filter(tags, f"x IN ({', '.join(map(d.text, ideas))})"), 1)
    return "CASE " + named + " " + " ".join(f"WHEN {d.text(t)} THEN {d.text(x[0])}" for t, x in ideas.items()) + f" ELSE {d.text(R.STARTER_DEFAULT)} END"


def _explicit(d: Spark) -> str:
    last = "max_by" if d.name == "spark" else "arg_max"
    order = "struct(-paper_score, pos)" if d.name == "spark" else "(-paper_score, pos)"
    bare = d.replace("descr", r"[.!?]+$", "")
    title = f"""CASE WHEN {d.chars(bare)} <= 60 THEN {T.capitalised(d, bare)} """
    for sep in (";", ",", "—", "–", " but ", " and "):
        title += f"WHEN instr(left({bare}, 80), {d.text(sep)}) > 0 THEN {T.capitalised(d, f'trim(left({bare}, CAST(instr(left({bare}, 80), {d.text(sep)}) - 1 AS int)))')} "
    title += "ELSE concat('Open challenge in ', topic) END"
    return f"""SELECT 'explicit' AS gap_type, topic, {title} AS title, descr AS description, n AS frequency, 0.8e0 AS confidence, idea FROM (
      SELECT topic, count(*) AS n, {d.least_by('descr', order)} AS descr, {last}(idea, {order}) AS idea FROM (
        SELECT coalesce({first_tag(d)}, 'General AI') AS topic, trim({d.first('abstract', R.EXPLICIT_GAP)}) AS descr, {starter(d, 'tags')} AS idea, paper_score, pos FROM scored WHERE {d.like('abstract', R.EXPLICIT_GAP)}
      ) m GROUP BY topic HAVING count(*) >= 3) g"""


def _pattern(d: Spark) -> str:
    labels = d.filter(d.array(*[f"CASE WHEN {d.like('txt', p)} THEN {d.text(n)} END" for n, p in R.PATTERN_GAPS]), "x IS NOT NULL")
    least = f"coalesce(min({d.at(d.sort('tags'), 1)}), 'General AI')"
    return f"""SELECT 'pattern' AS gap_type, topic, label AS title, concat('Pattern detected across ', CAST(n AS string), ' papers: ', label, ' is a recurring challenge in ', topic, ' research.') AS description, n AS frequency,
      round(least(0.4e0 + 0.05e0 * n, 0.9e0), 6) AS confidence, {starter(d, d.array('topic'))} AS idea FROM (SELECT label, count(*) AS n, {least} AS topic FROM (SELECT {d.explode(labels)} AS label, tags FROM scored) m GROUP BY label HAVING count(*) >= 2) g"""


def _starter(d: Spark) -> str:
    ideas = "CASE tag " + " ".join(f"WHEN {d.text(t)} THEN {d.texts(x[:2])}" for t, x in _ideas().items()) + " END"
    return f"""SELECT 'starter' AS gap_type, tag AS topic, concat('Starter idea: ', idea) AS title, concat('Beginner-friendly research direction in ', tag, '. Based on ', CAST(n AS string), ' tracked papers in this area. Idea: ', idea) AS description, n AS frequency, 0.7e0 AS confidence, idea
      FROM (SELECT tag, n, {d.explode(ideas)} AS idea FROM (SELECT tag, count(*) AS n FROM topics WHERE tag IN ({', '.join(map(d.text, _ideas()))}) GROUP BY tag) t) s"""


QUERIES["gap_explicit"] = lambda d: f"{chain(d, 'topics')}\n{_explicit(d)}"
QUERIES["gap_pattern"] = lambda d: f"{chain(d, 'topics')}\n{_pattern(d)}"
QUERIES["gap_starter"] = lambda d: f"{chain(d, 'topics')}\n{_starter(d)}"


def _gaps(d: Spark) -> str:
    digest = "sha2(concat_ws('|', gap_type, topic, title), 256)" if d.name == "spark" else "sha256(concat_ws('|', gap_type, topic, title))"
    return f"""{chain(d, 'topics')}, gaps AS (SELECT *, 1 AS layer FROM ({_explicit(d)}) a UNION ALL SELECT *, 2 FROM ({_pattern(d)}) b UNION ALL SELECT *, 3 FROM ({_starter(d)}) c),
    best AS (SELECT {digest} AS gap_id, gap_type, topic, title, frequency, confidence, idea, row_number() OVER (PARTITION BY topic, gap_type, left(title, 40) ORDER BY frequency DESC, layer, title) AS rn FROM gaps)"""


QUERIES["gap_union_dedup"] = lambda d: f"{_gaps(d)}\nSELECT gap_id, gap_type, topic, title, frequency, confidence, idea FROM best WHERE rn = 1"
QUERIES["gap_browse"] = lambda d: f"{_gaps(d)}\nSELECT topic, title, frequency, CASE WHEN confidence >= 0.8 THEN 'High' WHEN confidence >= 0.6 THEN 'Medium' ELSE 'Low' END AS bucket FROM best WHERE rn = 1 AND gap_type = 'starter' ORDER BY frequency DESC, topic, title LIMIT 20"

# --- authors, labs, universities ---


def _author_rows(d: Spark) -> str:
    return f"{chain(d, 'scored')}, byline AS (SELECT *, {d.explode('authors')} AS author FROM scored), named AS (SELECT *, {T.author_slug(d, 'author')} AS author_id FROM byline)"


@query
def author_agg(d: Spark) -> str:
    topics = d.slice(d.distinct("all_topics"), 10)
    flat = "flatten" if d.name == "spark" else "flatten"
    return f"""{_author_rows(d)}, grouped AS (SELECT author_id, {d.at(d.gather('author', '-paper_score', 'pos'), 1)} AS name, count(*) AS n_papers, CAST({d.count_if(RECENT)} AS bigint) AS n_recent, round(avg(paper_score), 6) AS avg_paper_score,
      {flat}({d.gather('tags', '-paper_score', 'pos')}) AS all_topics FROM named GROUP BY author_id)
    SELECT author_id, name, n_papers, n_recent, avg_paper_score, {_flat(d, topics)} AS topics, concat(name, ' has ', CAST(n_papers AS string), CASE WHEN n_papers = 1 THEN ' tracked paper.' ELSE ' tracked papers.' END) AS profile FROM grouped"""


@query
def author_momentum(d: Spark) -> str:
    prior = f"{d.count_if(f'{AS_OF_YEAR} - year > 2 AND {AS_OF_YEAR} - year <= 4')}"
    hot = f"sum({d.size(d.filter('tags', f'x IN ({", ".join(map(d.text, R.HOT_TAGS))})'))})"
    raw = "0.3e0 * least(1.5e0 * n_recent, 10.0e0) + 0.25e0 * mean + 0.2e0 * least(5.0e0 * n_recent / greatest(n_prior, 1), 10.0e0) + 0.15e0 * least(0.8e0 * n_hot, 10.0e0) + 0.1e0 * 10 * share"
    return f"""{_author_rows(d)}, sums AS (SELECT author_id, {d.count_if(RECENT)} AS n_recent, {prior} AS n_prior, avg(paper_score) AS mean, {hot} AS n_hot, {d.count_if("conference_rank IN ('A*', 'A')")} * 1.0e0 / count(*) AS share FROM named GROUP BY author_id)
    SELECT author_id, CAST(n_recent AS bigint) AS n_recent, CAST(n_prior AS bigint) AS n_prior, {S.clamped(raw)} AS momentum FROM sums"""


QUERIES["author_venue_counts"] = lambda d: f"{_author_rows(d)}\nSELECT author_id, venue, count(*) AS n FROM named GROUP BY author_id, venue"


def _org_rows(d: Spark, rules: list[tuple[str, str]]) -> str:
    inferred = d.filter(d.array(*[f"CASE WHEN {d.like('txt', p)} THEN {d.text(n)} END" for n, p in [*R.LABS, *R.UNIVERSITIES]]), "x IS NOT NULL")
    sites = f"CASE WHEN {d.size('affiliations_raw')} > 0 THEN affiliations_raw ELSE {inferred} END"
    return f"{chain(d, 'scored')}, sited AS (SELECT *, {d.explode(sites)} AS site FROM scored), housed AS (SELECT *, {S.cascade(d, 'site', rules, 'NULL')} AS org FROM sited), owned AS (SELECT * FROM housed WHERE org IS NOT NULL)"


@query
def lab_agg(d: Spark) -> str:
    return f"""{_org_rows(d, R.LABS)}
    SELECT org AS lab, {T.org_slug(d, 'org')} AS lab_id, count(DISTINCT id) AS n_papers, CAST({d.count_if("conference_rank = 'A*'")} AS bigint) AS a_star_output FROM owned GROUP BY org"""


@query
def lab_momentum(d: Spark) -> str:
    return f"""{_org_rows(d, R.LABS)}, once AS (SELECT DISTINCT org, pos, year, paper_score FROM owned), stars AS (SELECT org, {d.count_if("conference_rank = 'A*'")} AS s FROM owned GROUP BY org)
    SELECT once.org AS lab, round(round(least(0.5e0 * {d.count_if(RECENT)} + 3.0e0 * max(s) / count(*) + 0.2e0 * avg(paper_score), 10.0e0), 6), 2) AS momentum FROM once JOIN stars ON once.org = stars.org GROUP BY once.org"""


@query
def university_agg(d: Spark) -> str:
    return f"""{_org_rows(d, R.UNIVERSITIES)}, once AS (SELECT DISTINCT org, pos, venue FROM owned)
    SELECT org AS university, venue, count(*) AS n FROM once GROUP BY org, venue"""


@query
def university_momentum(d: Spark) -> str:
    return f"""{_org_rows(d, R.UNIVERSITIES)}, once AS (SELECT DISTINCT org, pos, year FROM owned)
    SELECT org AS university, count(*) AS n, round(10.0e0 * {d.count_if(RECENT)} / count(*), 6) AS momentum FROM once GROUP BY org"""


# --- rankings, exports, statistics ---

POOL = "coalesce(venue, '') IN ('arXiv', 'Unknown', '')"
simple("editorial_top5", "scored", lambda d: "id, title, paper_score", f"WHERE {POOL} ORDER BY paper_score DESC, pos LIMIT 5")
simple("editorial_underrated", "scored", lambda d: "id, title, paper_score, citations", f"WHERE {POOL} AND paper_score >= 5 AND citations <= 10 ORDER BY paper_score DESC, pos LIMIT 1")
QUERIES["editorial_breakout"] = lambda d: author_momentum(d).replace("SELECT author_id, CAST(n_recent", "SELECT author_id, CAST(n_recent", 1) + " ORDER BY momentum DESC, author_id LIMIT 1"
QUERIES["editorial_rising_lab"] = lambda d: lab_momentum(d) + " ORDER BY momentum DESC, lab LIMIT 1"
QUERIES["editorial_trend"] = lambda d: f"{chain(d, 'topics')}\nSELECT tag, trend_score FROM ({_topic_sums(d)}) t ORDER BY trend_score DESC, n DESC, tag LIMIT 1"
QUERIES["editorial_gap"] = lambda d: f"{_gaps(d)}\nSELECT gap_id, topic, title FROM best WHERE rn = 1 AND gap_type = 'explicit' AND confidence >= 0.7 ORDER BY frequency DESC, topic LIMIT 1"
_DIMENSIONS = ("venue", "source", "difficulty_level", "paper_type", "year")
QUERIES["stats_by_dimension"] = lambda d: f"""{chain(d, 'levelled')}, dealt AS (SELECT {', '.join(_DIMENSIONS)}, {d.explode(d.array(*map(d.text, _DIMENSIONS)))} AS dimension FROM levelled),
    keyed AS (SELECT dimension, CASE dimension {' '.join(f"WHEN '{x}' THEN CAST({x} AS string)" for x in _DIMENSIONS)} END AS key FROM dealt) SELECT dimension, key, count(*) AS n FROM keyed GROUP BY dimension, key"""
simple("search_index", "scored", lambda d: f"id, title, left(abstract, 300) AS abstract, {_flat(d, d.slice('authors', 5))} AS authors, {_flat(d, d.slice('tags', 5))} AS tags, {S.one_place('paper_score')} AS score, year, venue, difficulty_level")
simple("slim_export", "scored", lambda d: "id, title, year, venue, source, paper_url, citations, difficulty_level, paper_type, paper_score, read_first_score", "ORDER BY paper_score DESC, pos LIMIT 7500")
QUERIES["top_authors_export"] = lambda d: author_momentum(d) + " ORDER BY momentum DESC, author_id LIMIT 5000"
simple("top_papers", "scored", lambda d: "id, paper_score", "ORDER BY paper_score DESC, pos LIMIT 500")
simple("conference_papers", "scored", lambda d: "id, venue, paper_score", "WHERE source <> 'arxiv' ORDER BY paper_score DESC, pos LIMIT 5000")
QUERIES["browse_filter_page"] = lambda d: f"""{chain(d, 'scored')}, hits AS (SELECT id, title, paper_score, pos FROM scored WHERE (title ILIKE '%model%' OR abstract ILIKE '%model%') AND difficulty_level IN ('L2', 'L3')),
    n AS (SELECT count(*) AS n_all FROM hits), page AS (SELECT * FROM hits ORDER BY paper_score DESC, pos LIMIT 25 OFFSET 5) SELECT id, title, paper_score, n_all FROM page CROSS JOIN n"""
simple("browse_tag_synonyms", "scored", lambda d: "id, paper_score", "WHERE cardinality(tags) > 0")
QUERIES["browse_tag_synonyms"] = lambda d: f"{chain(d, 'scored')}\nSELECT id, paper_score FROM scored WHERE {d.overlap('tags', d.texts(['LLMs', 'Large Language Models']))}"
simple("quick_search", "scored", lambda d: "id, title, venue, year, paper_score", "WHERE title ILIKE '%diffusion%' OR abstract ILIKE '%diffusion%' ORDER BY paper_score DESC, pos LIMIT 5")
QUERIES["cross_entity_search"] = lambda d: f"""{_author_rows(d)}
    SELECT * FROM (SELECT 'author' AS kind, author_id AS key FROM named WHERE lower(author) LIKE '%li%' GROUP BY author_id ORDER BY author_id LIMIT 5) a
    UNION ALL SELECT * FROM (SELECT 'paper' AS kind, id AS key FROM scored WHERE lower(title) LIKE '%li%' ORDER BY paper_score DESC, pos LIMIT 5) p"""
QUERIES["potd"] = lambda d: f"""{chain(d, 'scored')}, pool AS (SELECT id, title, pos, paper_score FROM scored WHERE venue = 'arXiv' ORDER BY paper_score DESC, pos LIMIT 150),
    ranked AS (SELECT id, title, row_number() OVER (ORDER BY paper_score DESC, pos) AS rn, count(*) OVER () AS n FROM pool)
    SELECT id, title FROM ranked WHERE rn - 1 = (152 - 1) % n"""
simple("retention_window", "papers", lambda d: "id, published_date", "WHERE NOT (coalesce(venue, '') NOT IN ('', 'arXiv', 'Unknown')) AND coalesce(nullif(published_date, ''), '9999-01-01') >= '2025-12-03'")
simple("conference_predicate", "papers", lambda d: "venue, count(*) AS n", "WHERE coalesce(venue, '') NOT IN ('', 'arXiv', 'Unknown') GROUP BY venue")
simple("needs_affiliation", "papers", lambda d: "id", "WHERE source = 'arxiv' AND cardinality(affiliations_raw) = 0")
QUERIES["legacy_rank"] = lambda d: f"{chain(d, 'papers')}\nSELECT id, round(1.0e0 * citations + greatest(0, 365 - {d.days(AS_OF, d.date('published_date'))} / 30.0e0), 6) AS score FROM papers ORDER BY score DESC, pos LIMIT 100"
QUERIES["legacy_gaps"] = lambda d: f"{chain(d, 'tagged')}, words AS (SELECT {d.explode(d.map('tags', 'lower(x)'))} AS k FROM tagged)\nSELECT k, count(*) AS n FROM words GROUP BY k HAVING count(*) >= 2 ORDER BY n, k LIMIT 10"
QUERIES["conference_group_top5"] = lambda d: f"{chain(d, 'scored')}\nSELECT venue, rn, id FROM (SELECT venue, id, CAST(row_number() OVER (PARTITION BY venue ORDER BY paper_score DESC, pos) AS int) AS rn FROM scored WHERE source_type = 'conference') t WHERE rn <= 5"
QUERIES["digest_top3"] = lambda d: f"{chain(d, 'topics')}\nSELECT tag, rn, id FROM (SELECT tag, id, CAST(row_number() OVER (PARTITION BY tag ORDER BY paper_score DESC, pos) AS int) AS rn FROM topics WHERE tag IN ('LLMs', 'RAG', 'Diffusion', 'GNNs', 'RL', 'QA')) t WHERE rn <= 3"
QUERIES["last_k_per_venue"] = lambda d: f"{chain(d, 'papers')}\nSELECT venue, id FROM (SELECT venue, id, row_number() OVER (PARTITION BY venue ORDER BY pos DESC) AS rn FROM papers) t WHERE rn <= 5"
QUERIES["dominant_type"] = lambda d: f"{chain(d, 'tagged')}, c AS (SELECT venue, paper_type, count(*) AS n FROM tagged GROUP BY venue, paper_type)\nSELECT venue, paper_type FROM (SELECT venue, paper_type, row_number() OVER (PARTITION BY venue ORDER BY n DESC, paper_type) AS rn FROM c) t WHERE rn = 1"
QUERIES["topic_membership"] = lambda d: f"{chain(d, 'topics')}\nSELECT id, {_flat(d, d.gather(T.topic_slug(d, 'tag'), 'tag'))} AS topic_ids FROM topics GROUP BY id, pos"

# --- de-duplication ---

COMPLETENESS = "CASE WHEN abstract <> '' THEN 1 ELSE 0 END + CASE WHEN pdf_url <> '' THEN 1 ELSE 0 END + cardinality(authors) + cardinality(tags0) + CASE WHEN citations > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(venue, '') NOT IN ('', 'arXiv', 'Unknown') THEN 5 ELSE 0 END + CASE WHEN conference_rank <> '' THEN 3 ELSE 0 END"
simple("dedup_completeness", "papers", lambda d: f"pos, CAST({COMPLETENESS} AS bigint) AS completeness")
QUERIES["arxiv_id_extract"] = lambda d: f"{chain(d, 'papers')}\nSELECT pos, {T.arxiv_id(d, 'id', 'paper_url')} AS arxiv_id FROM papers"


def _title_pairs(d: Spark) -> str:
    """Blocked on word bigrams of the title: pairs whose word sets have a Jaccard similarity of 0.85 or more."""
    if d.name == "spark":
        bigrams = "CASE WHEN size(w) < 2 THEN array(concat(get(w, 0), ' ')) ELSE transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])) END"
        both, either = "size(array_intersect(a.ws, b.ws))", "size(array_union(a.ws, b.ws))"
    else:
        bigrams = "CASE WHEN len(w) < 2 THEN [w[1] || ' '] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END"
        both, either = "len(list_intersect(a.ws, b.ws))", "len(list_distinct(list_concat(a.ws, b.ws)))"
    distinct = "array_distinct(w)" if d.name == "spark" else "list_distinct(w)"
    return f"""{chain(d, 'papers')}, titled AS (SELECT pos, {d.split("trim(" + T.norm_title(d, "title") + ")", r"\s+")} AS w FROM papers WHERE {T.norm_title(d, 'title')} <> ''),
    bags AS (SELECT pos, {distinct} AS ws, {bigrams} AS bs FROM titled), grams AS (SELECT DISTINCT pos, {d.explode('bs')} AS g FROM bags),
    met AS (SELECT DISTINCT x.pos AS p, y.pos AS q FROM grams x JOIN grams y ON x.g = y.g AND x.pos < y.pos),
    pairs AS (SELECT p, q, {both} * 1.0e0 / {either} AS similarity FROM met JOIN bags a ON a.pos = p JOIN bags b ON b.pos = q WHERE {both} * 1.0e0 / {either} >= 0.85)"""


QUERIES["dedup_title_pairs"] = lambda d: f"{_title_pairs(d)}\nSELECT p, q, round(similarity, 6) AS similarity FROM pairs"
QUERIES["slugs"] = lambda d: f"{_author_rows(d)}\nSELECT DISTINCT author, author_id, {T.org_slug(d, 'author')} AS org_id, {T.topic_slug(d, 'author')} AS topic_id, {T.venue_id(d, 'author')} AS venue_id FROM named"

# --- terms and recommender ---


def _tokens(d: Spark) -> str:
    return f"{chain(d, 'papers')}, tokens AS (SELECT pos, venue, {T.tokens(d, S.TEXT)} AS ws FROM papers), terms AS (SELECT pos, venue, {d.explode('ws')} AS term FROM tokens)"


QUERIES["tokenise"] = lambda d: f"{_tokens(d)}\nSELECT pos, {d.size('ws')} AS n, {d.md5(d.join('ws', ' '))} AS digest FROM tokens"
QUERIES["term_counts"] = lambda d: f"{_tokens(d)}\nSELECT venue, term, count(*) AS n FROM terms GROUP BY venue, term"


def _bigrams(d: Spark) -> str:
    if d.name == "spark":
        return "CASE WHEN size(ws) < 2 THEN cast(array() as array<string>) ELSE transform(sequence(0, size(ws) - 2), i -> concat(ws[i], ' ', ws[i + 1])) END"
    return "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"


@query
def bigram_counts(d: Spark) -> str:
    return f"{_tokens(d)}, pairs AS (SELECT venue, {d.explode(_bigrams(d))} AS g FROM tokens WHERE {d.size('ws')} >= 2)\nSELECT venue, g, count(*) AS n FROM pairs WHERE split_part(g, ' ', 1) <> split_part(g, ' ', 2) GROUP BY venue, g"


@query
def tfidf_profile(d: Spark) -> str:
    """Words and word pairs of the 250 best papers of a venue: sublinear tf, smooth idf, unit length for each paper, summed by venue and scaled to the venue's largest weight.

    The vocabulary is the 4,000 terms of most occurrences, without those in more than 92 of 100 papers.
    """
    return f"""{chain(d, 'scored')}, documents_of AS (SELECT pos, venue FROM (SELECT pos, venue, row_number() OVER (PARTITION BY venue ORDER BY paper_score DESC, year DESC, pos) AS rn FROM scored) r WHERE rn <= 250),
    tokens AS (SELECT papers.pos, papers.venue, {T.tokens(d, S.TEXT)} AS ws FROM papers JOIN documents_of ON papers.pos = documents_of.pos), terms AS (SELECT pos, venue, {d.explode(d.concat('ws', _bigrams(d)))} AS term FROM tokens),
    tf AS (SELECT pos, venue, term, count(*) AS c, 1 + ln(count(*)) AS tf FROM terms GROUP BY pos, venue, term), n AS (SELECT count(*) AS n FROM documents_of),
    df AS (SELECT term, count(*) AS df, sum(c) AS c FROM tf GROUP BY term), vocabulary AS (SELECT term, df FROM df CROSS JOIN n WHERE df <= 0.92 * n ORDER BY c DESC, term LIMIT 4000),
    weighed AS (SELECT pos, venue, tf.term, tf * (ln((1 + n) * 1.0e0 / (1 + df)) + 1) AS w FROM tf JOIN vocabulary v ON tf.term = v.term CROSS JOIN n),
    norms AS (SELECT pos, sqrt(sum(w * w)) AS l FROM weighed GROUP BY pos), sums AS (SELECT venue, term, sum(w / l) AS w FROM weighed JOIN norms ON weighed.pos = norms.pos GROUP BY venue, term),
    tops AS (SELECT venue, max(w) AS m FROM sums GROUP BY venue),
    ranked AS (SELECT sums.venue, term, round(w / m, 4) AS weight, row_number() OVER (PARTITION BY sums.venue ORDER BY round(w / m, 6) DESC, term) AS rn FROM sums JOIN tops ON sums.venue = tops.venue)
    SELECT venue, term, greatest(weight, 0.0001e0) AS weight FROM ranked WHERE rn <= 85"""


QUERIES["accepted_papers"] = lambda d: f"{chain(d, 'scored')}\nSELECT venue, rn, id, left(abstract, 260) AS abstract, {_flat(d, d.slice('tags', 6))} AS tags FROM (SELECT *, CAST(row_number() OVER (PARTITION BY venue ORDER BY paper_score DESC, year DESC, pos) AS int) AS rn FROM scored) t WHERE rn <= 18"


@query
def draft_quality(d: Spark) -> str:
    uniq = "size(array_distinct(ws))" if d.name == "spark" else "len(list_distinct(ws))"
    return f"""{_tokens(d)} SELECT tokens.pos, CASE WHEN {d.chars(S.TEXT)} < 80 THEN 'too short' WHEN {d.size('ws')} < 35 THEN 'too few words' WHEN {uniq} < 18 THEN 'too repetitive' ELSE 'ok' END AS verdict FROM tokens JOIN papers ON tokens.pos = papers.pos"""


# --- tables beside the corpus: keyed upserts, paging, JSON, modes ---

QUERIES["upsert_latest"] = lambda d: f"SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {d.table('events')}) t WHERE rn = 1"
QUERIES["upsert_first"] = lambda d: f"SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {d.table('events')}) t WHERE rn = 1"
QUERIES["json_props"] = lambda d: f"SELECT event_type, CAST({d.json('props', 'k')} AS bigint) AS k, count(*) AS n FROM {d.table('events')} GROUP BY event_type, CAST({d.json('props', 'k')} AS bigint)"
QUERIES["mode_per_group"] = lambda d: f"SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {d.table('customer')} GROUP BY c_nationkey, c_mktsegment) c) t WHERE rn = 1"
QUERIES["semi_join"] = lambda d: f"SELECT c_custkey, c_name FROM {d.table('customer')} WHERE EXISTS (SELECT 1 FROM {d.table('orders')} WHERE o_custkey = c_custkey AND o_totalprice > 300000)"
QUERIES["anti_join"] = lambda d: f"SELECT c_custkey, c_name FROM {d.table('customer')} WHERE NOT EXISTS (SELECT 1 FROM {d.table('orders')} WHERE o_custkey = c_custkey)"
