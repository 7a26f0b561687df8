"""Text expressions: slugs, tokens, sentences, truncation."""

from __future__ import annotations

from ..rules.tables import STOP_WORDS
from .dialect import Spark

#: Tokens of the recommender: a letter, then at least two letters, digits, + or -.
TOKEN = r"[a-zA-Z][a-zA-Z0-9+-]{2,}"


def author_slug(d: Spark, x: str) -> str:
    return d.replace(f"lower(trim({x}))", r"[^\p{L}\p{N}_]", "_")


def org_slug(d: Spark, x: str) -> str:
    return f"trim(both '_' from {author_slug(d, x)})" if d.name == "spark" else f"trim({author_slug(d, x)}, '_')"


def topic_slug(d: Spark, x: str) -> str:
    runs = d.replace(f"lower({x})", r"[^\p{L}\p{N}_]+", "_")
    return f"trim(both '_' from {runs})" if d.name == "spark" else f"trim({runs}, '_')"


def venue_id(d: Spark, x: str) -> str:
    runs = d.replace(f"lower({x})", r"[^a-z0-9]+", "-")
    return f"trim(both '-' from {runs})" if d.name == "spark" else f"trim({runs}, '-')"


def tokens(d: Spark, x: str) -> str:
    stop = ", ".join(map(d.text, STOP_WORDS))
    return d.tokens(x) or d.filter(d.all(f"lower({x})", TOKEN, exact=True), f"{d.chars('x')} <= 32 AND x NOT IN ({stop})")


def first_sentences(d: Spark, x: str, n: int) -> str:
    return d.join(d.slice(d.sentences(x), n), " ")


def truncate(d: Spark, x: str, n: int) -> str:
    """Cut at ``n`` characters, back to the last space, with an ellipsis."""
    head = f"left({x}, {n})"
    shorter = d.replace(head, r" [^ ]*$", "")
    return f"CASE WHEN {d.chars(x)} <= {n} THEN {x} ELSE concat({shorter}, '…') END"


def capitalised(d: Spark, x: str) -> str:
    return f"concat(upper(left({x}, 1)), lower(substr({x}, 2)))"


def words(d: Spark, x: str, most: int) -> str:
    """Number of words, of which no more than ``most`` need be told; none in a blank text."""
    return f"CASE WHEN trim({x}) = '' THEN 0 ELSE {d.size(d.split(f'trim({x})', r'\s+', most))} END"


def norm_title(d: Spark, x: str) -> str:
    """Lower case, marks to spaces, runs of spaces to one.  Compatibility forms are folded beforehand where they occur."""
    plain = d.replace(f"lower({x})", r"[^\p{L}\p{M}\p{N}_\s]", " ")
    return f"trim({d.replace(plain, r'\s+', ' ')})"


def arxiv_id(d: Spark, ident: str, url: str) -> str:
    """The bare number, without version, from the id or else the url; null without one."""
    number = r"([0-9]{4}\.[0-9]{4,5})"

    def part(x: str, prefix: str) -> str:
        if d.name == "spark":
            return f"regexp_extract({x}, {d.text(prefix + number)}, 1)"
        return f"regexp_extract({x}, {d.text(prefix + number)}, 1)"

    return f"coalesce(nullif({part(ident, '^arxiv:')}, ''), nullif({part(url, 'arxiv.org/(?:abs|pdf)/')}, ''))"
