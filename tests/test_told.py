"""What is told of a paper against patterns that are tried one by one, and queries against the rules' cost."""

import random
import re

import duckdb
import pyarrow as pa

from paperloom import queries as library
from paperloom.functions import scoring as S
from paperloom.functions import told as W
from paperloom.functions.dialect import DUCK
from paperloom.rules import tables as R

FOLDER = "/root/testdata/sf0.001"
PIECES = [
    "few\rshot", "few\nshot", "few shot", "reinforcement learning from human feedback", "a new, novel newnovel\nnew", "énew", "newé", "gpt-4", "gpté4", "GPT 3", "ner", "éner\n", "google\nresearch", "Meta AI", "eth  zurich", "mit", "mité",
    "We propose", "in this\npaper", "our method", "however this does\nnot stay short.", "It fails to\ngo on at all.", "open problem", "ppo\nalign", "ppo to align", "surprising", "a simple, simple rule", "", " ", "\n", "\r\n", "system", "infrastructure", "Σ", "漢字", "１", "K", "visualiz",
]


def one_by_one(rows):
    """The numbers of all patterns, each tried alone by the SQL that queries are held against."""
    def number(x, p):
        return DUCK.count(x, p) if p in W.COUNTED else f"CAST({DUCK.like(x, p)} AS int)"

    places = [(S.folded(DUCK, "t || ' ' || a"), p) for p in W.SPOKEN] + [(S.folded(DUCK, "a"), R.CLARITY)] + [(S.folded(DUCK, "coalesce(h, a)"), p) for p in W.HOUSED] + [("a", p) for p in W.OPEN]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE rows (i int, t varchar, a varchar, h varchar)")
    duck.executemany("INSERT INTO rows VALUES (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    return [list(r) for r in duck.execute(f"SELECT {', '.join(number(*x) for x in places)} FROM rows ORDER BY i").fetchall()]


def test_all_at_once_equals_one_by_one():
    draw = random.Random(7)
    said = [re.sub(r"\\b|[()?]", "", p.split("|")[0]).replace(".", "-") for _, p in [*R.TAGS, *R.PAPER_TYPES, *R.LABS, *R.UNIVERSITIES, *R.PATTERN_GAPS]]
    text = lambda n: draw.choice([" ", "\n", ". "]).join(draw.choice(PIECES + said) for _ in range(draw.randrange(n)))
    rows = [(text(4), text(30), draw.choice([None, text(3)])) for _ in range(150)] + [(None, "a new model", None), ("a survey", None, None), (None, None, "stanford"), ("", "", "")]
    got = W._told(*(pa.array(x, pa.string()) for x in zip(*rows, strict=True))).to_pylist()
    assert got == one_by_one(rows)


def test_pieces_of_a_batch_make_no_difference(monkeypatch):
    columns = [pa.array([f"a survey {i}" for i in range(40)]), pa.array([f"we propose {'new ' * i}\nsystem" for i in range(40)]), pa.nulls(40, pa.string())]
    whole = W._told(*columns).to_pylist()
    monkeypatch.setattr(W, "PIECE", 64)
    assert W._told(*columns).to_pylist() == whole
    assert len(W._told(*(x.slice(0, 0) for x in columns))) == 0


def test_rules_are_not_tried_one_by_one(spark):
    """F1 to F14: each pattern of the rules was a pass over the whole text, in some queries twice."""
    for name in ("paper_reason", "lab_momentum", "editorial_rising_lab", "topic_related"):
        plan = library.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "large language model" not in plan and "we propose" not in plan, name
        assert plan.count("paperloom_told(") <= (name == "paper_reason"), name
