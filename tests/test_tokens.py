"""Words cut out by columns against the pattern, word by word."""

import random
import re

import pyarrow as pa

from paperloom import queries as library
from paperloom.functions.text import TOKEN
from paperloom.functions.tokens import cut
from paperloom.rules.tables import STOP_WORDS

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    return None if text is None else [w for w in re.findall(TOKEN, text) if len(w) <= 32 and w not in STOP_WORDS]


def test_equals_the_pattern():
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab1-+ é漢\n") for _ in range(draw.randrange(30))) for _ in range(3000)]
    texts += ["", None, "a" * 32, "a" * 33, "1" * 40 + "abc", "---", "3d-vision", "the model new-x", "-a-", "ABC", "abc", None, "abc"]
    draw.shuffle(texts)
    assert cut(pa.array(texts)).to_pylist() == [plain(t) for t in texts]
    assert cut(pa.array(texts).slice(50, 70)).to_pylist() == [plain(t) for t in texts[50:120]]
    for few in ([], [None], ["", ""], ["abc"], ["ab", "c"]):
        assert cut(pa.array(few, pa.string())).to_pylist() == [plain(t) for t in few]


def test_words_are_not_searched_for_by_a_pattern(spark):
    """F5, F8: all words of all papers were found by a regular expression, twice in similar_papers."""
    for name in ("similar_papers", "tfidf_profile"):
        plan = library.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "paperloom_tokens" in plan, name


def test_words_of_a_draft_are_cut_out_once(spark):
    """the words of every draft were found five times for its verdict and again for each use of the draft."""
    plan = library.queries()["venue_fits"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "large language model" not in plan and "lorem" not in plan and plan.count("_tokens(") == 0
