"""Old records of six entities in, canonical rows out; what is broken is set apart."""

import json

import pytest

from paperloom.sources import records as R

OLD = {
    "paper": ({"id": "p1", "url": "u", "difficulty": "advanced", "authors": ["A", "B"], "year": 2020, "score_breakdown": {"a": 1.5}, "odd": 1}, {"paper_url": "u", "difficulty_level": "L3", "authors": ["A", "B"], "year": 2020, "source_type": "preprint", "score_breakdown": {"a": "1.5"}, "tags": []}),
    "author": ({"id": "a1", "top_topics": ["t"], "momentum_score": 2, "conference_counts": {"ACL": 3}, "paper_ids": "none"}, {"author_id": "a1", "topics": ["t"], "momentum_score": 2.0, "conference_counts": {"ACL": 3}, "paper_ids": []}),
    "lab": ({"id": "l1", "a_star_output": "4"}, {"lab_id": "l1", "a_star_output": 4, "authors": []}),
    "university": ({"university_id": "v", "conference_output": {"ICML": 1}}, {"university_id": "v", "conference_output": {"ICML": 1}}),
    "topic": ({"id": "t1", "keywords": ["k"]}, {"id": "t1", "keywords": ["k"], "difficulty": "intermediate"}),
    "gap": ({"id": "g1", "gap_id": "", "source_paper_ids": ["p1"]}, {"gap_id": "g1", "evidence_paper_ids": ["p1"], "confidence": 0.5, "frequency": 1, "gap_type": "explicit"}),
}


@pytest.mark.parametrize("entity", R.ENTITIES)
def test_old_records(spark, entity):
    old, new = OLD[entity]
    rows = R.decode(spark.createDataFrame([(json.dumps(old),)], "value string"), entity)
    record = R.records(rows).first().asDict()
    assert {k: record[k] for k in new} == new
    assert R.quarantine(rows).count() == 0
    back = R.with_old_names(R.records(rows), entity).first().asDict()
    for name in R.ENTITIES[entity].aliases.values():
        assert back[name] == old.get(name, "")
    # What was written by new names decodes to itself.
    again = R.records(R.decode(spark.createDataFrame([(json.dumps(record),)], "value string"), entity)).first().asDict()
    assert again == record


def test_new_names_win_and_faults_are_named(spark):
    texts = ['{"id": "a", "paper_url": "", "url": "u"}', '{"id": "b", "difficulty_level": null, "difficulty": "frontier"}', '{"id": "c", "year": "many"}', '{"id": ""}', "[1]", "{", None, " ", '{"id": "d", "title": null, "abstract": 5}', '{"id": {"x": 1}}']
    rows = R.decode(spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, value string, title int"), "paper").orderBy("id").collect()
    assert [r["fault"] for r in rows] == [None, None, "year: not bigint", "no id", "not an object", "not JSON", "not JSON", "not JSON", None, "id: not string"]
    assert [(r["record"]["paper_url"], r["record"]["difficulty_level"]) for r in rows[:2]] == [("", "L2"), ("", "L2")]
    assert (rows[8]["record"]["title"], rows[8]["record"]["abstract"], rows[8]["title"]) == ("", "5", 7)
    assert all((r["record"] is None) == (r["fault"] is not None) for r in rows)


def test_taken_names_and_empty_tables(spark):
    empty = spark.createDataFrame([], "value string")
    assert R.records(R.decode(empty, "gap")).count() == 0
    with pytest.raises(ValueError):
        R.decode(spark.createDataFrame([("{}", 1)], "value string, fault int"), "gap")
