from paperloom import pipeline


def test_outputs_of_a_small_corpus(spark):
    schema = "id string, title string, abstract string, authors array<string>, year int, venue string, conference_rank string, citations long, url string"
    rows = [(f"arxiv:2401.0000{i}v1", f"Paper number {i} on large language models", "We propose a novel method. A limitation is that the model cannot handle long inputs. Work at Google Research.", ["Ada Moreau", f"N {i}"], 2024 + i % 3, "arXiv" if i % 2 else "ICML", "" if i % 2 else "A*", i, f"http://x/{i}") for i in range(6)]
    new = spark.createDataFrame(rows[:4] + [("arxiv:2401.00001v2", "Paper number 1 on large language models", "Longer text now.", [], 2024, "ICML", "A*", 9, "http://x/1")], schema)
    old = spark.createDataFrame(rows[4:], schema)
    out = pipeline.run([new, old])
    assert set(out) == set(pipeline.OUTPUTS)
    index = out["search_index"].collect()
    assert 1 <= len(index) <= 6
    topics = {r["tag"]: r["n"] for r in out["topics"].collect()}
    assert topics["LLMs"] == len(index)
    assert {r["lab"] for r in out["labs"].collect()} == {"Google Research"}
    assert sum(r["n"] for r in out["stats"].collect() if r["dimension"] == "venue") == len(index)


def test_one_query_on_given_papers(spark):
    got = pipeline.on(spark.createDataFrame([("a", "A survey", "text")], "id string, title string, abstract string"), "paper_type").first()
    assert got["paper_type"] == "survey"
