"""Small tables with the awkward cases every operator must survive."""

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, words string, kept string"


def sample(n=60, start=0):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    return rows[start : start + n]


def awkward(spark, n=60):
    """Real texts, copies of them, nulls, blanks, ties, a very long text, and clashing extra columns."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in sample(n)]
    base = 1000
    rows += [
        (base, None, None, None, None),
        (base + 1, "", "en", "src0", 0),
        (base + 2, " \t\n\x0b\f\r ", None, "src1", 7),
        (base + 3, "one", "en", "src1", 3),
        (base + 4, "Two Words", "en", None, 9),
        (base + 5, rows[0][1], "fr", "src0", 1),
        (base + 6, rows[0][1] + " tail", "fr", "src0", 1),
        (base + 7, "ÉÀ école straße 日本語 😀 don't  I'll x y\x1c z", "fr", "src2", 1),
        (base + 8, "a" * 3000, "en", "src2", 3000),
        (base + 9, "ab cd " * 12000, "en", "src2", 72000),
        (base + 10, "12345 " * 30 + "\n\n" + "12345 " * 30, "en", "src2", 1),
        (base + 11, "<|endoftext|> special <|endoftext|>x", "en", "src3", 1),
        (base + 12, "%%% $$ ## !!! ...", None, "src3", 1),
    ]
    return spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)


def repeated(df):
    return df.union(df.limit(5))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
