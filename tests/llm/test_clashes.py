"""Stages that return documents: columns whose names clash with working ones, nulls, repeats, empty tables."""

import pytest

from weftline.llm import line_dedup, mixing, near_documents, passage_dedup, quality, simhash

NAMES = ["_row", "removed", "copies", "_copy", "fp", "component", "size", "_doc", "_key", "order", "lid", "n_words", "_text", "_cut", "first", "key"]
PROSE = " ".join(f"word{i} and then some" for i in range(20))
STAGES = [line_dedup.drop_repeated_lines, mixing.mix_documents, near_documents.drop_near_duplicates, simhash.drop_near_duplicates, passage_dedup.drop_repeated_passages, quality.keep_good]


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f"{f.__module__.rsplit('.', 1)[1]}.{f.__name__}")
def test_columns_that_clash(spark, stage):
    rows = [(1, f"{PROSE}\n{i}", "a") for i in range(3)] + [(None, None, None), (7, "", "b"), (1, f"{PROSE}\n0", "a"), (8, f"one {PROSE[::-1]}", None)]
    cols = ", ".join(f"`{n}` string" for n in NAMES)
    df = spark.createDataFrame([(*r, *(f"{i}{n}" for n in NAMES)) for i, r in enumerate(rows)], f"doc_id long, text string, source string, {cols}")
    out = stage(df)
    assert out.columns == df.columns
    got = out.collect()
    texts = {i: r[1] for i, r in enumerate(rows)}
    assert got
    for r in got:
        i = r["size"].removesuffix("size")
        assert [r[n] for n in NAMES] == [f"{i}{n}" for n in NAMES]
        assert r.doc_id == rows[int(i)][0] and r.source == rows[int(i)][2]
        if stage.__name__ not in ("drop_repeated_lines", "drop_repeated_passages"):
            assert r.text == texts[int(i)]
    assert stage(df.limit(0)).count() == 0
