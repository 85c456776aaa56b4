"""The line stage of the pipeline on one large cluster in many blocks."""

import random

import corpus_pipeline
from weftline.llm import line_dedup


def test_large_cluster_in_blocks(spark, monkeypatch):
    """Copies of a line with one word changed are one class; those with a third of the words changed stay, by themselves."""
    monkeypatch.setattr(line_dedup, "CLUSTER_BLOCK", 60)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(300):
        line = list(base)
        for at in rng.sample(range(60), 20 if i % 5 == 4 else 1):
            line[at] = word()
        rows.append((i, " ".join(line), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    left = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, "").collect()}
    assert left == {i: t if i == 0 or i % 5 == 4 else "" for i, t, *_ in rows}
