"""The pipeline on odd and empty tables."""

import random
from collections import defaultdict

from tallyforge.llm import store

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, cls int, `component_id` long"


def tables(spark, rows, items):
    folder = store.new_path(spark, "tables")
    spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    draw = random.Random(5)
    words = {"en": "the of and water over house green stone from people under light".split(), "de": "der die und wasser über haus grün stein von leute unter licht".split()}
    text = lambda lang, n: " ".join(draw.choice(words[lang]) for _ in range(n))
    teach = [(i, text(lang := ("en", "de")[i % 2], 80), lang, "s", 1) for i in range(60)]
    item = "seven curious wizards boil purple jugs of water near the old harbour town at night"
    long = text("en", 30_000)
    repeated = text("de", 50)
    odd = [(None, text("en", 40), None, None, None), (1000, None, "en", "s", 0), (1001, "", "de", "s", 0), (1002, "!? 12", "en", "s", 5), (1003, long, "en", "s", 9), (1004, long, "en", "s", 9)]
    odd += [(1005, repeated, "de", "s", 1)] * 3 + [(1006, text("en", 30), "en", "s", 1), (1006, text("de", 30), "de", "s", 1), (1007, f"{text('en', 20)} {item} {text('en', 20)}", "en", "s", 1), (1008, f"{text('de', 30)} write to a.b@c.de", "de", "s", 1)]
    folder = tables(spark, teach + odd, [(1, item), (None, "x"), (2, None)])
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r["doc_id"]].append(r)
    kept = {i for i in pieces if i is not None and i >= 1000}
    assert kept == {1003, 1005, 1006, 1008} and len(pieces[None]) == 1 and len(pieces[1003]) > 10
    assert len(pieces[1005]) == 1 and len(pieces[1006]) == 2
    assert {i for i in pieces if i is not None and i < 1000} == set(range(60))


def test_pipeline_on_empty_tables(spark):
    import corpus_pipeline

    for rows in ([], [(1, None, None, None, None), (1, None, None, None, None)]):
        assert corpus_pipeline.run(spark, tables(spark, rows, [])).count() == 0
