"""Archives: identifiers, where bundles lie, and odd tables."""

import hashlib
from collections import Counter

import pytest

from tallyforge.llm import store, warc


def test_every_record_has_an_identifier_of_its_own(spark):
    big = "é" * 700
    rows = [(1, big), (1, big), (2, big), (3, big), (3, big), (5, "x" * 2000), (6, "x" * 2000), (7, "s"), (7, "s"), (7, "s"), (8, "s"), (None, big), (None, None), (None, None)]
    pages = spark.createDataFrame([(i, "u", h, "d", "k") for i, h in rows], "page_id long, url string, html string, digest string, kind string")
    path = store.new_path(spark, "archive")
    index = warc.write_bundles(pages, path)
    ids = [r["record_id"] for r in index.collect()]
    assert len(ids) == len(set(ids)) == len(rows)
    read = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(index, path).collect())
    assert read == Counter({(3, "response", None): 2, (1, "revisit", 3): 2, (2, "revisit", 3): 1, (None, "revisit", 3): 1, (5, "revisit", 6): 1, (6, "response", None): 1, (7, "response", None): 3, (8, "response", None): 1, (None, "response", None): 2})
    # a revisit's reference is an identifier in the index
    five = index.where("page_id = 6").first()
    assert five["record_id"] == warc.record_id(6, hashlib.sha1(b"x" * 2000).hexdigest())
    assert warc.fetch(index.where(index.record_id == five["record_id"]), path).first()["payload_bytes"] == 2000


def test_bundles_lie_where_spark_looks_for_them(spark):
    path = store.new_path(spark, "archive")
    uri = store.qualified(spark, path)
    assert uri.startswith("file:/") and uri.endswith(path)
    assert warc._open(uri)[1] == path
    with pytest.raises(Exception, match="nosuchscheme|Unrecognized"):
        warc._open("nosuchscheme://host/path")


def test_a_shared_folder_is_needed_on_a_cluster(spark):
    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        store.shared_dir(Elsewhere)
    table = store.written(spark.range(3), "numbers")
    store.discard(table, None)
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        spark.read.parquet(table.stored_at).count()
