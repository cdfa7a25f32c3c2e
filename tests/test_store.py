"""The content-addressed store and whole runs: races, what moves, old versions, sinks after a failure, quarantine."""

import hashlib
import json
import os
import re
import threading

import pytest

from tallyforge.operators import corpus, facts, restore, store
from tallyforge.sources import corpus_tables as src

MANIFEST = "id string, origin string, path string, url string, sha256 string, source string"
FILES = "path string, content binary"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture
def frames(spark):
    files = lambda **rows: spark.createDataFrame([(p, bytearray(t.encode())) for p, t in rows.items()], FILES)
    asked = lambda **rows: spark.createDataFrame([(p, digest(t)) for p, t in rows.items()], "path string, sha256 string")
    return files, asked


def contents(spark, base, version=None):
    return {r["path"]: bytes(r["content"]).decode() for r in store.read_store(spark, base, version).collect()}


def test_versions_share_contents_and_old_ones_stay_readable(spark, tmp_path, frames):
    files, asked = frames
    base = str(tmp_path / "store")
    assert store.store_version(spark, base) == 0 and store.read_pointers(spark, base).count() == 0
    assert store.update_store(asked(a="1", b="2", c="1"), files(a="1", b="2", c="1"), base) == 1
    assert store.update_store(asked(a="2", d="new"), files(a="2", d="new", x="not asked"), base) == 2
    assert contents(spark, base) == {"a": "2", "b": "2", "c": "1", "d": "new"}
    assert contents(spark, base, 1) == {"a": "1", "b": "2", "c": "1"}
    history = {r["version"]: r.asDict() for r in store.store_history(spark, base).collect()}
    assert history[1] == {"version": 1, "n_paths": 3, "n_contents": 2, "n_new": 2, "bytes_new": 2}
    assert history[2] == {"version": 2, "n_paths": 4, "n_contents": 3, "n_new": 1, "bytes_new": 3}  # a's new content was stored for b
    assert store.update_store(asked(a="2", b="2"), files(a="2"), base) == 2, "nothing changes, so there is no new version"
    assert len(os.listdir(f"{base}/pointers")) == 2


def test_a_landed_copy_without_its_digest_publishes_nothing(spark, tmp_path, frames):
    files, asked = frames
    base = str(tmp_path / "store")
    store.update_store(asked(a="1"), files(a="1"), base)
    for landed in (files(a="other", b="2"), files(b="2")):
        with pytest.raises(ValueError, match="1 landed files do not have their digests"):
            store.update_store(asked(a="3", b="2"), landed, base)
    assert contents(spark, base) == {"a": "1"} and len(os.listdir(f"{base}/contents")) == 1


def test_repeated_and_null_rows(spark, tmp_path, frames):
    files, asked = frames
    base = str(tmp_path / "store")
    landed = files(a="1").union(files(a="1")).union(files(a="odd")).union(spark.createDataFrame([(None, bytearray(b"1")), ("n", None)], FILES))
    accepted = asked(a="1").union(asked(a="1")).union(spark.createDataFrame([(None, digest("1")), ("n", None)], "path string, sha256 string"))
    assert store.update_store(accepted, landed, base) == 1 and contents(spark, base) == {"a": "1"}


def test_of_two_interleaved_writers_one_wins(spark, tmp_path, frames):
    files, asked = frames
    base = str(tmp_path / "store")
    store.update_store(asked(a="1"), files(a="1"), base)
    one, two = store.stage(asked(a="2"), files(a="2"), base), store.stage(asked(b="3"), files(b="3"), base)
    assert one.version == two.version == 2
    assert store.publish(spark, two) == 2
    with pytest.raises(store.StoreConflict, match="version 2"):
        store.publish(spark, one)
    assert contents(spark, base) == {"a": "1", "b": "3"}
    assert not any(one.pointers in str(p) for p in tmp_path.rglob("*")), "the loser leaves nothing"
    assert store.update_store(asked(a="2"), files(a="2"), base) == 3 and contents(spark, base) == {"a": "2", "b": "3"}


@pytest.mark.parametrize("how", ["link", "rename", "create"])
def test_a_commit_file_is_put_once(spark, tmp_path, how):
    def put(i):
        path = f"{tmp_path}/commits/1.json"
        system, at = store.hadoop(spark, path)
        put_it = {"link": lambda: store.put_if_absent(spark, path, str(i)), "rename": lambda: store._renamed(spark, system, at, str(i)), "create": lambda: store._created(system, at, str(i))}[how]
        won[i] = put_it()

    won = {}
    if how == "link":  # at the same time; a local rename or creation is tested one after the other
        threads = [threading.Thread(target=put, args=(i,)) for i in range(16)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    else:
        [put(i) for i in range(3)]
    winners = [i for i, w in won.items() if w]
    assert len(winners) == 1 and (tmp_path / "commits/1.json").read_text() == str(winners[0])
    assert [p.name for p in (tmp_path / "commits").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_a_file_system_without_exclusive_creation_is_refused(spark, monkeypatch):
    class System:
        getUri = lambda self: self
        getScheme = lambda self: "s3a"

    monkeypatch.setattr(store, "hadoop", lambda spark, path: (System(), path))
    with pytest.raises(ValueError, match="s3a"):
        store.put_if_absent(spark, "s3a://b/x", "")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contents_move_only_where_accepted(spark, tmp_path, frames, monkeypatch, limit):
    """No plan shuffles stored contents; with few accepted paths no landed content is shuffled before it is known to be one of them."""
    files, asked = frames
    base = str(tmp_path / "store")
    monkeypatch.setattr(store, "BROADCAST_PATHS", limit)
    store.update_store(asked(a="1", b="2"), files(a="1", b="2"), base)
    landed = files(a="9", b="8", c="7")
    missing = spark.createDataFrame([(digest("9"), "a")], "sha256 string, path string")
    plan = store.fresh_contents(landed, missing, 1)._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"\b(BroadcastHashJoin|SortMergeJoin)\b", plan)
    assert set(joins) == ({"BroadcastHashJoin"} if limit else {"SortMergeJoin"}) and "version" not in plan and "batch=" not in plan
    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "store/contents").rglob("*.parquet"))
    assert store.update_store(asked(a="9"), landed, base) == 2 and contents(spark, base) == {"a": "9", "b": "2"}
    after = [(p.name, p.stat().st_mtime_ns) for p in (tmp_path / "store/contents").rglob("*.parquet")]
    assert set(before) < set(after) and sum(r["n_new"] for r in store.store_history(spark, base).where("version = 2").collect()) == 1


def manifest(spark, *rows):
    return spark.createDataFrame([(str(i), origin, path, "u", d, "s") for i, (origin, path, d) in enumerate(rows)], MANIFEST)


def test_a_run_writes_all_sinks_and_then_raises(spark, tmp_path, frames):
    files, asked = frames
    base, sinks = str(tmp_path / "store"), str(tmp_path / "sinks")
    store.update_store(asked(same="1", old="1", mine="1"), files(same="1", old="1", mine="1"), base)
    p = "public_original"
    rows = manifest(spark, (p, "same", digest("1")), (p, "old", digest("2")), (p, "new", digest("3")), (p, "lost", digest("4")), (p, "bad", digest("5")), (p, "../out", digest("3")), ("simulated", "mine", digest("9")))
    landed = files(old="2", new="3", bad="damaged", mine="9").union(files(bad="damaged again")).union(files(new="torn"))
    with pytest.raises(restore.RunFailed, match="3 documents failed") as failed:
        restore.restore(rows, landed, base, sinks)
    run = failed.value.run
    assert run.version == 2 and contents(spark, base) == {"same": "1", "old": "2", "new": "3", "mine": "1"}
    letters = {r["id"]: r["error"] for r in spark.read.parquet(f"{run.folder}/dead_letters").collect()}
    assert letters == {"3": "not_landed: lost", "4": "mismatch: bad", "5": "rejected_path: ../out"}
    assert {r["status"]: r["n"] for r in spark.read.parquet(f"{run.folder}/outcome").collect()} == {"current": 1, "replaced": 1, "new": 1, "not_landed": 1, "mismatch": 1, "rejected_path": 1}
    with pytest.raises(restore.RunFailed):
        restore.restore(rows, landed, base, sinks)
    assert store.store_version(spark, base) == 2, "a second run changes nothing"
    with pytest.raises(ValueError, match="outside the root"):
        restore.restore(rows, landed, base, str(tmp_path / "strict"), strict=True)
    assert not (tmp_path / "strict").exists()


def test_a_run_without_failures_returns(spark, tmp_path, frames):
    files, _ = frames
    run = restore.restore(manifest(spark, ("public_original", "a", digest("1"))), files(a="1"), str(tmp_path / "store"), str(tmp_path / "sinks"))
    assert (run.version, run.failures) == (1, 0) and spark.read.parquet(f"{run.folder}/dead_letters").count() == 0
    none = restore.restore(manifest(spark), spark.createDataFrame([], FILES), str(tmp_path / "none"), str(tmp_path / "sinks"))
    assert none.version == 1 and store.read_pointers(spark, str(tmp_path / "none")).count() == 0


WHOLE = {"description": "d", "pdf_sha256": "x", "url": "u", "upstream_reference": [{"document": "d.pdf", "name": "revenue", "value": "1.5", "unit": "元", "period": "2024", "page": 4}, {"document": "d.pdf", "name": "revenue", "value": "N/A", "unit": "元", "period": "2024-Q7", "page": 4}, None]}


def test_every_lost_file_and_fact_is_listed_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text = json.dumps(WHOLE)
    for name, body in {"whole": text, "cut": text[:-40], "none": json.dumps({"pdf_sha256": "y"}), "empty_list": json.dumps(WHOLE | {"pdf_sha256": "z", "upstream_reference": []}), "kind": json.dumps(WHOLE | {"upstream_reference": 7}), "blank": " \n"}.items():
        (folder / f"{name}.json").write_text(body)
    flat, broken = src.read_fact_files(spark, str(folder))
    got = {os.path.basename(r["file"]): (r["reason"], r["pdf_sha256"]) for r in broken.collect()}
    assert got == {"cut.json": ("unreadable", None), "none.json": ("no_facts", "y"), "empty_list.json": ("no_facts", "z"), "kind.json": ("unreadable", None), "blank.json": ("blank", None)} and broken.count() == 5
    assert flat.count() == 3 == src.fact_scan(spark, str(folder)).count()
    good, unread = facts.read_facts(flat)
    assert good.count() == 1 and sorted((r["document"], r["reason"]) for r in unread.na.fill("-").collect()) == [("-", "value,period"), ("d.pdf", "value,period")]
    assert {(r["id"], r["error"]) for r in facts.fact_letters(unread).collect()} == {("d.pdf/revenue/2024-Q7", "unreadable value N/A, period 2024-Q7"), ("null/null/null", "unreadable value null, period null")}
    with pytest.raises(restore.RunFailed, match="7 files and facts failed") as failed:
        restore.load_facts(spark, str(folder), str(tmp_path / "facts"), str(tmp_path / "sinks"))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 1 and spark.read.parquet(f"{failed.value.run.folder}/dead_letters").count() == 7
    assert {r["status"]: r["n"] for r in spark.read.parquet(f"{failed.value.run.folder}/outcome").collect()} == {"read": 1, "unreadable": 2, "no_facts": 2, "blank": 1, "unreadable value,period": 2}


def test_totals_against_a_plan(spark):
    rows = spark.createDataFrame([("a", "p")] * 40 + [("a", "s")] * 60 + [(None, "p")] * 2, "source string, origin string")
    groups = corpus.source_groups(rows)
    assert {(r["level"], r["source"], r["origin"]): r["n"] for r in groups.collect()} == {("all", None, None): 102, ("source", "a", None): 100, ("source", None, None): 2, ("origin", "a", "p"): 40, ("origin", "a", "s"): 60, ("origin", None, "p"): 2}
    plan = [("all", None, None, 100), ("source", "a", None, 100), ("source", None, None, 5), ("origin", "a", "p", 20), ("origin", "a", "p", 20), ("origin", "a", "s", 61), ("source", "gone", None, 1), ("source", "zero", None, 0), ("origin", None, "q", None)]
    got = {(r["level"], r["source"], r["origin"]): r["status"] for r in corpus.against_expected(groups, spark.createDataFrame(plan, "level string, source string, origin string, n long")).collect()}
    assert got == {("all", None, None): "over", ("source", "a", None): "met", ("source", None, None): "short", ("origin", "a", "p"): "met", ("origin", "a", "s"): "short", ("origin", None, "p"): "unexpected", ("source", "gone", None): "absent", ("source", "zero", None): "met", ("origin", None, "q"): "met"}
