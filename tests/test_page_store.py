import pathlib
import random

from hearthgraph.operators.chunking import chunk_pages
from hearthgraph.sources.files import parse_pages
from hearthgraph.sources.page_store import PageStore


def snapshot(spark, tree):
    return parse_pages(spark.createDataFrame(list(tree.items()), "path string, raw string"))


def files(store):
    return {str(f) for f in pathlib.Path(store.path).rglob("*.parquet")}


def index(store):
    return sorted((r["parent_id"], r["ord"], r["text"], r["tier"]) for r in store.chunks().collect())


def whole(spark, tree):
    pages = snapshot(spark, tree).filter("status <> 'deleted'").selectExpr("path as id", "title", "body as text", "tier")
    return sorted((r["parent_id"], r["ord"], r["text"], r["tier"]) for r in chunk_pages(pages).collect())


def counts(df):
    return tuple(df.first())


def test_the_index_follows_the_tree(spark, tmp_path):
    rnd = random.Random(4)
    long = " ".join(f"w{i}." for i in range(900))
    tree = {f"p/{i}.md": f"---\ntitle: T{i}\n---\n# H{i}\n" + (long if i % 5 == 0 else f"moss {i}") for i in range(20)}
    store = PageStore(spark, str(tmp_path / "store"), buckets=16).create()
    assert counts(store.sync(snapshot(spark, tree))) == (20, 20, 0, 0)
    assert index(store) == whole(spark, tree)
    gone, edited = rnd.sample(sorted(tree), 2)
    del tree[gone]
    tree[edited] = "edited"
    tree["new/n.md"] = "# N\n" + long
    assert counts(store.sync(snapshot(spark, tree))) == (20, 2, 18, 1)
    assert index(store) == whole(spark, tree)
    states = {r["path"]: r["status"] for r in store.pages().collect()}
    assert len(states) == 21 and {p for p, s in states.items() if s == "active"} == set(tree)


def test_untouched_buckets_stay(spark, tmp_path):
    tree = {f"{i}.md": f"fern {i}" for i in range(40)}
    store = PageStore(spark, str(tmp_path / "store"), buckets=16).create()
    store.sync(snapshot(spark, tree))
    before = files(store)
    bucket = {r["path"]: r["bucket"] for r in store.pages().collect()}
    tree["7.md"] = "moss"
    assert counts(store.sync(snapshot(spark, tree))) == (40, 1, 39, 0)
    after = files(store)
    assert {f.split("bucket=")[1].split("/")[0] for f in before ^ after} == {str(bucket["7.md"])}
    assert counts(store.sync(snapshot(spark, tree))) == (40, 0, 40, 0) and files(store) == after


def test_pages_go_and_come_back(spark, tmp_path):
    tree = {"a.md": "# A\nfern", "b.md": "moss"}
    store = PageStore(spark, str(tmp_path / "store"), buckets=1).create()
    store.sync(snapshot(spark, tree))
    # every chunk of the only bucket goes
    assert counts(store.sync(snapshot(spark, {"a.md": "---\nstatus: deleted\n---\n"}))) == (0, 0, 0, 2)
    assert index(store) == [] and {r["status"] for r in store.pages().collect()} == {"deleted"}
    assert counts(store.sync(snapshot(spark, {}))) == (0, 0, 0, 0)
    # one comes back as it was, with its chunks
    assert counts(store.sync(snapshot(spark, {"a.md": "# A\nfern"}))) == (1, 0, 1, 0)
    assert index(store) == whole(spark, {"a.md": "# A\nfern"})
    # a stored tier that the file does not say is mended, and so are its chunks
    rows = store.pages().collect()
    spark.createDataFrame([{**r.asDict(), "tier": 2} for r in rows], store.pages().schema).write.mode("overwrite").partitionBy("bucket").parquet(f"{store.path}/pages")
    assert counts(store.sync(snapshot(spark, {"a.md": "# A\nfern"}))) == (1, 1, 0, 0)
    assert [r["tier"] for r in store.pages().filter("status = 'active'").collect()] == [1]


def test_a_sync_that_ended_between_its_tables_is_repeated(spark, tmp_path, monkeypatch):
    tree = {f"{i}.md": f"fern {i}" for i in range(6)}
    store = PageStore(spark, str(tmp_path / "store"), buckets=4).create()
    store.sync(snapshot(spark, tree))
    tree |= {"1.md": "moss", "9.md": "new"}
    del tree["2.md"]
    write = PageStore._write

    def lost(self, rows, name):
        if name == "pages":
            raise RuntimeError("lost")
        write(self, rows, name)

    with monkeypatch.context() as m:
        m.setattr(PageStore, "_write", lost)
        try:
            store.sync(snapshot(spark, tree))
        except RuntimeError:
            pass
    assert counts(store.sync(snapshot(spark, tree))) == (6, 2, 4, 1)
    assert index(store) == whole(spark, tree)
