import contextlib
import io

from pyspark.sql import functions as F

from hearthgraph.operators import captures as K
from hearthgraph.streaming import jobs as J

KIND = "path string, capture_id string, text string"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


def test_captures_are_decided_once(spark, tmp_path):
    inbox, out, cp = (str(tmp_path / x) for x in ("inbox", "out", "cp"))
    calls = []

    def route(batch):
        calls.append(sorted(r["capture_id"] for r in batch.collect()))
        return batch.select("capture_id", "text")

    def run(router=route):
        J.capture_stream(spark.readStream.schema(KIND).parquet(inbox), router, out, cp)

    def rows(kind, *cols):
        return sorted(tuple(r[c] for c in cols) for r in spark.read.parquet(f"{out}/{kind}").collect())

    arrive(spark, inbox, [("a.txt", "a", "fern"), ("b.txt", "b", "moss"), ("a.txt", "a", "fern"), ("gone.txt", "g", None)])
    run()
    assert rows("rows", "capture_id", "text") == [("a", "fern"), ("b", "moss")] and rows("rejected", "capture_id", "reason") == [("g", "file is gone")]

    # files wait while a run dies on them; the next run drains them first, once, and decided paths stay decided
    arrive(spark, inbox, [("c.txt", "c", "sail"), ("a.txt", "a2", "fern again"), ("gone.txt", "g2", "back")])

    def dies(batch):
        raise RuntimeError("lost")

    try:
        run(dies)
    except Exception:  # noqa: BLE001
        pass
    arrive(spark, inbox, [("d.txt", "d", "rope"), ("c.txt", "c2", "sail again")])
    run()
    assert rows("rows", "capture_id", "text") == [("a", "fern"), ("b", "moss"), ("c", "sail"), ("d", "rope")]
    assert rows("rejected", "capture_id", "reason") == [("g", "file is gone")]
    run()
    assert sum(calls, []) == ["a", "b", "c", "d"]


def test_a_batch_is_asked_of_the_state_once(spark, tmp_path):
    inbox, out, cp = (str(tmp_path / x) for x in ("inbox", "out", "cp"))
    arrive(spark, inbox, [("a.txt", "a", "fern"), ("b.txt", "b", "moss"), ("a.txt", "a", "fern")])
    plans = []

    def route(batch):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            batch.explain()
        plans.append(said.getvalue())
        return batch.select("capture_id", "text")

    J.capture_stream(spark.readStream.schema(KIND).parquet(inbox), route, out, cp)
    # each reader of the batch ran the state, and the shuffle of all texts before it, anew
    assert len(plans) == 1 and "StreamingDeduplicate" not in plans[0] and "FileScan" in plans[0]
    assert sorted(r["capture_id"] for r in spark.read.parquet(f"{out}/rows").collect()) == ["a", "b"]


def test_long_titles_travel_as_the_words_they_can_share(spark):
    long = " ".join(f"w{i}" for i in range(300))
    new = spark.createDataFrame([(1, f"{long} harbor lamp", None), (2, "harbor lamp", None), (3, "brine", None), (4, "harbor fern moss sail", None)], "id int, title string, due date")
    old = spark.createDataFrame([(7, "lamp harbor rope", None), (8, "harbor lamp", None), (9, "fern moss harbor lamp", None)], "id int, title string, due date")
    got = {r["new_id"]: (r["open_id"], r["score"]) for r in K.duplicate_titles(new, old).collect()}
    assert got == {1: (8, 1.0), 2: (9, 1.0), 4: (9, 0.75)}
    sets = lambda d: d.select("id", K.title_tokens(F.col("title")).alias("toks")).withColumnRenamed("id", "set")
    ns, os = K.shared_words(sets(new), sets(old), 0.5)
    assert {r["set"]: (r["n"], sorted(r["words"])) for r in ns.collect()} == {1: (302, ["harbor", "lamp"]), 2: (2, ["harbor", "lamp"]), 4: (4, ["fern", "harbor", "moss"])}
    assert {r["set"]: (r["n"], sorted(r["words"])) for r in os.collect()} == {7: (3, ["harbor", "lamp"]), 8: (2, ["harbor", "lamp"]), 9: (4, ["fern", "harbor", "lamp", "moss"])}
