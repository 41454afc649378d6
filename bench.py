"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearthgraph import plans  # noqa: E402
from hearthgraph.plans.evaluation_queries import passage_pages  # noqa: E402
from hearthgraph.session import local_session, table  # noqa: E402

HEADLINE = [
    "R05_hybrid_search_chunked",
    "R01_lexical_candidates",
    "R02_vector_candidates",
    "X02_term_table",
    "X06_chunk_documents",
    "A05_metric_rollup",
    "A07_metric_anomalies",
    "A08_access_counts",
    "W01_journal_streak",
    "J02_one_hop_neighbors",
    "J10_edges_around",
    "J14_duplicate_titles",
    "G04_known_entity_mentions",
    "G05_works_at_inference",
    "M01_task_merge",
    "D02_compile_notes",
    "D03_compile_decision_digests",
    "E01_ir_metrics",
    "S07_keyed_merge",
    "F09_redact_corpus",
]


def quality(hits, relevant, queries: int) -> dict[str, float]:
    """Is a page that holds the passage among its hits, and how high? Over all passages that some page holds."""
    asked = relevant["query_id"].unique()
    first = hits.merge(relevant, left_on=["query_id", "id"], right_on=["query_id", "key"]).groupby("query_id")["rank"].min().reindex(asked)
    at = lambda k: round(float((first <= k).mean()), 4)
    return {"passages": queries, "answerable": len(asked), "hit1": at(1), "hit3": at(3), "hit5": at(5), "mrr": round(float((1 / first).fillna(0).mean()), 4)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, cpus, "bench")
    table(spark, sf_dir, "lineitem").count()  # start the engine before the clock
    only = sys.argv[1:]
    times: dict[str, float] = {}
    found = None
    for name in only or HEADLINE:
        start = time.perf_counter()
        df = plans.QUERIES[name](spark, sf_dir)
        if name == "R05_hybrid_search_chunked":
            found = df.toPandas()  # ten hits for each passage
        else:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    out = {"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    passages = table(spark, sf_dir, "benchmark").count()
    if found is not None:
        out["search_quality"] = quality(found, passage_pages(spark, sf_dir).toPandas(), passages)
    if "R05_hybrid_search_chunked" in times:
        out["search_queries_per_sec"] = round(passages / times["R05_hybrid_search_chunked"], 2)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
