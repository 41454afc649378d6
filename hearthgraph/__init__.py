"""Knowledge-base analytics as Spark jobs: ingest, retrieval, entity graph, metrics, curation, evaluation."""
