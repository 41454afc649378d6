"""All registered queries, assembled from the modules of this folder."""

import importlib

from . import bindings  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

for _m in ("metric_queries", "entity_queries", "retrieval_queries", "state_queries", "ingest_queries", "extraction_queries", "evaluation_queries", "stream_queries", "upkeep_queries"):
    importlib.import_module(f"{__name__}.{_m}")

from .retrieval_queries import flagship  # noqa: E402,F401
