"""Named queries over the engine's operators."""

from __future__ import annotations


def registries() -> list:
    """The registries of the core library."""
    from .curation import R as curation
    from .pipeline_queries import R as pipeline
    from .administration import R as administration
    from .ingest import R as ingest
    from .loading import R as loading
    from .retrieval import R as retrieval
    from .serving import R as serving

    return [curation, pipeline, serving, ingest, loading, administration, retrieval]
