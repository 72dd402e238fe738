"""All queries of the engine's own operators, by name, each with its DuckDB check."""

from __future__ import annotations

from . import discovery, events, manifests, media, pages, responses, routing, sites, streams, structure, subtitles, text, timeline

MODULES = [text, timeline, routing, sites, manifests, discovery, subtitles, structure, streams, responses, events, media]

QUERIES = {**pages.QUERIES, **{k: v for m in MODULES for k, v in m.PAIRS.queries.items()}}
ORACLES = {**pages.ORACLES, **{k: v for m in MODULES for k, v in m.PAIRS.oracles.items()}}
