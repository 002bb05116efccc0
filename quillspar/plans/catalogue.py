"""Imports every module that registers queries."""

from quillspar.functions import extraction, markup, parsing, scalars, text  # noqa: F401
from quillspar.operators import articles, catalogue, column_profile, communities, composites, dashboard, evidence, facts, gates, graph, joins, knowledge, linkage, maintenance, names, paths, postings, profile, retrieval, routes, windows  # noqa: F401
from quillspar.sources import files, registry_files  # noqa: F401
from quillspar.streaming import incremental, journal, lease_queue, mirror, snapshots  # noqa: F401
