"""Import every query module so that the registry is full."""

from queries import registry
from queries import basics, aggregates, scalars, windows_time, joins_q, cep, sources_q, features_q, insight, flows_q, streams, sliced, jobs_q, panes_q, rowmatch_q, tables_q  # noqa: F401

QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
