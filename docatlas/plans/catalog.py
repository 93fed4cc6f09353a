"""All registered queries."""

from docatlas.plans import q_logs, q_pages, q_resolve, q_sources, q_streams, q_symbols  # noqa: F401
from docatlas.plans.registry import ORACLES, QUERIES  # noqa: F401
