"""All registered queries."""

from sonde.plans import queries_sources  # noqa: F401
from sonde.plans import queries_series  # noqa: F401
from sonde.plans import queries_spans  # noqa: F401
from sonde.plans import queries_detect  # noqa: F401
from sonde.plans import queries_spectral  # noqa: F401
from sonde.plans import queries_graph  # noqa: F401
from sonde.plans import queries_reason  # noqa: F401
from sonde.plans import queries_rank  # noqa: F401
from sonde.plans import queries_cases  # noqa: F401
from sonde.plans import queries_evaluate  # noqa: F401
from sonde.plans.registry import CHECKS, QUERIES  # noqa: F401
