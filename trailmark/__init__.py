"""Customer-journey analytics on Spark DataFrames."""

from trailmark.api import Flow
from trailmark.operators import *  # noqa: F403
from trailmark.operators import __all__ as _operators
from trailmark.plans import *  # noqa: F403
from trailmark.plans import __all__ as _plans
from trailmark.sources import *  # noqa: F403
from trailmark.sources import __all__ as _sources

__all__ = ["Flow", *_operators, *_plans, *_sources]
