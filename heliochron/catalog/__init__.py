"""All registered queries."""
from . import cleaning, resampling, alignment, features, scaling, forecasts, scoring, profiling, reading  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
