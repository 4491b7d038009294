"""The minute-to-hour stage on a live feed."""
from .hourly import hourly_stream  # noqa: F401
