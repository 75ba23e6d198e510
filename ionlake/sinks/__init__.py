"""Writers of predictions and spectral libraries."""

from .libraries import SINKS, write_results

__all__ = ["SINKS", "write_results"]
