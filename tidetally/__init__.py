"""Survey-catch analytics on Spark DataFrames.

Sub-packages: ``functions`` (Column expressions), ``operators`` (DataFrame to
DataFrame steps), ``sources`` (scans and sinks), ``plans`` (composites built
from the operators) and ``streaming`` (the incremental form of the refresh).
"""

from tidetally.operators.filters import FilterSpec

__all__ = ["FilterSpec"]
