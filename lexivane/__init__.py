"""lexivane - text search and embedding-quality analytics as Spark jobs.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (DataFrame to DataFrame), ``plans`` (whole pipelines) and
``streaming`` (incremental versions of the same operators).
"""

__version__ = "0.1.0"
