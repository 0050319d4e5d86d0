"""Workload observability analytics as Spark jobs.

Sub-packages: ``sources`` (tables in and out), ``functions`` (column
expressions), ``operators`` (reusable DataFrame operators), ``plans`` (the
ingest, retention, report and root-cause jobs) and ``streaming``.
"""

__version__ = "0.1.0"
