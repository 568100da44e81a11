"""commitlens: commit-mining analytics as lazy Spark DataFrame operators.

Every public operator takes DataFrames plus column names and returns a new
lazy DataFrame; nothing is collected to the driver.  Sub-packages:

* ``functions``  – column expressions (text predicates, parsers, fixed rule lists)
* ``operators``  – filters, joins (incl. as-of), aggregates, dedup, sampling,
                   release matching, verification, scoring
* ``sources``    – CSV / text / JSON / file-inventory readers and sinks
* ``streaming``  – incremental (Structured Streaming) forms
* ``plans``      – fixture adapters, composite jobs and the query registry
"""

from commitlens.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
