"""wideprep: Spark-native preparation and analysis of wide tables.

Every public operator is a function from DataFrame to DataFrame built from
Spark's own expressions, aggregates, windows and joins.  Sub-packages:

- ``functions``  Column -> Column expressions (text, names, numbers)
- ``sources``    readers, writers, line reports
- ``plans``      small driver-side plans (header names, fill decisions)
- ``operators``  profiling, imputation, ordered fills, statistics, models
"""

from wideprep.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
