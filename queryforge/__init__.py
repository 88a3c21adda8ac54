"""queryforge: Spark-native analytics for grading SQL work at scale.

Sub-packages:

* ``sources``   - table loading, schema profiles, task catalog, sinks.
* ``functions`` - Column-level helpers (scores, dates, text screening).
* ``operators`` - DataFrame operators: relational building blocks, ordered
  scans, grading, rewards, episodes, prompts and run analytics.
* ``plans``     - bridge views over the driver tables and the registered
  queries with their DuckDB twins.
* ``streaming`` - Structured Streaming form of the episode fold.
"""

from queryforge.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
