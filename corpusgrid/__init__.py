"""corpusgrid: corpus analytics as Spark DataFrame operators.

Every public function takes DataFrames (and column names) and returns a
DataFrame; no function creates a session or pulls data rows to the driver
except bounded blocks that are documented as such (query blocks for
nearest neighbours, model weights).
"""

from corpusgrid.session import checkpoint_root, get_spark, materialize

__all__ = ["get_spark", "checkpoint_root", "materialize"]
