"""sensorgrid: DataFrame operators for networks of environmental sensors.

Every public function takes and returns Spark DataFrames (or Columns) and stays
lazy unless its docstring says that it fits a model or starts a stream.
"""

from sensorgrid.session import get_session, shared_dir, ship_package

__all__ = ["get_session", "shared_dir", "ship_package"]
