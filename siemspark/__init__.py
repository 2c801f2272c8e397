"""Security-event analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames; nothing collects rows to the
driver.  See README.md for the map of modules.
"""

from siemspark.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
