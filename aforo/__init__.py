"""aforo: batch analytics on sensor readings over named date periods, written with the DataFrame API.

Every public function takes and returns a ``DataFrame`` and stays lazy. The exceptions are named in
their docstrings: the writers, the CSV header probe and the exact median.
"""

from aforo.periods import PERIODS, Period

__all__ = ["PERIODS", "Period"]
