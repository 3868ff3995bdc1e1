"""lanternlog: security-log analytics on PySpark.

Rules, thresholds, sequences, incidents and telemetry coverage as DataFrame
plans, plus operators that clean and shape very large record tables.
"""

__version__ = "0.1.0"
