"""PySpark-native page extraction and content analytics.

Operators take and return DataFrames or Columns; heavy text work runs in fused
Arrow UDFs, everything else stays inside Catalyst.  ``pagewright.llm`` holds
the training-data operators and is optional: nothing else imports it.
"""

__version__ = "0.1.0"
