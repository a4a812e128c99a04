"""plyframe: PySpark-native analytics for hand-written game records.

Every operator is a function over DataFrames or Columns; nothing here starts a
session or runs an action on import.
"""
