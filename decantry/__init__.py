"""decantry: commerce analytics for a decant shop, expressed as Spark DataFrame plans.

Operators are pure functions DataFrame -> DataFrame (or a small tuple of DataFrames);
nothing here holds a global session. See README.md for the module map.
"""

__all__ = ["session"]
