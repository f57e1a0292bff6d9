"""Drug-safety signal analytics as Spark DataFrame operators.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns) without running an action, unless its name says that it writes.
"""
