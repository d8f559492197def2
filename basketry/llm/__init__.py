"""Operators for preparing training data at corpus scale.

Each operator takes and returns Spark DataFrames; Spark partitions, shuffles
and joins the rows, and numpy works on Arrow batches inside the tasks. Nothing
outside this subpackage imports it. Common conventions:

* documents carry ``doc_id`` (long) and ``text`` (string); a null text counts
  as an empty one, further columns are ignored or passed through;
* intermediate tables go to the shared checkpoint folder (``workdir``), so a
  lost executor never costs more than the tasks it was running.
"""
