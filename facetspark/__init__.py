"""facetspark: attribute-value prediction data work as Spark DataFrame jobs.

Sub-packages
------------
functions  Column -> Column helpers (number text, templates, regex extraction, tokens)
sources    readers (lenient/strict records, text, CSV, JSON arrays, vocab, neighbours) and sinks
operators  DataFrame -> DataFrame operators (pairing, vocab, retrieval, few-shot, metrics, merge, models)
plans      the canonical item view over the test tables and the registered queries + oracle SQL
streaming  the file-stream form of the batch chain
"""

__version__ = "0.1.0"
