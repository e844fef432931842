"""Training-data operators: scoring, deduplication, decontamination,
chat formatting and tokenisation of text tables as Spark jobs.

Each module holds one operator; ``catalog`` registers their queries. Nothing
outside this subpackage imports it.

Conventions shared by the operators
-----------------------------------
* a null text is an empty text; a null key is an ordinary key value;
* every input row counts as a document of its own, also when rows repeat;
* input columns other than those an operator names are carried along or
  ignored, never interpreted, and may have any name.
"""
