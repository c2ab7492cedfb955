"""Training-data operators: tokenising, near duplicates, decontamination,
filters, licence scans, sharding and language identification.

Each module holds one operator with a general interface;
:mod:`tally.llm.queries` binds them to the given tables.  Nothing outside
this package imports it.
"""
