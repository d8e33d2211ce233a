"""Training-data operators: joins, packing, decontamination, sharding, classifiers, PII, HTML.

Nothing else in the library imports this subpackage.
"""
