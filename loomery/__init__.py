"""Loomery: a Spark-native engine for customer-master data quality and entity resolution.

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``; answers
of registries, searches, pages and reviewers come in as evidence DataFrames,
so a result is a function of its inputs. Large-scale training-data operators
live in ``loomery.llm``, which nothing else in the package imports.
"""
