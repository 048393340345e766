"""Operators for preparing language-model training data at scale.

Each module holds one operator with a general interface and the thin query that
applies it to the driver's tables; ``registry`` lists the queries.
"""
