"""Training-data operators: decontamination, mixing, nearest neighbours, classifiers, formatting, stores, joins.

Nothing outside this subpackage imports it. ``registry`` holds the queries and their SQL.
"""
