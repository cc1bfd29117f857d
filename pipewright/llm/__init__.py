"""Training-data operators: one module per operator, each with the DataFrame
operator itself and the thin ``opN_*`` query registered by ``__spark_entry__``.

Nothing else in the library imports this subpackage.
"""
