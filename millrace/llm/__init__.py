"""Training-data operators: ten corpus-scale text and media operators.

Nothing outside this package imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
