"""Training-data operators: thirteen corpus operators, their queries and their oracle SQL.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries when it is present.
"""
