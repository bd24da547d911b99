"""Training-data operators: ten corpus operators, their queries and their SQL.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
only when it can be imported.
"""
