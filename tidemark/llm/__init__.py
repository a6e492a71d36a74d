"""Training-data pipeline operators.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()``
collect the registered queries for ``__spark_entry__.py``.
"""


def queries():
    from tidemark.llm import registry

    return registry.queries()


def oracle_sql():
    from tidemark.llm import registry

    return registry.oracle_sql()
