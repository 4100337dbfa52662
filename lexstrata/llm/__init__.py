"""Training-data operators: ten corpus jobs that run as Spark plans.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` in
:mod:`lexstrata.llm.registry` are what the repository's entry module adds.
"""
