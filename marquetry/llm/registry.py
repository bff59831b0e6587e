"""What __spark_entry__ registers of this subpackage."""

from marquetry.llm.oracles import oracle_sql
from marquetry.llm.queries import queries

__all__ = ["oracle_sql", "queries"]
