"""Names and texts inside SQL expressions.

Reports over many columns are built as SQL text: one call per report instead of several calls into
the JVM per column, which would take longer than the query on a wide table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as identifier."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of that very name, whatever it holds."""
    return F.col(quoted(name))


def literal(text: str) -> str:
    """A text as literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rows_of(structs: list[str]) -> str:
    """Expression that turns structs of one row into one row each."""
    return f"inline(array({', '.join(structs)}))"


def struct_of(fields: dict[str, str]) -> str:
    """named_struct of name → expression."""
    return f"named_struct({', '.join(f'{literal(n)}, {e}' for n, e in fields.items())})"
