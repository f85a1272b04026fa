"""Names and number text as Column expressions."""

from pyspark.sql import Column, functions as F

from tidemark.fixed_values import DEFAULT_SCHEMA


def qualified(schema: Column, name: Column) -> Column:
    return F.concat_ws(".", schema, name)


def schema_of(qn: Column) -> Column:
    """Part before the first dot; a bare name belongs to the default schema."""
    return F.when(qn.contains("."), F.substring_index(qn, ".", 1)).otherwise(DEFAULT_SCHEMA)


def name_of(qn: Column) -> Column:
    """Part after the first dot; a bare name is itself."""
    return F.substr(qn, F.instr(qn, ".") + 1)


def with_schema(qn: Column) -> Column:
    """Bare names get the default schema."""
    return F.when(qn.contains("."), qn).otherwise(F.concat(F.lit(DEFAULT_SCHEMA + "."), qn))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def signed_thousands(n: Column) -> Column:
    return F.concat(F.when(n >= 0, "+").otherwise(""), thousands(n))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + noun), F.when(n != 1, "s").otherwise(""))


def mask_credentials(url: Column) -> Column:
    return F.regexp_replace(url, "://[^@/]+@", "://***@")


def quoted(name: str) -> Column:
    """Reference to a column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
