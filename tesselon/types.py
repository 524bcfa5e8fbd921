"""Layouts of the tables, as schema strings."""

SERIES = "file_id bigint, n int, c int, values array<double>"
VALID = "file_id bigint, n int, c int, start int, end int"
CODES = "file_id bigint, n int, c int, codes array<int>"
ERRORS = "file_id bigint, n int, c int, mse double, mae double"
REGISTRY = "id int, path string"
CODEBOOK = "code bigint, e array<float>"
EMBEDDING = "file_id bigint, n int, c int, s int, e array<float>"
CELLS = "file_id bigint, n int, c int, s int, cell int"
USAGE = "cell int, file_id bigint, n int, c int, s int, valid_len int"
CURVE = "iter int, bin int, perf double"
WEIGHTS = "bin int, w double"


def violations(df, schema: str) -> list[str]:
    """Columns that a table lacks or has with another type; empty if it fits."""
    from pyspark.sql.types import _parse_datatype_string

    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: {have.get(f.name, 'missing')}, not {f.dataType.simpleString()}" for f in _parse_datatype_string(schema) if have.get(f.name) != f.dataType]
