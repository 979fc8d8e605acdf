"""Sources to syntax_nodes: a table function that parses one text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from mutalake.syntax import outline, parsers
from mutalake.syntax.nodes import COLUMNS, SCHEMA, Rows

#: Rows of a batch.
BATCH = 2000


def tree(language: str, text: str):
    """The syntax tree of a text: whole for languages with mutations, an outline for those that are only scanned."""
    return parsers.parse(language, text) if language in parsers.PARSERS else outline.scan(language, text)


def languages() -> list[str]:
    return sorted({*parsers.PARSERS, *outline.SCANNERS})


def syntax_nodes(sources: DataFrame) -> DataFrame:
    """A row a node of each source (file, language, text); see nodes.SCHEMA.

    Null texts and languages without a parser have no rows, an empty text has its root alone. A text is
    parsed in one task; odd syntax gives an odd tree, never an error. Repeated files give repeated rows.
    """
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(COLUMNS))], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for file, language, text in zip(*(batch.column(x).to_pylist() for x in ("file", "language", "text")), strict=True):
                for row in Rows(file, language, text, tree(language, text)).all():
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield flush()
        if rows:
            yield flush()

    known = sources.where("text is not null").where(sources["language"].isin(*languages()))
    return known.select("file", "language", "text").mapInArrow(run, SCHEMA)
