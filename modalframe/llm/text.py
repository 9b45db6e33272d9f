"""Words, ASCII lower case and the Arrow pass over whole texts that the text operators share."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BREAKS = "\t\n\x0b\x0c\r"


def words(text: str | None) -> list[str]:
    """The runs of characters other than blank and U+0009 to U+000D; none for a null text."""
    if not text:
        return []
    for c in _BREAKS:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def map_texts(df: DataFrame, keep: Sequence[str], text: str, compute: Callable[..., list], added: str, with_keys: bool = False) -> DataFrame:
    """Columns ``keep`` of ``df`` followed by columns that ``compute`` makes from whole texts, one Arrow batch at a time.

    ``compute`` gets the texts of a batch (``with_keys``: the values of the first column of ``keep``, then the texts) and
    returns one list per column of the DDL ``added``. Other columns of ``df`` are never read, so their names cannot clash.
    No shuffle.
    """
    extra = StructType.fromDDL(added)
    schema = StructType([df.schema[c] for c in keep] + extra.fields)
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    n, names = len(keep), [f.name for f in schema.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in extra.fields]
        for batch in batches:
            given = [batch.column(0).to_pylist()] if with_keys else []
            made = compute(*given, batch.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(x, type=k) for x, k in zip(made, kinds, strict=True))], names=names)

    return source.mapInArrow(run, schema)
