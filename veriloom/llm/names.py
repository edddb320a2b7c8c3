"""Names for columns that an operator adds for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(docs: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of docs has, in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for stem in stems:
        name = f"__veriloom_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
