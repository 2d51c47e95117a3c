"""Reports over small results: the renderers take what a caller has already bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, title: str, most: int) -> str:
    """A table of the first ``most`` rows, the caller's choice for a page, and how many more there are (SK2)."""
    rows = df.limit(most + 1).collect()
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    body = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:most]]
    return "\n".join(head + body + ([f"\n+{df.count() - most} more"] if len(rows) > most else [])) + "\n"


def write_report(df: DataFrame, path: str) -> None:
    """One line of text a row, from as many tasks as there are (SK1, SK4)."""
    df.select(F.concat_ws(": ", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_inventory(df: DataFrame, path: str) -> None:
    """JSON lines (SK3)."""
    df.write.mode("overwrite").json(path)
