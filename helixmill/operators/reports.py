"""Reports of small tables as documents: JSON-ready dicts and Markdown. No decision is computed; it stays None."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of a report has at most so many rows; more is no summary.
MOST_ROWS = 5000


def table(df: DataFrame, order: tuple[str, ...] = ()) -> list[dict]:
    """The rows of a summary table, sorted by `order` or all columns, nulls first."""
    rows = [r.asDict() for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows")
    keys = order or tuple(df.columns)
    return sorted(rows, key=lambda r: tuple((r[k] is not None, str(type(r[k])), r[k]) if r[k] is not None else (False, "", "") for k in keys))


def build_report(tables: dict[str, DataFrame], build: str | None = None) -> dict:
    return {"build": build, "tables": {k: table(v) for k, v in sorted(tables.items())}, "recommendation": None}


def combined_report(reports: dict[str, dict], comparison: DataFrame | None = None) -> dict:
    return {"builds": {k: reports[k] for k in sorted(reports)}, "comparison": table(comparison) if comparison is not None else [], "recommendation": None}


def cell(x: object, places: int = 4) -> str:
    if x is None:
        return ""
    return f"{x:.{places}f}" if isinstance(x, float) else str(x)


def markdown(report: dict, title: str) -> str:
    """A heading and a table for each table of a report."""
    out = [f"# {title}", ""]
    for name, rows in report["tables"].items():
        out += [f"## {name}", ""]
        if rows:
            cols = list(rows[0])
            out += ["| " + " | ".join(cols) + " |", "|" + "-|" * len(cols), *["| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows], ""]
        else:
            out += ["no rows", ""]
    return "\n".join(out)


def combined_markdown(report: dict, title: str) -> str:
    parts = [f"# {title}", ""]
    for build, r in report["builds"].items():
        parts.append(markdown(r, build).replace("\n## ", "\n### ").replace("# ", "## ", 1))
    return "\n".join([*parts, markdown({"tables": {"comparison": report["comparison"]}}, "builds").replace("# builds\n", "")])
