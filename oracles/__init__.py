"""Reference SQL for the named reports, written for DuckDB."""

from importlib import import_module


def all_sql() -> dict[str, str]:
    out = {}
    for name in ("tables", "tests", "monitoring", "decisions", "replays"):
        out.update(import_module(f"oracles.{name}").SQL)
    return out
