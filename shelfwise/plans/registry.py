"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
VIEWS = {"products": tables.PRODUCTS, "predictions": tables.PREDICTIONS, "submission": tables.SUBMISSION, "downloads": tables.DOWNLOADS}


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def oracle(sql: str, doubles: str, digits: int) -> str:
    views = ", ".join(f"{name} AS ({body})" for name, body in VIEWS.items())
    columns = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in doubles.split())
    return f"WITH {views}, q AS ({sql}) SELECT * {f'REPLACE ({columns})' if columns else ''} FROM q"


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``fn(spark, sf_dir)``; ``doubles`` are rounded here and in the SQL, as sums depend on order."""

    def keep(fn):
        def run(spark, sf_dir):
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in doubles.split()}) if doubles else df

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, doubles, digits)
        return fn

    return keep


def contains_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def case_contains(text: str, pairs, default) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {lit(w)}) THEN {v if isinstance(v, (int, float)) else lit(v)}" for w, v in pairs) + f" ELSE {default} END"
