"""A catalog of temporary views, and a small SQL shell over it."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.all import QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register_tables(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every table that can be read, as a lazy view; what can't is skipped with a warning."""
    out = []
    for name in TABLES:
        try:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
            out.append(name)
        except Exception as e:  # noqa: BLE001
            print(f"warning: table {name}: {str(e).splitlines()[0]}", file=sys.stderr)
    return out


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "v_") -> list[str]:
    """The summary views by name; one that fails only warns."""
    out = []
    for name, build in QUERIES.items():
        if name.startswith(prefix):
            try:
                build(spark, sf_dir).createOrReplaceTempView(name)
                out.append(name)
            except Exception as e:  # noqa: BLE001
                print(f"warning: view {name}: {str(e).splitlines()[0]}", file=sys.stderr)
    return out


def row_counts(spark: SparkSession, names) -> dict[str, int]:
    """Rows of each view, 0 where there is none."""
    return {n: spark.table(n).count() if spark.catalog.tableExists(n) else 0 for n in names}


def run_sql(spark: SparkSession, sql: str, show: Callable[[str], None] = print, rows: int = 100, **args) -> bool:
    """Run one statement with bound parameters and show its rows; False if it fails."""
    try:
        df: DataFrame = spark.sql(sql, args=args or None)
        if not df.columns:
            show("OK")
            return True
        found = df.limit(rows).toPandas()
        show("(0 rows)" if found.empty else found.to_string(index=False))
        return True
    except Exception as e:  # noqa: BLE001
        show(f"error: {str(e).splitlines()[0]}")
        return False


def shell(spark: SparkSession, lines=None, show: Callable[[str], None] = print) -> None:
    """Read statements up to ``;``. Lines keep their ends, so comments stay on their line."""
    buffer = ""
    for line in lines if lines is not None else sys.stdin:
        word = line.strip().lower()
        if not buffer and word in (".exit", ".quit"):
            return
        if not buffer and word == ".help":
            show(".tables  .views  .schema NAME  .exit  or SQL ending in ;")
        elif not buffer and word in (".tables", ".views"):
            show("\n".join(t.name for t in spark.catalog.listTables() if t.name.startswith("v_") == (word == ".views")))
        elif not buffer and word.startswith(".schema"):
            run_sql(spark, f"DESCRIBE {line.split()[1]}" if len(line.split()) > 1 else "SHOW TABLES", show)
        elif word:
            buffer += line if line.endswith("\n") else line + "\n"
            if word.endswith(";"):
                run_sql(spark, buffer.strip().rstrip(";"), show)
                buffer = ""


def main(args: list[str] | None = None) -> int:
    import argparse

    from tessera.session import session

    parser = argparse.ArgumentParser(description="SQL over the tables and views")
    parser.add_argument("data")
    parser.add_argument("--query")
    given = parser.parse_args(args)
    spark = session()
    register_tables(spark, given.data)
    register_views(spark, given.data)
    if given.query:
        return 0 if run_sql(spark, given.query) else 1
    shell(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
