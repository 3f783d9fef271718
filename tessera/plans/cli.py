"""Command line: list the queries, or run one or a group of them and keep the results.

    python -m tessera.plans.cli list
    python -m tessera.plans.cli run txt_chunks DATA --out DIR --limit 10
    python -m tessera.plans.cli chunks DATA --out DIR
    python -m tessera.plans.cli chunk-files PAGES --out DIR --vocabulary FILE

A group runs all of its queries; one that fails is reported and doesn't stop the others. ``chunk-files``
takes a tree of page documents (JSON) to tables of documents, sections and chunks, and a summary;
tokens are counted by a vocabulary file if one is given.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from tessera.functions.tokens import Vocabulary
from tessera.operators.chunking import token_count
from tessera.operators.dashboard import run_each
from tessera.plans.all import QUERIES
from tessera.plans.files import chunk_files

#: Prefixes of the queries of each group.
GROUPS = {
    "analytics": ("v_", "rep_"), "chunks": ("txt_", "rng_"), "embeddings": ("payloads", "dq_"), "taxonomy": ("vec_", "dim_", "review_"),
    "exploration": ("topics_",), "benchmark": ("ir_", "stat_", "dash_"),
}
FORMATS = ("parquet", "csv", "json")


def names_of(group: str) -> list[str]:
    return [n for n in QUERIES if n.startswith(GROUPS[group])]


def run_query(spark: SparkSession, name: str, data: str, out: str | None, kind: str, limit: int | None) -> str:
    """Write the rows of a query, or count and show them; returns what was done."""
    rows = QUERIES[name](spark, data)
    if limit:
        rows = rows.limit(limit)
    if out:
        writer = rows.write.mode("overwrite")
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{out.rstrip('/')}/{name}")
        return f"{out.rstrip('/')}/{name}"
    rows.show(20)
    return "shown"


def _session() -> SparkSession:
    from tessera.session import session

    return session()


def main(args: list[str] | None = None, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=("list", "run", "chunk-files", *GROUPS))
    parser.add_argument("rest", nargs="*", help="for run: NAME DATA; for a group: DATA")
    parser.add_argument("--out")
    parser.add_argument("--format", default="parquet", choices=FORMATS)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--vocabulary", help="for chunk-files: a tokenizer's JSON file")
    given = parser.parse_args(args)
    if given.command == "list":
        say("\n".join(sorted(QUERIES)))
        return 0
    if given.command == "chunk-files":
        if len(given.rest) != 1 or not given.out:
            parser.error("give one folder of pages, and --out")
        count = Vocabulary(given.vocabulary) if given.vocabulary else token_count
        summary = chunk_files(spark or _session(), given.rest[0], given.out, count, given.format).first()
        say(", ".join(f"{k}: {v}" for k, v in summary.asDict().items()))
        return 0
    names = given.rest[:1] if given.command == "run" else names_of(given.command)
    data = given.rest[1 if given.command == "run" else 0 :]
    if len(data) != 1 or not set(names) <= set(QUERIES):
        parser.error("give one data folder, and for run the name of a query")
    spark = spark or _session()
    done = run_each(names, lambda n: run_query(spark, n, data[0], given.out, given.format, given.limit))
    for name, (status, what) in done.items():
        say(f"{name}: {status}: {what}")
    return 0 if all(status == "ok" for status, _ in done.values()) else 1


if __name__ == "__main__":
    sys.exit(main())
