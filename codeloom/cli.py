"""Command line: python -m codeloom.cli --index --repo R | --search Q | --list-indexes | nothing (interactive)."""

from __future__ import annotations

import argparse
import functools
import importlib
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators import catalog, embed
from codeloom.plans import build
from codeloom.plans import search as S


def session() -> SparkSession:
    spark = SparkSession.builder.appName("codeloom").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="codeloom", description="Index and search a repository.")
    p.add_argument("--index", action="store_true", help="build an index of --repo")
    p.add_argument("--incremental", action="store_true", help="parse only what changed since the last version")
    p.add_argument("--dry-run", action="store_true", help="only say what an index would hold")
    p.add_argument("--no-report", action="store_true")
    p.add_argument("--search", metavar="QUERY")
    p.add_argument("--repo", default=".")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--list-indexes", action="store_true")
    p.add_argument("--index-name")
    p.add_argument("--store", default=os.environ.get("CODELOOM_STORE", os.path.expanduser("~/.codeloom")), help="folder of indexes")
    p.add_argument("--dimensions", type=int, default=256, help="of the hashing embedder")
    p.add_argument("--client", metavar="MODULE:FACTORY", help="embed with the client that FACTORY(api_key) makes; without it words are hashed")
    p.add_argument("--model", default="text-embedding-3-small", help="name of the client's model")
    p.add_argument("--api-key", default=os.environ.get("CODELOOM_API_KEY"), help="for the client")
    return p.parse_args(argv)


def chosen_embedder(a: argparse.Namespace) -> embed.Embedder | None:
    """The client's embedder, if a client is named."""
    if not a.client:
        return None
    if not a.api_key:
        raise ValueError("--client needs --api-key or CODELOOM_API_KEY")
    module, _, factory = a.client.partition(":")
    make = getattr(importlib.import_module(module), factory)
    return embed.RemoteEmbedder(functools.partial(make, a.api_key), a.model, a.dimensions)


def show(results: DataFrame) -> None:
    lines = [r["line"] for r in S.console_lines(results).collect()]
    print("\n\n".join(lines) or "no results")


def show_summary(report: dict) -> None:
    units, folders = report["code_units"], report["folders"]
    print(f"{report['file_processing']['total']} files")
    for row in report["file_processing"]["counts"]:
        print(f"{row['status']}{' (' + row['skip_reason'] + ')' if row['skip_reason'] else ''}: {row['n']} files")
    print(f"{units['n']} units, {units['size']} characters")
    for row in units["by_type"]:
        print(f"  {row['unit_type']}: {row['n']}, {row['avg_size']:.2f} characters each")
    total = sum(r["n"] for r in folders["counts"])
    for name in folders["skipped"]:
        print(f"  skipped {name}")
    if total > len(folders["skipped"]):
        print(f"  ... and {total - len(folders['skipped'])} more")


def choose(spark: SparkSession, store: str, ask=input) -> str | None:
    """The only index, or the one that is picked from a numbered list."""
    rows = catalog.displayed(build.list_indexes(spark, store)).collect()
    if len(rows) < 2:
        return rows[0]["index_name"] if rows else None
    for i, r in enumerate(rows, 1):
        print(f"{i}. {r['full_name']}  {r['timestamp']}")
    while True:
        answer = ask("index: ").strip()
        if answer.isdigit() and 1 <= int(answer) <= len(rows):
            return rows[int(answer) - 1]["index_name"]


def interactive(spark: SparkSession, store: str, index_name: str | None, ask=input, embedder: embed.Embedder | None = None) -> None:
    name = index_name or choose(spark, store, ask)
    if name is None:
        print("no index")
        return
    engine = S.open_index(spark, store, name, embedder)
    engine.vectors.cache()
    while (query := ask("query (exit to end): ").strip()) != "exit":
        if query:
            show(engine.search(query, 10))


def main(argv: Sequence[str] | None = None) -> int:
    a = arguments(argv)
    spark = session()
    try:
        if a.list_indexes:
            for r in catalog.displayed(build.list_indexes(spark, a.store)).collect():
                print(f"{r['index_name']}  {r['full_name']}  {r['timestamp']}")
        elif a.index and a.dry_run:
            show_summary(build.summary(spark, a.repo))
        elif a.index:
            built = build.build_index(spark, a.repo, a.store, chosen_embedder(a) or embed.HashingEmbedder(a.dimensions), incremental_build=a.incremental, with_report=not a.no_report)
            print(f"{built.index_name}: {built.units.count()} units in {built.location}")
        elif a.search is not None:
            show(S.search(spark, a.store, a.search, a.top_k, a.index_name, chosen_embedder(a)))
        else:
            interactive(spark, a.store, a.index_name, embedder=chosen_embedder(a))
    except (LookupError, ValueError) as why:
        print(why, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
