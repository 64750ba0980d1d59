"""python -m corpusloom.cli SOURCE --target rag --output FOLDER"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from corpusloom.operators import bundling
from corpusloom.plans import job, probe
from corpusloom.sources import records


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("source", nargs="?")
    p.add_argument("--target", choices=list(job.BUDGETS))
    p.add_argument("--mode", choices=job.MODES)
    p.add_argument("--output")
    p.add_argument("--timestamped", action="store_true", help="write to a new folder below --output, named by project, target, mode and time")
    p.add_argument("--max-bundle-tokens", type=int)
    p.add_argument("--project-name")
    p.add_argument("--include-extensions", default="")
    p.add_argument("--exclude-dirs", default="")
    p.add_argument("--profile")
    p.add_argument("--profiles-dir")
    p.add_argument("--list-profiles", action="store_true")
    p.add_argument("--appeals-db", help="a SQLite file of case records, in place of a source folder")
    p.add_argument("--limit", type=int, help="with --appeals-db: the first records only")
    p.add_argument("--context-probe", type=int, nargs="?", const=8, metavar="N", help="write N bundles with canaries, and their key, and nothing else")
    p.add_argument("--token-vocabulary", help="a .tiktoken file: tokens are counted, not estimated")
    p.add_argument("--embedding-model", help="hashing or hashing:<dimensions>")
    return p


def settings(args: argparse.Namespace) -> job.Profile:
    known = job.TEMPLATES | (job.saved(args.profiles_dir) if args.profiles_dir else {})
    if args.profile and args.profile not in known:
        raise ValueError(f"unknown profile {args.profile!r}")
    base = known[args.profile] if args.profile else job.Profile("command line")
    names = lambda s: tuple(x.strip() for x in s.split(",") if x.strip()) or None
    dotted = lambda xs: tuple(x.lower() if x.startswith(".") else f".{x.lower()}" for x in xs) if xs else None
    return job.with_overrides(
        base, target=args.target, mode=args.mode, max_bundle_tokens=args.max_bundle_tokens, project_name=args.project_name, default_source_folder=args.source,
        default_output_folder=args.output, include_extensions=dotted(names(args.include_extensions)), exclude_dirs=names(args.exclude_dirs), embedding_model=args.embedding_model, token_vocabulary=args.token_vocabulary,
    ).validate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.list_profiles:
        print("\n".join(job.TEMPLATES | (job.saved(args.profiles_dir) if args.profiles_dir else {})))
        return 0
    try:
        p = settings(args)
        if not p.default_source_folder and not args.appeals_db and not args.context_probe:
            raise ValueError("a source folder is needed")
        if not args.context_probe:
            p.validate_source(args.appeals_db)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    try:
        own = spark is None
        spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
        if args.context_probe:
            probe.write(spark, p.default_output_folder, args.context_probe, p.max_bundle_tokens or probe.TOKENS)
            return 0
        said: list[str] = []
        docs = job.records_of(records.sqlite_tables(spark, args.appeals_db), args.limit) if args.appeals_db else job.documents(spark, p.default_source_folder, p, said)
        result = job.run(docs, p, said)
        # A folder of its own for each export, if asked for, by project, target, mode and time.
        result.write(f"{p.default_output_folder}/{job.folder_name(p, datetime.now())}" if args.timestamped else p.default_output_folder)
        if own:  # nothing of this program is read any more
            bundling.cleared(spark)
        for said in result.warnings:
            print(f"warning: {said}")
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # the command's last resort: one line and a code
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
