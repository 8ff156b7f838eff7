"""Command line: find similar files, make a watched set, look into one."""

from __future__ import annotations

import argparse
import logging

from twinframe.params import Params


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinframe", description=__doc__)
    # The options' names, kinds and defaults.
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("directory", nargs="?")
    what.add_argument("--create-watched-db-from", metavar="DIR")
    what.add_argument("--inspect-db", metavar="DB")
    p.add_argument("-t", "--threshold", type=float, default=90.0)
    p.add_argument("-f", "--frames", type=int, default=20)
    p.add_argument("-s", "--hash-size", type=int, default=8)
    p.add_argument("-c", "--cache-file")
    p.add_argument("-w", "--workers", type=int)
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--skip-duration", type=int, default=20)
    p.add_argument("--watched-db")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--log-file")
    for name in ("adopt-params", "move-watched", "move-duplicates", "move-skipped"):
        p.add_argument(f"--{name}", action="store_true", help="in place of a question")
    return p


def banner(args, mode: str) -> str:
    """The settings that count for a kind of run, as text."""
    rows = {"mode": mode}
    if mode == "inspect":
        rows["watched set"] = args.inspect_db
    else:
        rows |= {"folder": args.directory or args.create_watched_db_from, "frames": args.frames, "hash size": args.hash_size, "skip duration": args.skip_duration, "recursive": args.recursive, "cache": args.cache_file, "watched set": args.watched_db}
    if mode == "find":
        rows["threshold"] = args.threshold
    return "\n".join(f"{k}: {v}" for k, v in rows.items() if v is not None)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    handlers = [logging.StreamHandler(), *([logging.FileHandler(args.log_file, encoding="utf-8")] if args.log_file else [])]
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, handlers=handlers, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    if args.workers is not None and args.workers <= 0:
        p.error("workers must be positive")
    try:
        params = Params(args.frames, args.hash_size, args.threshold, args.skip_duration)
    except ValueError as e:
        p.error(str(e))
    from pyspark.sql import SparkSession

    from twinframe.plans import runs

    spark = SparkSession.builder.master(f"local[{args.workers or '*'}]").getOrCreate()
    try:
        if args.inspect_db:
            print(banner(args, "inspect"))
            runs.inspect(spark, args.inspect_db).show()
        elif args.create_watched_db_from:
            print(banner(args, "create"), runs.create_watched(spark, args.create_watched_db_from, params, args.watched_db, args.recursive, cache_name=args.cache_file), sep="\n")
        else:
            print(banner(args, "find"))
            found = runs.find_similar(spark, args.directory, params, args.recursive, args.watched_db, args.adopt_params, args.move_watched, args.move_duplicates, args.move_skipped, cache_name=args.cache_file)
            for r in found.report.orderBy("group_no", "path").toLocalIterator():
                print(r["group_no"], r["path"], f"{r['avg_similarity']:.2f}", r["size_text"], sep="\t")
    except Exception:
        logging.exception("the run failed")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
