"""The command line: ``python -m tessera search "proof fn lemma_.*" -c src -e attic`` and the like (SC23).

Sources are directories (-c), lists of directories (-d) or files (-f); -e excludes, -m keeps the files of a
module, -l says where the library lies, -o writes instead of printing. Nothing is changed but by ``fix``,
which without --dry-run writes the changed files to -o, never over the sources."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import edits, fixes
from tessera.operators.extract import facts, path_lines
from tessera.plans import audit, inventory, reviews, search, style
from tessera.plans.report import write_report
from tessera.session import local_session
from tessera.sources.files import read_files

VIEWS = ("search", "audit", "targets", "style", "inventory", "loc", "lint", "paths", "fix")


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("view", choices=VIEWS)
    p.add_argument("pattern", nargs="?", default="_", help="of search")
    p.add_argument("-c", "--codebase", action="append", default=[], help="a directory of sources")
    p.add_argument("-d", "--dirs", nargs="+", default=[], help="directories of sources")
    p.add_argument("-f", "--files", nargs="+", default=[], help="single files")
    p.add_argument("-e", "--exclude", nargs="+", default=[])
    p.add_argument("-m", "--module", help="only files of this name")
    p.add_argument("-l", "--library", default="vstd", help="the directory name of the library")
    p.add_argument("-o", "--out")
    p.add_argument("-n", "--most", type=int, default=1000, help="rows to print")
    p.add_argument("--dry-run", action="store_true")
    return p.parse_args(given)


def sources_of(spark, args: argparse.Namespace) -> DataFrame:
    roots = [*args.codebase, *args.dirs, *args.files] or ["."]
    found = reduce(DataFrame.unionByName, (read_files(spark, r, exclude=tuple(args.exclude)) for r in roots))
    return found if args.module is None else found.where(F.col("stem") == args.module)


def view(args: argparse.Namespace, files: DataFrame) -> DataFrame:
    if args.view == "search":
        return search.search(files, args.pattern)
    if args.view == "audit":
        return audit.emacs(facts(files, "findings").orderBy("path", "line"))
    if args.view == "targets":
        return audit.audit(files)["targets"]
    if args.view == "style":
        return style.style(files).where("not ok").orderBy("path", "line", "rule")
    if args.view == "inventory":
        return inventory.totals(inventory.sections(files, args.library))
    if args.view == "loc":
        return facts(files, "loc").orderBy("path")
    if args.view == "lint":
        return reviews.string_manipulation(files).orderBy("path", "line_no")
    if args.view == "paths":
        return path_lines(facts(files, "paths")).orderBy("path", "seq").select("value")
    wanted = fixes.accept_assumes(files, facts(files, "findings"))
    return wanted if args.dry_run else edits.apply_edits(files, wanted)


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    spark = local_session("*", "tessera")
    found = view(args, sources_of(spark, args))
    if args.view == "fix" and not args.dry_run and not args.out:
        raise SystemExit("fix needs --out, or --dry-run")
    if args.out:
        found.write.mode("overwrite").json(args.out) if args.view == "fix" else write_report(found, args.out)
    else:
        for row in found.limit(args.most).toLocalIterator():
            print(*("" if v is None else v for v in row), sep="\t")
    spark.stop()


if __name__ == "__main__":
    main()
