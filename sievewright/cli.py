"""Command line: a question over paths from standard input, and the outline, chunk and token tools."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievewright", description="Search source files for what bears on a question.")
    p.add_argument("question", help="the question; or outline, chunk or tokens, followed by files")
    p.add_argument("files", nargs="*")
    p.add_argument("--sample", type=int, help="search only so many files, taken at random")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--concurrency", type=int, default=100, help="calls at a time")
    p.add_argument("--no-refine", action="store_true", help="show the findings of each file as they are")
    p.add_argument("--no-outlines", action="store_true", help="analyse every file in full")
    p.add_argument("--cache", help="folder of the cache; by default one below the home folder, unless the environment turns caching off")
    p.add_argument("--tokenizer", help="file of a tokenizer to count with; without it a token is four characters")
    return p


def tool(name: str, files: list[str]) -> int:
    from pathlib import Path

    from .operators.outline import chunks, outline, tokens

    for file in files:
        text = Path(file).read_text()
        extension = Path(file).suffix.lower()
        if name == "outline":
            print(outline(text, extension))
        elif name == "chunk":
            for k, (chunk, _) in enumerate(chunks(text, extension, 2000)):
                print(f"--- {file} {k}\n{chunk}")
        else:
            print(f"{file}: {tokens(text)}")
    return 0


def main(argv: list[str] | None = None, paths: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.question in ("outline", "chunk", "tokens") and args.files:
        return tool(args.question, args.files)
    import os

    from pyspark.sql import functions as F

    from .config import from_environment
    from .functions.arrow import clean, materialize
    from .functions.text import parseable
    from .operators.cache import Cache
    from .operators.judge import HttpJudge, LexicalJudge
    from .plans.pipeline import search
    from .sources.scan import path_list, read_listed

    tell = lambda line: print(line, file=sys.stderr)
    config = from_environment(concurrency=args.concurrency, refine=not args.no_refine, analyze_skeletons=not args.no_outlines, sample=args.sample, seed=args.seed, tokenizer=args.tokenizer, on_stage=tell)
    spark = SparkSession.builder.appName("sievewright").getOrCreate()
    wanted = [x.strip() for x in (paths if paths is not None else sys.stdin)]
    listed = path_list(spark, [x if "://" in x or not x else os.path.abspath(x) for x in wanted])
    listed = materialize(read_listed(listed), "listed")
    for row in listed.where("problem is not null").orderBy("ord").toLocalIterator():
        tell(f"warning: {row['path']} is not a file" if row["problem"] == "missing" else f"error: {row['problem']} [File: {row['path']}]")
    files = listed.where("problem is null").select("path", "ord", "text", parseable(F.col("path")).alias("parseable"))
    if files.isEmpty():
        tell("error: no files to search")
        return 1
    folder = args.cache or os.environ.get("SIEVEWRIGHT_CACHE_DIR") or os.path.expanduser("~/.cache/sievewright")
    judge = HttpJudge(config.backend) if config.backend else LexicalJudge()
    result = search(files, args.question, judge, config, Cache(spark, folder) if args.cache or config.cache_mode != "none" else None)
    print(result.render())
    for row in result.warnings.toLocalIterator():
        tell(f"warning: {row['message']} [File: {row['path']}]")
    for line in result.error_lines().toLocalIterator():
        tell(line["line"])
    clean(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
