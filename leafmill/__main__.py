"""python -m leafmill SOURCE TARGET: a folder of files as a folder of Markdown trees."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import library, structure


def main(args: list[str] | None = None) -> int:
    """The batch's exit code; 1 for a target that isn't empty or outputs that collide."""
    parser = argparse.ArgumentParser(prog="leafmill", description="Convert EPUB, PPTX, MOBI, AZW3 and PDF files to Markdown trees.")
    parser.add_argument("source", help="a folder, or a file")
    parser.add_argument("target")
    parser.add_argument("--force", action="store_true", help="replace a target that isn't empty")
    parser.add_argument("--max-tokens", type=int, default=structure.MAX_TOKENS)
    parser.add_argument("--min-tokens", type=int, default=structure.MIN_TOKENS)
    told = parser.parse_args(args)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    try:
        return library.convert(spark, told.source, told.target, told.force, told.min_tokens, told.max_tokens)
    except (FileExistsError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
