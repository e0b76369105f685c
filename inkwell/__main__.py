"""Command line: ``python -m inkwell build SRC OUT`` and ``python -m inkwell sample SRC``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkwell.functions.splitting import is_validation, sampled
from inkwell.plans.build import SHUFFLES, build
from inkwell.session import local_session
from inkwell.shipping import ship
from inkwell.sources.documents import read_source


def sample(spark: SparkSession, src: str, sample_frac: float, seed: int, val_frac: float, split_seed: int) -> dict:
    """Counters of the sample that a tokenizer would be trained on: drawn documents outside validation. Sizes are code points."""
    docs = read_source(spark, src).withColumn("is_val", is_validation(F.col("key"), val_frac, split_seed)).withColumn("drawn", sampled(F.col("ord"), sample_frac, seed))
    used = F.col("drawn") & ~F.col("is_val")
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if("is_val").alias("val_docs_skipped"), F.count_if(used).alias("sampled_docs"), F.coalesce(F.sum(F.when(used, F.char_length("text"))), F.lit(0)).alias("sampled_size")).first().asDict()


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="inkwell", description="Prepare text corpora for language-model pre-training.")
    commands = parser.add_subparsers(dest="command", required=True)
    to_build = commands.add_parser("build", help="tokenize a source into caches")
    to_build.add_argument("src")
    to_build.add_argument("out")
    to_build.add_argument("--tokenizer", default="bytes", help="bytes, or a tokenizer file")
    to_build.add_argument("--specials", type=int, nargs=3, metavar=("BOS", "EOS", "PAD"), help="ids to use where the vocabulary has no special tokens at its end")
    to_build.add_argument("--shard-tokens", type=int, default=1_000_000_000)
    to_build.add_argument("--val-out")
    for name, kind in (("max-docs", int), ("max-tokens", int), ("max-bytes", int), ("shuffle-seed", int)):
        to_build.add_argument(f"--{name}", type=kind)
    to_build.add_argument("--shuffle", choices=sorted(SHUFFLES), default="exact")
    to_sample = commands.add_parser("sample", help="count what a tokenizer would be trained on")
    to_sample.add_argument("src")
    to_sample.add_argument("--sample-frac", type=float, default=1.0)
    to_sample.add_argument("--seed", type=int, default=0)
    for command in (to_build, to_sample):
        command.add_argument("--val-frac", type=float, default=0.0)
        command.add_argument("--split-seed", type=int, default=0)
    return parser


def main(argv: list[str] | None = None) -> None:
    given = vars(arguments().parse_args(argv))
    command = given.pop("command")
    spark = SparkSession.getActiveSession() or local_session(app="inkwell")
    ship(spark)
    if command == "sample":
        print(json.dumps(sample(spark, **given)))
        return
    given["specials"] = tuple(given["specials"]) if given["specials"] else None
    made = build(spark, given.pop("src"), given.pop("out"), log=lambda line: print(line, file=sys.stderr), **given)
    print(json.dumps({key: made[key] for key in ("docs", "tokens", "loss_tokens", "text_bytes")}))


if __name__ == "__main__":
    main()
