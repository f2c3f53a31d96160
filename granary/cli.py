"""Command line: ``python -m granary ALGORITHM options``."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import patterns, subsets
from granary.operators import bigfim, fin, fpgrowth, results
from granary.plans import miners
from granary.session import session
from granary.sources.transactions import persisted, read_text, resolve_input

RUN_TYPES = " | ".join(fin.MODES)


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:  # type: ignore[override]
        raise ValueError(message)


def _message(option: str, value: str | None, allowed: str) -> str:
    if value is None or not value.strip():
        return f"Missing mandatory option '--{option}', allowed values: {allowed}"
    return f"Bad value of '--{option} {value}', allowed values: {allowed}"


def _number(kind: Callable[[str], Any], option: str, allowed: str) -> Callable[[str], Any]:
    def parse(value: str) -> Any:
        try:
            return kind(value)
        except ValueError:
            raise argparse.ArgumentTypeError(_message(option, value, allowed)) from None

    return parse


def _truth(value: str) -> bool:
    """Anything but ``true``, in any case, is false."""
    return value.strip().lower() == "true"


@dataclass
class Options:
    """A parsed command line."""

    algorithm: str
    values: argparse.Namespace

    def __getattr__(self, name: str) -> Any:
        return getattr(self.values, name)


@dataclass
class Algorithm:
    """An entry of the command line: its own options, and what it runs."""

    add_options: Callable[[argparse.ArgumentParser], None]
    run: Callable[[SparkSession, DataFrame, Options, Callable[[str], None]], None]
    check: Callable[[argparse.Namespace], None] = lambda values: None
    cnt_only: str = "cnt-only"


def common_options(parser: argparse.ArgumentParser, cnt_only: str) -> None:
    whole, real = "<any integer number>", "<any floating-point number>"

    def add(name: str, kind: Callable[[str], Any], default: Any, text: str) -> None:
        parser.add_argument(f"--{name}", type=kind, default=default, help=text)

    add("spark-master-url", str, "", "Spark master URL")
    parser.add_argument("--use-kryo", action="store_true", help="Whether to use the Kryo serializer")
    add("input-file-name", str, None, "An absolute path, or one relative to the input folder's environment variable")
    add("min-supp", _number(float, "min-supp", real), 0.9, "Minimum support, as a share of all transactions")
    add("input-parts-num", _number(int, "input-parts-num", whole), 2, "Partitions in which the input is read")
    add("persist-input", _truth, False, "Whether to keep the input in memory")
    add("print-intermediate-res", _truth, True, "Whether to print frequent items and progress")
    parser.add_argument(f"--{cnt_only}", dest="cnt_only", type=_truth, default=True, help="Whether to count the itemsets only")
    add("print-all-fis", _truth, False, "Whether to print all frequent itemsets")
    add("sleep-seconds", _number(int, "sleep-seconds", whole), 0, "Seconds to wait at the end")


def report(found: DataFrame, options: Options, say: Callable[[str], None], note: str = "") -> None:
    """Counts, and on request all (items, freq)."""
    say(f"Total results: {found.count()}{note}")
    if options.print_all_fis:
        for row in results.by_size(found).select(patterns.text(F.col("items"), F.col("freq"))).toLocalIterator():
            print(row[0])


def _prologue(transactions: DataFrame, options: Options, say: Callable[[str], None]) -> miners.Run:
    run = miners.start(transactions, options.min_supp)
    say(f"Total records: {run.counts.total}")
    say(f"Min support: {run.counts.min_count}")
    say(f"F1 size = {len(run.encoding)}")
    if options.print_intermediate_res:
        say(str(list(zip(run.encoding.items, run.encoding.freqs))))
    return run


def run_fp_growth(spark: SparkSession, transactions: DataFrame, options: Options, say: Callable[[str], None]) -> None:
    found = fpgrowth.fp_growth(transactions, options.min_supp, options.input_parts_num).persist()
    report(found, options, say)


def fin_options(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--run-type", default=None, help=RUN_TYPES)
    parser.add_argument(
        "--itemset-len-for-seq-processing",
        type=_number(int, "itemset-len-for-seq-processing", "<any integer number>"),
        default=1,
        help="Length of the itemsets below which work is dealt to tasks, '1' for items",
    )


def check_fin(values: argparse.Namespace) -> None:
    if values.run_type not in fin.MODES:
        raise ValueError(_message("run-type", values.run_type, RUN_TYPES))


def run_fin(spark: SparkSession, transactions: DataFrame, options: Options, say: Callable[[str], None]) -> None:
    run = _prologue(transactions, options, say)
    groups = max(options.input_parts_num, spark.sparkContext.defaultParallelism)
    closed = fin.closed(run.encoding, options.run_type, groups, options.itemset_len_for_seq_processing).persist()
    if options.cnt_only:
        say(f"Total results: {closed.agg(subsets.expanded_count()).first()[0]}")
    else:
        report(run.encoding.decode(subsets.expand(closed)).select("items", "freq"), options, say)


def bigfim_options(parser: argparse.ArgumentParser) -> None:
    whole = "<any integer number>"
    parser.add_argument("--start-eclat-prefix-len", type=_number(int, "start-eclat-prefix-len", whole), default=3, help="Prefix length to switch from levels to depth first")
    parser.add_argument(
        "--curr-to-prev-res-ratio-threshold",
        type=_number(float, "curr-to-prev-res-ratio-threshold", "<any floating-point number>"),
        default=1.1,
        help="Growth of a level up to which levels go on",
    )
    parser.add_argument("--eclat-use-diff-sets", type=_truth, default=True, help="Whether to keep differences of sets")
    parser.add_argument("--eclat-use-squeezing", type=_truth, default=False, help="Whether to drop empty columns of classes")
    parser.add_argument("--eclat-parts-num", type=_number(int, "eclat-parts-num", whole), default=None, help="Partitions of the depth-first phase")


def run_bigfim(spark: SparkSession, transactions: DataFrame, options: Options, say: Callable[[str], None]) -> None:
    run = _prologue(transactions, options, say)
    params = bigfim.BigFimParams(
        options.start_eclat_prefix_len,
        options.curr_to_prev_res_ratio_threshold,
        options.eclat_use_diff_sets,
        options.eclat_use_squeezing,
        options.eclat_parts_num,
    )
    result = bigfim.mine(run.encoding, params)
    if options.print_intermediate_res:
        for size, level in enumerate(result.levels, 1):
            named = run.encoding.decode(level).select("items", "freq")
            say(f"F{size} size = {result.sizes[size - 1]}")
            for row in results.top(named, 10).select(patterns.text(F.col("items"), F.col("freq"))).collect():
                print(row[0])
        if result.note:
            say(f"Number of Eclat partitions: {result.note}")
    short, deep = result.counts()
    say(f"Total results: {short + deep} (Apriori: {short}, Eclat: {deep})")
    if options.print_all_fis:
        found = run.encoding.decode(result.all()).select("items", "freq")
        report(found, options, say)


ALGORITHMS: dict[str, Algorithm] = {
    "BIG_FIM": Algorithm(bigfim_options, run_bigfim, cnt_only="eclat-cnt-only"),
    "FIN": Algorithm(fin_options, run_fin, check_fin),
    "FP_GROWTH": Algorithm(lambda parser: None, run_fp_growth),
}


def parse(args: Sequence[str], algorithms: dict[str, Algorithm] = ALGORITHMS) -> Options | None:
    """The options, or None where help was asked for and printed."""
    names = " | ".join(sorted(algorithms))
    if not args or args[0] in ("--help", "-h"):
        example = min(algorithms)
        print(f"Usage: algorithm-name options \n\talgorithm-name = {names}\nFor options try 'algorithm-name --help', e.g.: \n\t{example} --help")
        return None
    if args[0] not in algorithms:
        raise ValueError(f"Unknown algorithm '{args[0]}', supported ones are: {names}")
    algorithm = algorithms[args[0]]
    parser = Parser(prog=args[0], add_help=False, allow_abbrev=False)
    parser.add_argument("--help", action="store_true", help="Print help and quit")
    common_options(parser, algorithm.cnt_only)
    algorithm.add_options(parser)
    values = parser.parse_args(list(args[1:]))
    if values.help:
        parser.print_help()
        return None
    algorithm.check(values)
    if values.print_all_fis and values.cnt_only:
        raise ValueError(f"Contradicting options '--{algorithm.cnt_only} true' and '--print-all-fis true'")
    return Options(args[0], values)


def main(args: Sequence[str] | None = None, algorithms: dict[str, Algorithm] = ALGORITHMS) -> None:
    options = parse(sys.argv[1:] if args is None else args, algorithms)
    if options is None:
        return
    path = resolve_input(options.input_file_name)
    began = time.monotonic()

    def say(text: str) -> None:
        print(f"[{time.monotonic() - began:.1f} s] {text}", flush=True)

    spark = session(options.spark_master_url, options.use_kryo)
    transactions = persisted(read_text(spark, path, options.input_parts_num), options.persist_input)
    algorithms[options.algorithm].run(spark, transactions, options, say)
    if options.sleep_seconds > 0:
        say(f"Computation completed, sleeping for {options.sleep_seconds} seconds as instructed")
        time.sleep(options.sleep_seconds)
