"""Miners by name.  A miner takes transactions and a support ratio and returns
(items, freq); others can be registered."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame

from granary.operators import apriori, bigfim, eclat, encode, fin, fpgrowth, support
from granary.storage import Scratch


class Miner(Protocol):
    def __call__(self, transactions: DataFrame, min_supp: float, **options: Any) -> DataFrame: ...


@dataclass
class Run:
    """What every miner but FP-Growth starts with."""

    counts: support.Counts
    encoding: encode.Encoding


def start(transactions: DataFrame, min_supp: float) -> Run:
    counts = support.counts(transactions, min_supp)
    return Run(counts, encode.Encoding(transactions, counts.min_count))


def _decoded(run: Run, found: DataFrame) -> DataFrame:
    return run.encoding.decode(found.select("itemset", "freq")).select("items", "freq")


def mine_apriori(transactions: DataFrame, min_supp: float, **options: Any) -> DataFrame:
    run = start(transactions, min_supp)
    return _decoded(run, apriori.apriori(run.encoding, options.get("max_size")))


def mine_eclat(transactions: DataFrame, min_supp: float, **options: Any) -> DataFrame:
    run = start(transactions, min_supp)
    rows = Scratch(transactions.sparkSession, "eclat").save(apriori.first_occurrences(run.encoding.patterns()), "rows")
    deep = eclat.eclat(rows, run.encoding.min_count, **{"diffsets": True, **options})
    return _decoded(run, run.encoding.singles().unionByName(deep))


def mine_bigfim(transactions: DataFrame, min_supp: float, **options: Any) -> DataFrame:
    run = start(transactions, min_supp)
    return _decoded(run, bigfim.mine(run.encoding, bigfim.BigFimParams(**options)).all())


def mine_fin(transactions: DataFrame, min_supp: float, **options: Any) -> DataFrame:
    run = start(transactions, min_supp)
    return _decoded(run, fin.fin(run.encoding, **options))


def mine_fp_growth(transactions: DataFrame, min_supp: float, **options: Any) -> DataFrame:
    return fpgrowth.fp_growth(transactions, min_supp, **options)


MINERS: dict[str, Miner] = {
    "APRIORI": mine_apriori,
    "BIG_FIM": mine_bigfim,
    "ECLAT": mine_eclat,
    "FIN": mine_fin,
    "FP_GROWTH": mine_fp_growth,
}


def mine(transactions: DataFrame, min_supp: float, miner: str = "BIG_FIM", **options: Any) -> DataFrame:
    """(items, freq) of all itemsets in at least ceil(N x min_supp) of the N
    transactions."""
    if miner not in MINERS:
        raise ValueError(f"Unknown algorithm '{miner}', supported ones are: {' | '.join(MINERS)}")
    return MINERS[miner](transactions, min_supp, **options)
