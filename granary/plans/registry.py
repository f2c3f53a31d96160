"""Queries over the warehouse tables, each with the DuckDB SQL of its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import bitsets, patterns, subsets
from granary.operators import apriori, bigfim, eclat, encode, fin, ppc, ranks, results, support, vertical
from granary.plans import miners
from granary.plans.baskets import SQL, baskets, supports
from granary.sources.transactions import parse_items
from granary.storage import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


# DuckDB building blocks.


def _t(name: str, min_supp: float | None = None) -> str:
    """t: distinct pairs; n: the threshold, in double arithmetic."""
    s, sql = SQL[name]
    return f"t as ({sql}), n as (select count(distinct tid) as total, ceil(count(distinct tid) * {min_supp or s}::double)::bigint as m from t)"


def _ranks(name: str) -> str:
    return (
        f"{_t(name)}, f1 as (select item, count(*) as freq from t group by item having count(*) >= (select m from n)),"
        " dict as (select item, freq, (row_number() over (order by freq desc, item) - 1)::int as rank from f1),"
        " enc as (select tid, list(rank order by rank) as r from t join dict using (item) group by tid)"
    )


def _fis(name: str, min_supp: float | None = None) -> str:
    """fi: (items, freq), items ascending."""
    return f"""recursive {_t(name, min_supp)},
f1 as (select item, list(tid order by tid) as tids from t group by item having count(*) >= (select m from n)),
r as (select [item] as items, item as last, tids, len(tids) as freq from f1
  union all select list_append(r.items, f1.item), f1.item, list_intersect(r.tids, f1.tids), len(list_intersect(r.tids, f1.tids))
  from r join f1 on f1.item > r.last where len(list_intersect(r.tids, f1.tids)) >= (select m from n)),
fi as (select items, freq::bigint as freq from r)"""


def _rank_fis(name: str, size: int) -> str:
    """fk: (itemset, freq) of ranks, of one size."""
    froms = ", ".join(f"o o{i}" for i in range(size))
    on = " and ".join(f"o{i}.tid = o{i + 1}.tid and o{i}.rank < o{i + 1}.rank" for i in range(size - 1)) or "true"
    keys = ", ".join(f"o{i}.rank" for i in range(size))
    return f"{_ranks(name)}, o as (select tid, rank from t join dict using (item)), fk as (select [{keys}] as itemset, count(*) as freq from {froms} where {on} group by {keys} having count(*) >= (select m from n))"


#: Ranks, after ``_fis``.
_DICT = "dict as (select item, (row_number() over (order by len(tids) desc, item) - 1)::int as rank from f1)"
FLAT = "select array_to_string(items, ',') as itemset, len(items)::int as k, freq from fi"


def all_fis(name: str) -> str:
    return f"with {_fis(name)} {FLAT}"


# Spark building blocks.


def run_of(spark: SparkSession, sf_dir: str, name: str) -> miners.Run:
    return miners.start(baskets(spark, sf_dir, name).persist(), supports(name))


def mined(name: str, miner: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return results.flat(miners.mine(baskets(spark, sf_dir, name).persist(), supports(name), miner, **options))

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined("order_attr", "BIG_FIM")(spark, sf_dir)


for _name, _basket, _miner, _options in (
    ("fp_growth", "order_attr", "FP_GROWTH", {}),
    ("apriori_all", "order_attr", "APRIORI", {}),
    ("apriori_sparse", "order_brand", "APRIORI", {}),
    ("eclat_tids", "cust_brand", "ECLAT", {"diffsets": False}),
    ("eclat_diffsets", "cust_brand", "ECLAT", {"diffsets": True}),
    ("eclat_squeezed", "cust_brand", "ECLAT", {"diffsets": True, "squeeze": True}),
    ("eclat_split_classes", "cust_brand", "ECLAT", {"class_rows": 100}),
    ("bigfim_sparse", "order_brand", "BIG_FIM", {}),
    ("apriori_many_items", "order_kind", "APRIORI", {}),
    ("eclat_many_items", "order_kind", "ECLAT", {}),
    ("eclat_bit_limit", "order_attr", "ECLAT", {"class_bits": 2000}),
    ("fin_cut_trees", "order_attr", "FIN", {"groups": 4, "tree_cells": 500}),
    ("bigfim_short_prefix", "cust_brand", "BIG_FIM", {"prefix_len": 1}),
    ("fin_par", "order_attr", "FIN", {}),
    ("fin_par_groups", "cust_brand", "FIN", {"groups": 4}),
    ("fin_seq_spark", "cust_brand", "FIN", {"mode": "SEQ_SPARK", "seq_len": 2}),
    ("fin_seq", "user_event", "FIN", {"mode": "SEQ_PURE_JAVA"}),
):
    query(_name, all_fis(_basket))(mined(_basket, _miner, **_options))


@query("bigfim_all", f"with {_fis('order_attr')} select array_to_string(items, ',') as itemset, len(items)::int as k, freq, case when len(items) <= 4 then 'apriori' else 'eclat' end as phase from fi")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, sf_dir, "order_attr")
    found = run.encoding.decode(bigfim.mine(run.encoding).all())
    return found.select(F.array_join("items", ",").alias("itemset"), F.size("items").alias("k"), "freq", "phase")


@query(
    "bigfim_phase_counts",
    f"with {_fis('order_attr')} select case when len(items) <= 4 then 'apriori' else 'eclat' end as phase, count(*) as n, max(len(items))::int as longest from fi group by 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bigfim.mine(run_of(spark, sf_dir, "order_attr").encoding).all()
    return found.groupBy("phase").agg(F.count("*").alias("n"), F.max(F.size("itemset")).alias("longest"))


@query(
    "bigfim_deep_top",
    f"with {_fis('order_attr')}, {_DICT}, named as (select items, freq, (select list(rank order by rank) from dict where list_contains(items, item)) as r from fi where len(items) > 4)"
    " select array_to_string(items, ',') as itemset, len(items)::int as k, freq from named order by freq desc, r limit 10",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, sf_dir, "order_attr")
    return results.flat(run.encoding.decode(bigfim.mine(run.encoding).deep_top(10)))


@query("fin_count_only", f"with {_fis('order_attr')} select count(*) as n from fi")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.closed(run_of(spark, sf_dir, "order_attr").encoding).agg(subsets.expanded_count().alias("n"))


# Sources, parsing, encoding.

_CTRL = "[\\x00-\\x20]+"


@query(
    "tx_parse",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as line_no from documents),
p as (select doc_id, line_no, case when line = '' then [''] when regexp_full_match(line, ' +') then [] else
  list_sort(list_distinct(list_transform(string_split(regexp_replace(line, ' +$', ''), ' '), lambda x: regexp_replace(regexp_replace(x, '^{_CTRL}', ''), '{_CTRL}$', '')))) end as items from l)
select doc_id, line_no, len(items)::int as n_items, array_to_string(items, ' ') as items from p""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line_no"), parse_items(F.col("line")).alias("items")).select(
        "doc_id", "line_no", F.size("items").alias("n_items"), F.array_join("items", " ").alias("items")
    )


@query("tx_count_minsupp", f"with {_t('order_attr')} select total, m as min_count from n")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = support.counts(baskets(spark, sf_dir, "order_attr"), supports("order_attr"))
    return spark.createDataFrame([(counts.total, counts.min_count)], "total long, min_count long")


@query("f1_support", f"with {_ranks('order_attr')} select item, freq from f1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = baskets(spark, sf_dir, "order_attr").persist()
    return encode.item_counts(t, support.counts(t, supports("order_attr")).min_count)


@query("f1_rank", f"with {_ranks('order_attr')} select item, freq, rank from dict")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = baskets(spark, sf_dir, "order_attr").persist()
    return encode.dictionary(encode.item_counts(t, support.counts(t, supports("order_attr")).min_count))


@query("encode_tx", f"with {_ranks('order_attr')} select tid, array_to_string(r, ',') as r from enc")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_of(spark, sf_dir, "order_attr").encoding.encoded()
    return found.where(F.size("r") > 0).select("tid", F.array_join(F.col("r").cast("array<string>"), ",").alias("r"))


@query("tx_patterns", f"with {_ranks('order_attr')} select array_to_string(r, ',') as r, count(*) as w from enc group by r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_of(spark, sf_dir, "order_attr").encoding.patterns().select(F.array_join(F.col("r").cast("array<string>"), ",").alias("r"), "w")


# Levels.


@query("f2_pairs", f"with {_rank_fis('order_attr', 2)} select itemset[1] as r1, itemset[2] as r2, freq from fk")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, sf_dir, "order_attr")
    return apriori.pair_counts(run.encoding.patterns(), run.encoding.min_count)


def _level(spark: SparkSession, sf_dir: str, name: str, size: int) -> tuple[miners.Run, apriori.Levels]:
    run = run_of(spark, sf_dir, name)
    levels = apriori.Levels(run.encoding, Scratch(spark, "levels"))
    levels.step()
    while levels.size < size:
        levels.advance()
        levels.step()
    return run, levels


@query("f3_triples", f"with {_rank_fis('order_attr', 3)} select array_to_string(itemset, ',') as itemset, freq from fk")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, levels = _level(spark, sf_dir, "order_attr", 3)
    return levels.levels[-1].select(F.array_join(F.col("itemset").cast("array<string>"), ",").alias("itemset"), "freq")


@query(
    "apriori_candidates_k3",
    f"""with {_rank_fis('order_attr', 2)}, c as (select [a.itemset[1], a.itemset[2], b.itemset[2]] as i from fk a join fk b on a.itemset[1] = b.itemset[1] and a.itemset[2] < b.itemset[2])
select array_to_string(i, ',') as itemset from c where [i[2], i[3]] in (select itemset from fk)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, levels = _level(spark, sf_dir, "order_attr", 2)
    return apriori.candidates(levels.levels[-1]).select(F.array_join(F.col("itemset").cast("array<string>"), ",").alias("itemset"))


@query("f2_ranked", f"with {_rank_fis('order_attr', 2)} select itemset[1] as r1, itemset[2] as r2, freq, (row_number() over (order by freq desc, itemset) - 1)::int as rank from fk")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, sf_dir, "order_attr")
    return ranks.ranked(apriori.pair_counts(run.encoding.patterns(), run.encoding.min_count), "r1", "r2")


@query("level_counts", f"with {_fis('cust_brand')} select len(items)::int as k, count(*) as n from fi group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.level_counts(miners.mine(baskets(spark, sf_dir, "cust_brand").persist(), supports("cust_brand"), "BIG_FIM"))


# Vertical layout.

_TIDS = f"{_rank_fis('order_attr', 2)}, tids as (select k.itemset, a.tid from fk k join o a on a.rank = k.itemset[1] join o b on b.rank = k.itemset[2] and a.tid = b.tid)"


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, levels = _level(spark, sf_dir, "order_attr", 2)
    return vertical.occurrences(run.encoding.encoded(), levels.levels[-1], 2)


@query("tidset_stats", f"with {_TIDS} select array_to_string(itemset, ',') as itemset, count(*) as size, min(tid) as min, max(tid) as max from tids group by itemset")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical.describe(_occurrences(spark, sf_dir)).select(F.array_join(F.col("itemset").cast("array<string>"), ",").alias("itemset"), "size", "min", "max")


@query("tid_bitmaps", f"with {_TIDS} select array_to_string(itemset, ',') as itemset, count(*) as freq from tids group by itemset")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vertical.bitmap_support(vertical.merge_bitmaps(vertical.tid_bitmaps(_occurrences(spark, sf_dir))))
    return found.select(F.array_join(F.col("itemset").cast("array<string>"), ",").alias("itemset"), "freq")


@query("tid_lists", f"with {_TIDS} select array_to_string(itemset, ',') as itemset, md5(string_agg(tid::varchar, ',' order by tid)) as tids from tids group by itemset")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vertical.tid_lists(_occurrences(spark, sf_dir))
    return found.select(F.array_join(F.col("itemset").cast("array<string>"), ",").alias("itemset"), F.md5(F.array_join(F.col("tids").cast("array<string>"), ",")).alias("tids"))


@query(
    "prefix_classes",
    f"with {_rank_fis('order_attr', 3)} select itemset[1]::varchar || ',' || itemset[2]::varchar as prefix, string_agg(itemset[3]::varchar, ',' order by itemset[3]) as members, string_agg(freq::varchar, ',' order by itemset[3]) as freqs from fk group by itemset[1], itemset[2]",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, levels = _level(spark, sf_dir, "order_attr", 3)
    return vertical.prefix_classes(levels.levels[-1]).select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("prefix", "members", "freqs")])


@query(
    "eclat_class_stats",
    f"with {_ranks('order_attr')}, o as (select r[i]::varchar as itemset, r[i + 1:] as tail from (select r, unnest(range(1, len(r) + 1)) as i from enc))"
    " select itemset, count(distinct tail) as n_tails, count(*) as n_transactions, max(len(tail))::int as longest from o where len(tail) > 0 group by itemset",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apriori.first_occurrences(run_of(spark, sf_dir, "order_attr").encoding.patterns())
    return eclat.class_stats(rows).select(F.array_join(F.col("itemset").cast("array<string>"), ",").alias("itemset"), "n_tails", "n_transactions", "longest")


# Prefix trees.

_COND = f"{_ranks('order_attr')}, g as (select unnest([0, 1, 2]) as gid), cond as (select gid, tid, r[1:list_max(list_transform(range(1, len(r) + 1), lambda i: case when r[i] % 3 = gid then i else 0 end))] as r from enc, g)"
_NODES = "nodes as (select r[1:i] as prefix, count(*) as cnt from (select r, unnest(range(1, len(r) + 1)) as i from enc) group by 1)"
_TREE = f"""{_ranks('order_attr')}, {_NODES},
tree as (select a.prefix, a.cnt, 1 + row_number() over (order by a.prefix) as pre, (select count(*) from nodes b where b.prefix[1:len(a.prefix)] = a.prefix) as size from nodes a)"""


@query("cond_transactions", f"with {_COND} select gid, array_to_string(r, ',') as r, count(*) as w from cond where len(r) > 0 group by gid, r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppc.conditional(run_of(spark, sf_dir, "order_attr").encoding.patterns(), 3)
    return found.select("gid", F.array_join(F.col("r").cast("array<string>"), ",").alias("r"), "w")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_of(spark, sf_dir, "order_attr").encoding.patterns()
    return ppc.tree(rows.select(F.lit(0).alias("gid"), "r", "w"))


@query("ppc_nodes", f"with {_TREE} select array_to_string(prefix, ',') as prefix, prefix[-1] as item, cnt, pre, pre - len(prefix) + size - 1 as post from tree")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select(F.array_join(F.col("prefix").cast("array<string>"), ",").alias("prefix"), "item", "cnt", "pre", "post")


@query(
    "item_nodesets",
    f"with {_TREE} select prefix[-1] as item, string_agg(pre || ':' || (pre - len(prefix) + size - 1) || ':' || cnt, ' ' order by pre) as nodes, sum(cnt)::bigint as freq from tree group by 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat_ws(":", n.pre.cast("string"), n.post.cast("string"), n.cnt.cast("string"))), " ")
    return ppc.item_nodes(_tree(spark, sf_dir)).select("item", nodes.alias("nodes"), "freq")


@query(
    "pair_diffnodesets",
    f"with {_ranks('order_attr')}, o as (select tid, rank from t join dict using (item)), p as (select a.rank as x, b.rank as y from dict a join dict b on b.rank < a.rank) select x, y, (select count(*) from o c join o d on c.tid = d.tid where c.rank = x and d.rank = y) as freq from p",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, sf_dir, "order_attr")
    nodes = ppc.tree(ppc.conditional(run.encoding.patterns(), 3))
    return ppc.pair_supports(nodes, run.encoding.singles(), 3)


@query("ppc_merge", f"with {_ranks('order_attr')}, {_NODES} select array_to_string(prefix, ',') as prefix, 2 * cnt as cnt from nodes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    return ppc.merge(tree, tree).select(F.array_join(F.col("prefix").cast("array<string>"), ",").alias("prefix"), "cnt")


# Results.


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return miners.mine(baskets(spark, sf_dir, "cust_brand").persist(), supports("cust_brand"), "ECLAT")


_CUST = _fis("cust_brand")


@query(
    "fi_union_sum",
    f"with {_CUST} select array_to_string(items, ',') as itemset, len(items)::int as k, sum(freq)::bigint as freq from (select items, freq from fi union all select items, freq from fi where len(items) <= 2) group by items",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    return results.flat(results.unite(found, found.where(F.size("items") <= 2)))


@query("fi_top_k", f"with {_CUST} {FLAT} order by freq desc, items limit 25")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.flat(results.top(_found(spark, sf_dir), 25))


@query("fi_by_length", f"with {_CUST} {FLAT} where len(items) = 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.flat(results.of_length(_found(spark, sf_dir), 2))


@query("fi_contains", f"with {_CUST} {FLAT} where list_contains(items, 'Brand#11')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.flat(results.containing(_found(spark, sf_dir), "Brand#11"))


@query("fi_pretty", f"with {_CUST} select 'FI: [' || array_to_string(items, ', ') || ']: ' || freq as line from fi")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select(patterns.text(F.col("items"), F.col("freq")).alias("line"))


@query(
    "fi_ordered",
    f"with {_CUST} select line, (row_number() over (order by k desc, line))::int as place from (select 'FI: [' || array_to_string(items, ', ') || ']: ' || freq as line, len(items) as k from fi)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = patterns.text(F.col("items"), F.col("freq"))
    rows = _found(spark, sf_dir).select(line.alias("line"), F.size("items").alias("k"))
    # A report: its place numbers are what is asked for.
    return rows.select("line", F.row_number().over(W.orderBy(F.desc("k"), "line")).alias("place"))


@query("fi_prefix", f"with {_CUST} {FLAT} where items[1:1] = ['Brand#12']")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.flat(_found(spark, sf_dir).where(patterns.starts_with(F.col("items"), F.array(F.lit("Brand#12")))))


# Functions.


@query(
    "equiv_expand",
    "with e as (select c_custkey as id, (c_custkey % 6)::int as n from customer), m as (select id, n, unnest(range(0, (1 << n)::bigint)) as m from e)"
    " select id, array_to_string(list_concat([0], list_filter(range(1, n + 1), lambda i: ((m >> (i - 1)) & 1) = 1)), ',') as itemset from m",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod("c_custkey", F.lit(6)).cast("int")
    some = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.array(F.lit(0)).alias("base"), some.alias("equiv"), F.col("c_custkey").alias("freq"))
    return subsets.expand(rows).select(F.col("freq").alias("id"), F.array_join(F.col("itemset").cast("array<string>"), ",").alias("itemset"))


@query(
    "subsets_n",
    "select n_nationkey as id, m as mask, bit_count(m)::int as size from nation, lateral (select unnest(range(0, (1 << (n_nationkey % 8)::int)::bigint)) as m)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod("n_nationkey", F.lit(8)).cast("int")
    items = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), items.alias("items"))
    found = subsets.subsets(rows, "items")
    mask = F.aggregate("subset", F.lit(0).cast("long"), lambda s, i: s + F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return found.select("id", mask.alias("mask"), F.size("subset").alias("size"))


@query(
    "bitset_ops",
    """with b as (select p_partkey as id, list_sort(list_distinct([p_partkey % 192, p_size, p_partkey * 7 % 192])) as a, list_sort(list_distinct([p_size, p_partkey % 64])) as b from part),
u as (select id, a, b, list_sort(list_intersect(a, b)) as i, list_sort(list_distinct(list_concat(a, b))) as o, list_filter(a, lambda x: not list_contains(b, x)) as d from b)
select id, len(a)::bigint as n_a, a[1]::bigint as lo, a[-1]::bigint as hi, array_to_string(a, ',') as numbers, array_to_string(i, ',') as both, array_to_string(o, ',') as either, array_to_string(d, ',') as minus,
  (192 - len(o) + len(i))::bigint as n_same, (128 - len(list_filter(a, lambda x: x < 128)) + len(list_filter(a, lambda x: x >= 128)))::bigint as n_flip, list_contains(a, 64) as has_64 from u""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    a = bitsets.set_all(bitsets.empty(192), F.array(key % 192, size, key * 7 % 192))
    b = bitsets.set_all(bitsets.empty(192), F.array(size, key % 64))
    rows = part.select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")

    def numbers(words: Column) -> Column:
        return F.array_join(bitsets.as_numbers(words).cast("array<string>"), ",")

    return rows.select(
        "id",
        bitsets.cardinality(a).alias("n_a"),
        bitsets.lowest(a).alias("lo"),
        bitsets.highest(a).alias("hi"),
        numbers(a).alias("numbers"),
        numbers(bitsets.both(a, b)).alias("both"),
        numbers(bitsets.either(a, b)).alias("either"),
        numbers(bitsets.minus(a, b)).alias("minus"),
        bitsets.cardinality(bitsets.same(a, b)).alias("n_same"),
        bitsets.cardinality(bitsets.flip(a, 127)).alias("n_flip"),
        bitsets.get(a, F.lit(64)).alias("has_64"),
    )


from granary.plans import surfaces  # noqa: E402, F401  registers more queries, which use what is above
