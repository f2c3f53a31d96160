"""Queries over text input, the command line, number structures, orders and
functions, each with the DuckDB SQL of its rows."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import cli
from granary.functions import bitsets, patterns, subsets
from granary.operators import apriori, eclat, encode, ppc, ranks, results, vertical
from granary.plans import miners
from granary.plans.baskets import baskets, supports
from granary.plans.registry import _CUST, _DICT, _TREE, _fis, _found, _level, _rank_fis, _ranks, _t, _tree, query, run_of
from granary.session import session
from granary.sources.transactions import numbered, of_arrays, parse_lines, persisted, read_text, resolve_input
from granary.storage import Scratch


def _joined(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


# Text input.


def _lines(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A text file of a basket's transactions, one per line."""
    path = f"{Scratch(spark, 'lines').root}/{name}.txt"
    baskets(spark, sf_dir, name).select(F.array_join("items", " ").alias("value")).write.text(path)
    return path


@query(
    "tx_read_text",
    f"with {_t('order_brand')}, l as (select array_to_string(list(item order by item), ' ') as items, count(*)::int as n_items from t group by tid) select items, n_items, count(*) as n from l group by items, n_items",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = persisted(read_text(spark, resolve_input(_lines(spark, sf_dir, "order_brand")), 3), False)
    return rows.groupBy(F.array_join("items", " ").alias("items"), F.size("items").alias("n_items")).agg(F.count_distinct("tid").alias("n"))


@query(
    "tx_parse_table",
    "with l as (select unnest(string_split(text, chr(10))) as line from documents)"
    " select count(*) as n, count(*) filter (line = '') as empty, count(*) filter (regexp_full_match(line, ' +')) as blank from l",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line")), "line")
    own = F.col("items")
    return rows.agg(
        F.count_distinct("tid").alias("n"), F.count_if((F.size(own) == 1) & (F.get(own, F.lit(0)) == "")).alias("empty"), F.count_if(F.size(own) == 0).alias("blank")
    )


@query("tx_of_arrays", f"with {_t('user_event')} select tid, array_to_string(list(item order by item), ',') as items from t group by tid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.collect_list("event_type").alias("kinds"))
    return of_arrays(rows, "user_id", "kinds").select("tid", _joined("items"))


@query("session_settings", "select 'spark.sql.session.timeZone' as key, 'UTC' as value")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "spark.sql.session.timeZone"
    return spark.createDataFrame([(key, session().conf.get(key))], "key string, value string")


@query("tx_dense_tids", f"with {_t('order_brand')} select count(distinct tid) as n, 0::bigint as lo, (count(distinct tid) - 1)::bigint as hi, count(distinct tid) as numbers from t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(read_text(spark, _lines(spark, sf_dir, "order_brand"), 5))
    return rows.agg(F.count("*").alias("n"), F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.count_distinct("tid").alias("numbers"))


# The command line.


def _printed(spark: SparkSession, sf_dir: str, name: str, algorithm: str, *args: str) -> list[str]:
    """The lines that the command line prints for a basket, without their times."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main([algorithm, "--input-file-name", _lines(spark, sf_dir, name), "--min-supp", str(supports(name)), *args])
    spark.sparkContext.setLogLevel("ERROR")
    return [re.sub(r"^\[[0-9.]+ s\] ", "", line) for line in out.getvalue().splitlines()]


_SHOWN = "'FI: [' || array_to_string(items, ', ') || ']: ' || freq"


@query(
    "cli_fin",
    f"with {_fis('user_event')}, l as (select 0 as place, 'Total records: ' || total as line from n union all select 1, 'Min support: ' || m from n union all select 2, 'F1 size = ' || count(*) from f1"
    f" union all select 3, 'Total results: ' || count(*) from fi union all select 3 + row_number() over (order by len(items) desc, {_SHOWN}), {_SHOWN} from fi) select place::int as place, line from l",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _printed(spark, sf_dir, "user_event", "FIN", "--run-type", "PAR_SPARK", "--cnt-only", "false", "--print-all-fis", "true", "--print-intermediate-res", "false")
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


@query(
    "cli_bigfim",
    f"with {_fis('user_event')}, k as (select len(items) as k, count(*) as n from fi group by 1),"
    f" best as (select len(items) as k, {_SHOWN} as line, row_number() over (partition by len(items) order by freq desc, items) as p from fi)"
    " select 'F' || k || ' size = ' || n as line from k union all select line from best where p <= 10"
    " union all select 'Total results: ' || count(*) || ' (Apriori: ' || count(*) || ', Eclat: 0)' from fi",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _printed(spark, sf_dir, "user_event", "BIG_FIM", "--eclat-cnt-only", "true")
    kept = [x for x in lines if re.match(r"F\d+ size = .*|FI: |Total results", x)]
    # The first is the prologue's size of F1, which the levels give again.
    return spark.createDataFrame([(x,) for x in kept[1:]], "line string")


@query("cli_fp_growth", f"with {_fis('user_event')} select 'Total results: ' || count(*) as line from fi")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _printed(spark, sf_dir, "user_event", "FP_GROWTH")], "line string")


@query(
    "cli_messages",
    "select unnest([$$Unknown algorithm 'X', supported ones are: BIG_FIM | FIN | FP_GROWTH$$, $$Contradicting options '--cnt-only true' and '--print-all-fis true'$$, $$Missing mandatory option '--input-file-name'$$]) as said",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = []
    for args in (["X"], ["FP_GROWTH", "--print-all-fis", "true"], ["FP_GROWTH"]):
        try:
            cli.main(args)
        except ValueError as e:
            said.append((str(e),))
    return spark.createDataFrame(said, "said string")


# Dictionaries that are joined.


@query("encode_broadcast", f"with {_ranks('order_kind')} select tid, array_to_string(r, ',') as r from enc")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, sf_dir, "order_kind")
    found = encode.Encoding(run.encoding.transactions, run.counts.min_count, inline=0).encoded()
    return found.where(F.size("r") > 0).select("tid", _joined("r"))


@query(
    "encode_shuffled",
    f"with {_ranks('order_kind')}, o as (select tid, unnest(r) as rank from enc) select tid, array_to_string(list(item order by item), ',') as items from o join dict using (rank) group by tid",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back by shuffles, as for dictionaries beyond the broadcast limit."""
    run = run_of(spark, sf_dir, "order_kind")
    own = encode.Encoding(run.encoding.transactions, run.counts.min_count, inline=0, broadcast=0)
    found = own.decode(own.encoded().where(F.size("r") > 0).withColumnRenamed("r", "itemset"))
    return found.select("tid", _joined("items"))


# Numbers of itemsets.

_RANKED = "(row_number() over (order by freq desc, itemset) - 1)::int as rank"
_BOTH = (
    f"{_rank_fis('order_attr', 3)}, f2 as (select [a.rank, b.rank] as itemset, count(*) as freq from o a join o b on a.tid = b.tid and a.rank < b.rank group by a.rank, b.rank having count(*) >= (select m from n)),"
    f" r2 as (select itemset, freq, {_RANKED} from f2), r3 as (select itemset, freq, {_RANKED} from fk)"
)
_PAIRS = f"{_rank_fis('order_attr', 2)}, p as (select itemset[1] as elem1, itemset[2] as elem2, {_RANKED} from fk)"


def _ranked_levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, levels = _level(spark, sf_dir, "order_attr", 3)
    return ranks.ranked(levels.levels[1], "itemset"), ranks.ranked(levels.levels[2], "itemset")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, sf_dir, "order_attr")
    found = ranks.ranked(apriori.pair_counts(run.encoding.patterns(), run.encoding.min_count), "r1", "r2")
    return Scratch(spark, "pairs").save(found.select(F.col("r1").alias("elem1"), F.col("r2").alias("elem2"), "rank"), "pairs")


@query("fi_rank_split", f"with {_BOTH} select r3.rank as rank, r3.itemset[1] as item, r2.rank as rest_rank from r3 join r2 on r2.itemset = r3.itemset[2:]")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    two, three = _ranked_levels(spark, sf_dir)
    return ranks.split(three, two)


@query(
    "fi_rank_levels",
    f"with {_BOTH} select 2 as k, rank, array_to_string(itemset, ',') as itemset, freq from r2 union all select 3, rank, array_to_string(itemset, ','), freq from r3",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    two, three = _ranked_levels(spark, sf_dir)
    return two.withColumn("k", F.lit(2)).unionByName(three.withColumn("k", F.lit(3))).select("k", "rank", _joined("itemset"), "freq")


@query("pair_partners", f"with {_PAIRS} select elem1, string_agg(elem2::varchar, ',' order by elem2) as elems2 from p group by elem1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.partners(_pairs(spark, sf_dir)).select("elem1", _joined("elems2"))


@query("pair_extremes", f"with {_PAIRS} select max(elem1) as max1, max(elem2) as max2, count(*) as n from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.extremes(_pairs(spark, sf_dir))


@query(
    "pair_lookups",
    f"with {_PAIRS}, q as (select unnest([0, 1, 2, 900]) as a, unnest([1, 5, 2, 901]) as b) select a, b, exists (select 1 from p where elem1 = a and elem2 = b) as is_pair,"
    " coalesce((select rank from p where elem1 = a and elem2 = b), -1) as rank, coalesce((select elem1 || ',' || elem2 from p where rank = a), 'none') as pair_of_a from q",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, rows = _pairs(spark, sf_dir), []
    for a, b in ((0, 1), (1, 5), (2, 2), (900, 901)):
        own = ranks.pair_of(pairs, a)
        rows.append((a, b, ranks.exists_pair(pairs, a, b), ranks.rank_of(pairs, a, b), ",".join(map(str, own)) if own else "none"))
    return spark.createDataFrame(rows, "a int, b int, is_pair boolean, rank int, pair_of_a string")


@query(
    "eclat_partitions",
    f"with {_rank_fis('order_attr', 2)}, p as (select count(distinct itemset[1]) as n from fk)"
    " select least(n, 6, 4)::int as parts, least(n, 6, 4) || ' = min(prefixes=' || n || ', processors=6, user-prop=4)' as said from p",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, levels = _level(spark, sf_dir, "order_attr", 2)
    n, said = vertical.partitions_for(vertical.prefix_classes(levels.levels[-1]).count(), 6, 4)
    return spark.createDataFrame([(n, said)], "parts int, said string")


@query(
    "tids_or_complement",
    f"with {_ranks('order_attr')}, o as (select tid, unnest(r) as rank from enc), every as (select count(*) as n from enc), s as (select rank, count(*) as freq from o group by rank)"
    " select rank::varchar as itemset, 2 * freq > n as complement, (case when 2 * freq > n then n - freq else freq end)::int as n_stored, freq::int as freq, true as whole from s, every",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tids")
    encoded = scratch.save(run_of(spark, sf_dir, "order_attr").encoding.encoded().where(F.size("r") > 0), "encoded")
    rows = numbered(encoded).select("tid", F.explode("r").alias("rank"))
    lists = scratch.save(vertical.tid_lists(rows.select(F.array("rank").alias("itemset"), "tid")), "lists")
    total = encoded.count()
    kept = scratch.save(vertical.stored(lists, total), "stored")
    back = vertical.restored(kept, total).select("itemset", F.array_sort("tids").alias("back"))
    every = kept.select("itemset", "complement", F.size("tids").alias("n_stored")).join(lists, "itemset").join(back, "itemset")
    return every.select(_joined("itemset"), "complement", "n_stored", F.size("tids").alias("freq"), (F.col("tids") == F.col("back")).alias("whole"))


@query("tid_extremes", f"with {_t('user_event')} select min(tid) as lo, max(tid) as hi from t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical.partition_extremes(baskets(spark, sf_dir, "user_event")).agg(F.min("min").alias("lo"), F.max("max").alias("hi"))


@query(
    "eclat_by_prefix",
    f"with {_rank_fis('order_attr', 3)} select array_to_string(itemset, ',') as itemset, (row_number() over (order by itemset))::int as place from fk",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, sf_dir, "order_attr")
    rows = Scratch(spark, "eclat").save(apriori.first_occurrences(run.encoding.patterns()), "rows")
    found = eclat.eclat(rows, run.encoding.min_count).where(F.size("itemset") == 3)
    lines = results.local(results.by_prefix(found).select(_joined("itemset")))
    return spark.createDataFrame([(r[0], i) for i, r in enumerate(lines, 1)], "itemset string, place int")


@query("ppc_lookup", f"with {_TREE} select array_to_string(prefix, ',') as prefix, cnt, pre from tree where prefix in ([0], [0, 1], [1, 2])")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _tree(spark, sf_dir)
    found = ppc.node_at(nodes, 0)
    for path in ((0, 1), (1, 2), (900,)):
        found = found.unionByName(ppc.node_at(nodes, *path))
    return found.select(_joined("prefix"), "cnt", "pre")


# Orders and text forms.


def _report(spark: SparkSession, ordered: DataFrame) -> DataFrame:
    """An ordered result as printed: its lines and their places."""
    lines = results.local(ordered.select(patterns.text(F.col("items"), F.col("freq"))))
    return spark.createDataFrame([(row[0], i) for i, row in enumerate(lines, 1)], "line string, place int")


@query("fi_by_size", f"with {_CUST} select line, (row_number() over (order by k desc, line))::int as place from (select {_SHOWN} as line, len(items) as k from fi)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, results.by_size(_found(spark, sf_dir)))


@query(
    "fi_by_frequency",
    f"with {_CUST} select line, (row_number() over (order by freq desc, k desc, line))::int as place from (select {_SHOWN} as line, len(items) as k, freq from fi)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, results.by_frequency(_found(spark, sf_dir)))


@query("fi_first", f"with {_CUST} select least(count(*), 7) as n from fi")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.first(_found(spark, sf_dir), 7).agg(F.count("*").alias("n"))


@query("fi_union_counts", f"with {_CUST} select (2 * count(*) + count(*) filter (len(items) <= 2))::bigint as n from fi")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).persist()
    n = results.unite_counts(found, found.where(F.size("items") <= 2), found)
    found.unpersist()
    return spark.createDataFrame([(n,)], "n long")


def _padded(x: str, n: str) -> str:
    return f"(case when len({x}) >= {n} then {x} else rpad({x}, {n}, ' ') end)"


@query(
    "fi_padded",
    f"with {_fis('user_event')}, {_DICT},"
    " w as (select items, freq, (select list(rank order by item) from dict where list_contains(items, item)) as rk, (select max(len(items)) from fi) as n from fi),"
    " c as (select freq, floor(n * 4.5 + 2)::int as wide, floor(n * 3.5 + 2)::int as narrow, '[' || array_to_string(items, ', ') || ']' as a, '[' || array_to_string(rk, ', ') || ']' as b, '[' || array_to_string(list_sort(rk), ', ') || ']' as c from w)"
    f" select {_padded('a', 'wide')} || ' ' || {_padded('b', 'narrow')} || ' ' || {_padded('c', 'narrow')} || ': ' || freq as line from c",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, sf_dir, "user_event")
    found = miners.mine(run.encoding.transactions, supports("user_event"), "APRIORI")
    known = F.array(*map(F.lit, run.encoding.items))
    own = F.transform("items", lambda x: (F.array_position(known, x) - 1).cast("int"))
    longest = found.agg(F.max(F.size("items"))).first()[0] or 0
    return found.select(patterns.text_with_ranks(F.col("items"), own, F.col("freq"), longest).alias("line"))


@query(
    "fi_common_prefix",
    f"with {_CUST} select array_to_string(a.items, ',') as a, array_to_string(b.items, ',') as b from fi a join fi b on len(a.items) = 2 and len(b.items) = 2 and a.items[1:1] = b.items[1:1] and a.items[2] < b.items[2]",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = results.of_length(_found(spark, sf_dir), 2)
    a, b = (two.select(F.col("items").alias(x), F.col("items")[0].alias("head")) for x in "ab")
    met = a.join(b, "head").where(patterns.common_prefix(F.col("a"), F.col("b"), 1) & (F.col("a")[1] < F.col("b")[1]))
    return met.select(_joined("a"), _joined("b"))


# Functions.


@query(
    "subsets_of_size",
    "select n_nationkey as id, m as mask, bit_count(m)::int as size, 1::bigint << (n_nationkey % 8)::int as every"
    " from nation, lateral (select unnest(range(0, (1 << (n_nationkey % 8)::int)::bigint)) as m) where bit_count(m) = 3",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod("n_nationkey", F.lit(8)).cast("int")
    items = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), items.alias("items"))
    mask = F.aggregate("subset", F.lit(0).cast("long"), lambda s, i: s + F.call_function("shiftleft", F.lit(1).cast("long"), i))
    every = F.create_map(*[x for k in range(8) for x in (F.lit(k), F.lit(subsets.number_of_subsets(k)).cast("long"))])
    return subsets.subsets(rows, "items", 3).select("id", mask.alias("mask"), F.size("subset").alias("size"), every[F.size("items")].alias("every"))


@query(
    "bitset_words",
    """with b as (select p_partkey as id, case when p_partkey % 3 = 0 then []::bigint[] else list_sort(list_distinct([p_partkey % 192, p_size, p_partkey * 7 % 192])) end as a from part)
select id, len(a) = 0 as zero, array_to_string(list_filter(a, lambda x: x >= 64 and x < 128), ',') as second, 192::int as bits, 4::int as words, 3::int as at_130, (id % 192 - id % 64)::bigint as begins from b""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitsets that begin at word 1 of an array, as behind a header."""
    key, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    some = F.when(key % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(key % 192, size, key * 7 % 192))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("id"), bitsets.set_all(bitsets.empty(192, 1), some, 1).alias("a"))
    a = F.col("a")
    return rows.select(
        "id",
        bitsets.is_zero(a, 1).alias("zero"),
        F.array_join(bitsets.word_numbers(a, 2, 1).cast("array<string>"), ",").alias("second"),
        bitsets.total_bits(a, 1).cast("int").alias("bits"),
        F.lit(bitsets.words_for(192, 1)).alias("words"),
        F.lit(bitsets.word_index(130, 1)).alias("at_130"),
        bitsets.word_start(F.col("id") % 192).alias("begins"),
    )
