"""Secret scans through an incremental blob ledger.

Every version of every document is content-addressed by the SHA-256 of its
text.  A ledger in shared storage keeps all distinct texts ever added, in
generations, the findings of all scans, and a manifest of which (generation,
rule, rule version) is done.  So a (blob, rule version) pair is known as scanned,
hits or none, without a row of its own; a run adds only texts that the ledger
lacks, scans only pairs that the manifest lacks, and joins findings back to all
paths.  The manifest is written after what it speaks of: what a failed run left
does not count.

Everything is DataFrame expressions: copies of a blob collapse on the map side
before the one shuffle that moves texts, and the join back carries only hashes,
so that a blob which a third of the paths share costs one scan and a join that
adaptive execution can split.

Defined results: a null text is the empty blob and has no findings; repeated
rows each get their row; a null doc_id stays null; other columns are ignored
by ``scan`` and kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.shared import Scratch, fresh, text_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost and without overlap; a match counts if
    its ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# The base kinds, in the order in which spans are listed.
# Runs shorter than the limit are left out of the access and hex patterns
# themselves: a match is a maximal run, so that changes no other match.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Kinds that the ledger's rule table adds.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
)
RULES = BASE + EXTRA

SPAN = "array<struct<start:int,end:int>>"
FOUND = f"array<struct<rule:string,version:int,spans:{SPAN}>>"


#: Matches whose places are summed in one go: the work for n matches of a text is about n x STEP.
STEP = 256


def located(sizes: Column) -> Column:
    """Matches with their places, from the gap before each and its length."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, x: s + x.gap + x.len)

    def begins(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(parts, start, lambda s, p: F.struct((s.at + total(p)).alias("at"), F.array_append(s.out, s.at).alias("out"))).out

    def walk(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)").alias("out"))
        return F.aggregate(
            part,
            start,
            lambda s, x: F.struct(
                (s.at + x.gap + x.len).alias("at"),
                F.array_append(s.out, F.struct((s.at + x.gap).alias("start"), (s.at + x.gap + x.len).alias("end"), x.hit.alias("hit"))).alias("out"),
            ),
        ).out

    def cut(own: Column) -> Column:
        last = F.floor((F.size(own) - 1) / STEP).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(own, j * STEP + 1, F.lit(STEP)))

    # Arrays of one element bind what is used twice, so that it is computed once.
    parts = F.transform(F.array(sizes), cut)
    return F.transform(parts, lambda p: F.flatten(F.zip_with(p, begins(p), walk)))[0]


def spans(text: Column, rule: Rule) -> Column:
    """Code-point spans of the rule's matches, end exclusive.

    Built-in functions return matches without places, so the places come from
    the lengths of the pieces between matches and of the matches themselves.
    """
    pieces = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(
        F.array(hits),
        lambda own: F.zip_with(F.slice(pieces, 1, F.size(own)), own, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("len"), h.alias("hit"))),
    )[0]
    kept = F.filter(located(sizes), lambda x: F.length(F.regexp_extract(x.hit, f"^(?:{rule.pattern})$", rule.group)) >= rule.least)
    plain = F.transform(kept, lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
    return F.when(text.rlike(rule.pattern), plain).otherwise(F.expr(f"cast(array() as {SPAN})"))


class Ledger:
    """Blobs, findings and the manifest under one folder that all executors
    reach; without a folder, one that goes with the session."""

    MANIFEST = "gen string, rule string, version int, run string"

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.scratch = Scratch(spark, "ledger")
        self.root = root or self.scratch.root
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> list:
        """(gen, rule, version, run) of all that is done; a row without rule
        for each generation.  Runs x rules rows."""
        where = f"{self.root}/manifest"
        return self.spark.read.schema(self.MANIFEST).parquet(where).collect() if self.fs.exists(self.path(where)) else []

    def note(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def blobs(self, generations: list[str]) -> DataFrame:
        """(blob, text): each distinct text once."""
        return self.spark.read.schema("blob string, text string").parquet(*[f"{self.root}/blobs/{g}" for g in generations])

    def add(self, docs: DataFrame) -> str | None:
        """Keep the texts that are new, as a generation; its name, if there are any."""
        known = sorted({r["gen"] for r in self.manifest()})
        rows = docs.select(text_of().alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
        if known:
            # Hashes first: texts that are here already are not moved.
            new = self.scratch.save(rows.select("blob").distinct().join(self.blobs(known).select("blob"), "blob", "left_anti"), f"new-{uuid.uuid4().hex}")
            if not new.limit(1).count():
                return None
            rows = rows.join(new, "blob", "left_semi")
        gen = uuid.uuid4().hex
        rows.groupBy("blob").agg(F.first("text").alias("text")).write.option("compression", "zstd").parquet(f"{self.root}/blobs/{gen}")
        self.note([(gen, None, None, None)])
        return gen

    def unseen(self, rules: tuple[Rule, ...]) -> dict[tuple[Rule, ...], list[str]]:
        """Generations by the rules that they have not been scanned for."""
        done = defaultdict(set)
        for r in self.manifest():
            done[r["gen"]].add((r["rule"], r["version"]))
        todo = defaultdict(list)
        for gen, pairs in sorted(done.items()):
            todo[tuple(r for r in rules if (r.name, r.version) not in pairs)].append(gen)
        return {k: v for k, v in todo.items() if k}

    def scan(self, rules: tuple[Rule, ...]) -> dict[tuple[Rule, ...], list[str]]:
        """Scan all unseen pairs; returns what was scanned."""
        todo = self.unseen(rules)
        for some, generations in todo.items():
            run = uuid.uuid4().hex
            entries = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")) for r in some])
            found = F.filter(entries, lambda x: F.size(x.spans) > 0).cast(FOUND)
            # Evaluated once: a filter on it would be pushed below and repeat the searches.
            hits = self.blobs(generations).select("blob", F.inline(found))
            hits.write.parquet(f"{self.root}/scans/{run}")
            self.note([(g, r.name, r.version, run) for g in generations for r in some])
        return todo

    def found(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, found): of all blobs with hits, for these rules."""
        current = {(r.name, r.version) for r in rules}
        runs = sorted({r["run"] for r in self.manifest() if (r["rule"], r["version"]) in current})
        schema = f"blob string, rule string, version int, spans {SPAN}"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/scans/{r}" for r in runs]) if runs else self.spark.createDataFrame([], schema)
        rows = rows.where(F.concat_ws("@", "rule", "version").isin([f"{n}@{v}" for n, v in sorted(current)]))
        return rows.groupBy("blob").agg(F.collect_list(F.struct("rule", "version", "spans")).alias("found"))  # one entry for each rule


def findings(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, to: str = "_found") -> DataFrame:
    """All rows and columns of ``docs`` with a column ``to``: array of (rule,
    start, end) by start, then by the rule's place in ``rules``.  Texts that the
    ledger lacks are added to it, and its unseen pairs scanned."""
    address = fresh("_blob", docs)
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.add(docs)
    ledger.scan(rules)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    flat = F.flatten(
        F.transform(
            "found",
            lambda f: F.transform(
                f.spans,
                lambda s: F.struct(s.start.alias("start"), order[f.rule].alias("order"), s.end.alias("end"), f.rule.alias("rule")),
            ),
        )
    )
    hits = ledger.found(rules).select(F.col("blob").alias(address), F.array_sort(flat).alias(to))
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,rule:string>>)")
    return (
        docs.withColumn(address, F.sha2(text_of(), 256))
        .join(hits.hint("rebalance"), address, "left")  # its own exchange lets Spark split a blob that many paths share
        .drop(address)
        .withColumn(to, F.coalesce(to, none))
    )


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.rule, x.start.cast("string"), x.end.cast("string"))), ",")


def _count(rule: str) -> Column:
    return F.size(F.filter("_found", lambda x: x.rule == rule)).cast("long").alias(f"n_{rule}")


def scan(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, a count for each base kind, the digest of
    the base spans and the text form of all spans."""
    found = findings(docs.select("doc_id", "text"), ledger)
    base = F.filter("_found", lambda x: x.order < len(BASE))
    counts = [_count(r.name) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_found")).alias("spans"))


def scan_in_steps(docs: DataFrame) -> DataFrame:
    """``scan`` as two runs over one ledger: the first one knows the base rules
    only; the second one has more rules and scans just the pairs that are new."""
    ledger = Ledger(docs.sparkSession)
    ledger.add(docs)
    ledger.scan(BASE)
    return scan(docs, ledger)


def redact(docs: DataFrame, mark: str = "[secret]", ledger: Ledger | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans
    are merged first.  Rows and columns stay."""
    name = fresh("_found", docs)
    found = findings(docs, ledger, to=name)
    merged = F.aggregate(
        name,
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out")),
        lambda s, x: F.when(x.start >= s.at, F.struct(x.end.alias("at"), F.array_append(s.out, F.struct(x.start.alias("start"), x.end.alias("end"))).alias("out")))
        .when(x.end > s.at, F.struct(x.end.alias("at"), F.array_append(F.slice(s.out, F.lit(1), F.size(s.out) - 1), F.struct(F.element_at(s.out, -1).start.alias("start"), x.end.alias("end"))).alias("out")))
        .otherwise(s),
    ).out

    def pieces(spans: Column) -> Column:
        """The text between spans, one more than there are."""
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x.end))
        starts = F.concat(F.transform(spans, lambda x: x.start), F.array(F.length("text")))
        return F.zip_with(ends, starts, lambda a, b: F.substring("text", a + 1, b - a))

    cut = F.when(F.size(name) == 0, F.col("text")).otherwise(F.array_join(F.transform(F.array(merged), pieces)[0], mark))
    return found.withColumn("text", cut).select(*docs.columns)


_CI = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN = _CI + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_spans(kind: str, pattern: str, order: int, test: str = "true") -> str:
    """DuckDB: a row for each match, its place from the pieces around it."""
    return f"""
  select rid, {order} as k, '{kind}' as kind, st, st + length(hit) as en from (
    select rid, hit, cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) as st
    from (select rid, pieces, hits, unnest(hits) as hit, unnest(range(1, len(hits) + 1)) as i
          from (select rid, string_split_regex(text, '{pattern}') as pieces, regexp_extract_all(text, '{pattern}') as hits from t))
  ) where {test}"""


ORACLE_SQL = f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
s as ({" union all ".join([
    _sql_spans("assign", _ASSIGN, 0, f"length(regexp_extract(hit, '^{_ASSIGN}$', 2)) >= 6"),
    _sql_spans("access", "AKIA[A-Z0-9]+", 1, "length(hit) >= 20"),
    _sql_spans("hex", "[0-9a-f]+", 2, "length(hit) >= 24"),
    *[_sql_spans(r.name, r.pattern, 3 + i) for i, r in enumerate(EXTRA)],
])}),
g as (select rid, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
  string_agg(kind || ':' || st || ':' || en, ',' order by st, k) filter (k < 3) as base,
  string_agg(kind || ':' || st || ':' || en, ',' order by st, k) as spans from s group by rid)
select t.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join g using (rid)
"""
