"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A tree domain > language > source carries weights.  A node's token budget goes
to its children by weight; a child that holds less than its share gives the
shortage to its siblings, and only what a whole group cannot hold goes back to
the level above.  Each leaf then takes whole epochs of its documents and a
prefix of one more, in an order seeded by epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import broadcast_if_small, materialize

LEVELS = ("domain", "lang", "source")
BUCKET_ROWS = 2_000


@dataclass(frozen=True)
class Tree:
    """Weights of domains and languages (1 where none is set; whole numbers, so that
    budgets are exact at any size), and the sources of each domain (the rest are 'other')."""

    domains: dict[str, int]
    langs: dict[str, int]
    sources: dict[str, list[str]]

    def domain_of(self, source: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, sources in self.sources.items():
            out = out.when(source.isin(sources), name)
        return out.otherwise("other")

    def weight(self, level: str) -> Column:
        """Weight of a node among its siblings."""
        out = F.when(F.lit(False), 0)
        for name, w in {"domain": self.domains, "lang": self.langs}.get(level, {}).items():
            out = out.when(F.col(level) == name, w)
        return out.otherwise(1).cast("long")


#: Targets of the registered query.
TREE = Tree(
    {"web": 5, "books": 3, "code": 2},
    {"en": 6, "de": 2, "fr": 2, "es": 2},
    {"web": [f"src{i}" for i in range(8)], "books": [f"src{i}" for i in range(8, 14)], "code": [f"src{i}" for i in range(14, 20)]},
)


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget` to children with `cap` and `w`, from their parent's `total`.

    Children fill up in the order of cap / w; the first that can take its share
    of what is left, and all after it, split the rest by weight.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("cap") / F.col("w"), name)
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = F.col("cap") * after <= (F.col("total") - F.coalesce(before, F.lit(0))) * F.col("w")
    out = nodes.withColumn("full", full)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(group)
    return out.withColumn("_rest", rest).withColumn("_open", open_w).withColumn("budget", F.expr("case when full then cap else (_rest * w) div _open end")).drop("_rest", "_open", "full")


def leaf_budgets(leaves: DataFrame, percent: int, epochs: int, tree: Tree = TREE) -> DataFrame:
    """Adds `budget` to leaves (domain, lang, source, tokens): `percent` of all tokens are shared out."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.expr(f"coalesce((sum(tokens) * {int(percent)}) div 100, 0)").alias("total"))
    known: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = caps.groupBy(*LEVELS[: depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", tree.weight(level))
        nodes = nodes.join(F.broadcast(total)) if known is None else nodes.join(known, parent)  # `total` is one row
        shared = share_out(nodes, parent, level)
        known = shared.select(*LEVELS[: depth + 1], F.col("budget").alias("total"))
    return leaves.join(known.withColumnRenamed("total", "budget"), list(LEVELS))


def _sized(docs: DataFrame, tree: Tree, *more: Column) -> DataFrame:
    """doc_id, the leaf, n_tokens, and what the order within a leaf is seeded by: doc_id, or the text's hash without one."""
    source, text = F.coalesce(F.col("source").cast("string"), F.lit("none")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        tree.domain_of(source).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"),
        source.alias("source"),
        F.ceil(F.octet_length(text) / 4).cast("long").alias("n_tokens"),
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(text.cast("binary"))).alias("name"),
        *more,
    )


def _key(seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.col("name")).cast("binary")), 1, 15), 16, 10).cast("long")


def leaf_cuts(sized: DataFrame, percent: int, epochs: int, seed: int, tree: Tree) -> DataFrame:
    """For each leaf: whole (epochs taken whole) and cut, the last (key, doc_id, n_tokens) of
    the next epoch's prefix, null when it is empty.

    A leaf may hold most rows: its order is cut into hash ranges of about
    BUCKET_ROWS rows, whole ranges are decided by their sums, and only the
    range in which the prefix ends is sorted.
    """
    leaf = list(LEVELS)
    leaves = materialize(sized.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    plan = leaf_budgets(leaves, percent, epochs, tree)
    plan = plan.select(
        *leaf,
        F.expr("case when tokens > 0 then budget div tokens else 0 end").alias("whole"),
        F.expr("case when tokens > 0 then budget % tokens else 0 end").alias("rest"),
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / BUCKET_ROWS))).cast("int").alias("bits"),
    )
    plan = materialize(plan, "plan")
    keyed = sized.join(broadcast_if_small(plan, 128), leaf).withColumn("key", _key(seed)).withColumn("range", F.expr("shiftright(key, 60 - bits)"))
    keyed = materialize(keyed.select(*leaf, "range", "key", "doc_id", "n_tokens"), "keyed")

    place = F.struct("key", "doc_id", "n_tokens")
    ranges = keyed.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("size"), F.max("key").alias("top"))
    upto = F.sum("size").over(Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    ranges = materialize(ranges.withColumn("upto", upto).join(broadcast_if_small(plan, 128), leaf).select(*leaf, "range", "top", "whole", "rest", "upto", (F.col("upto") - F.col("size")).alias("before")), "ranges")
    split = ranges.where("upto > rest and before <= rest")
    order = Window.partitionBy(*leaf, "range").orderBy("key", "doc_id", "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = keyed.join(broadcast_if_small(split, 160), [*leaf, "range"])  # one range of each leaf
    inside = inside.withColumn("at", F.col("before") + F.sum("n_tokens").over(order)).where("at <= rest")
    some = inside.groupBy(*leaf).agg(F.max(place).alias("cut"))
    full = ranges.where("upto <= rest").groupBy(*leaf).agg(F.max("top").alias("top"))
    return plan.select(*leaf, "whole").join(full, leaf, "left").join(some, leaf, "left")


def _copies(epochs: int) -> Column:
    reached = lambda x: F.coalesce(x, F.lit(False))
    more = reached(F.col("key") <= F.col("top")) | reached(F.struct("key", "doc_id", "n_tokens") <= F.col("cut"))
    return F.least(F.col("whole") + more.cast("long"), F.lit(epochs)).cast("long").alias("copies")


def mix_sources(docs: DataFrame, percent: int = 80, epochs: int = 2, seed: int = 7, tree: Tree = TREE) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang, source): doc_id, domain, lang, source, n_tokens, copies.

    copies is how often the document enters the mixture (0 to `epochs`).  A
    document's size is a quarter of its UTF-8 bytes, rounded up.  Of the last,
    partial epoch a leaf takes the longest prefix that fits its budget, in the
    order of a hash of seed, epoch and doc_id (of the text where that is null).
    Null lang or source is the leaf 'none', null or empty text has size 0 and comes
    with any prefix that reaches it.  Repeated rows are separate documents; those
    that agree in doc_id and size are taken or left together.  Other columns are
    ignored; an empty table gives none.
    """
    sized = materialize(_sized(docs, tree), "sized")
    cuts = materialize(leaf_cuts(sized, percent, epochs, seed, tree), "cuts")
    return sized.join(broadcast_if_small(cuts, 160), list(LEVELS)).withColumn("key", _key(seed)).select("doc_id", *LEVELS, "n_tokens", _copies(epochs))


def take_mixture(docs: DataFrame, percent: int = 80, epochs: int = 2, seed: int = 7, tree: Tree = TREE) -> DataFrame:
    """The mixture itself: each row of `docs` as often as mix_sources says, columns unchanged.

    The plan per leaf is joined to the rows, so no text is shuffled and each row
    is judged by itself, whatever doc_ids repeat or are null.
    """
    sized = materialize(_sized(docs, tree), "sized")
    cuts = materialize(leaf_cuts(sized, percent, epochs, seed, tree), "cuts")
    rows = _sized(docs, tree, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    taken = rows.join(broadcast_if_small(cuts, 160), list(LEVELS)).withColumn("key", _key(seed)).select("doc", _copies(epochs)).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def oracle_sql(table: str = "documents", percent: int = 80, epochs: int = 2, seed: int = 7) -> str:
    """The same rows as mix_sources, for DuckDB."""

    def case(column: str, named: dict) -> str:
        return "case " + " ".join(f"when {column} = '{k}' then {w}" for k, w in named.items()) + " else 1 end" if named else "1"

    domain = "case " + " ".join("when source in (" + ", ".join(f"'{s}'" for s in v) + f") then '{k}'" for k, v in TREE.sources.items()) + " else 'other' end"
    sql = f"""with raw as (select doc_id, coalesce(text, '') as text, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source from {table}),
sized as (select doc_id, {domain} as domain, lang, source, (strlen(text) + 3) // 4 as n_tokens from raw),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {epochs})::bigint as cap from sized group by all),
k0 as (select (sum(tokens) * {percent} // 100)::bigint as total from leaves)"""
    weights = {"domain": TREE.domains, "lang": TREE.langs}
    for d, level in enumerate(LEVELS):
        cols, parent = ", ".join(LEVELS[: d + 1]), ", ".join(LEVELS[:d])
        part = f"partition by {parent}" if parent else ""
        join = f"join k{d} using ({parent})" if parent else "cross join k0"
        sql += f""",
n{d} as (select {cols}, cap, w, total from (select {cols}, sum(cap)::bigint as cap, {case(level, weights.get(level, {}))} as w from leaves group by {cols}) {join}),
f{d} as (select *, cap * sum(w) over ({part} order by cap / w, {level} rows between current row and unbounded following)
  <= (total - coalesce(sum(cap) over ({part} order by cap / w, {level} rows between unbounded preceding and 1 preceding), 0)) * w as filled from n{d}),
k{d + 1} as (select {cols}, (case when filled then cap else ((total - coalesce(sum(case when filled then cap end) over ({part}), 0)) * w)
  // sum(case when not filled then w end) over ({part}) end)::bigint as total from f{d})"""
    return (
        sql
        + f""",
plan as (select domain, lang, source, case when tokens > 0 then total // tokens else 0 end as whole, case when tokens > 0 then total % tokens else 0 end as rest
  from leaves join k3 using (domain, lang, source)),
keyed as (select s.*, whole, rest, ('0x' || substr(md5('{seed}|' || whole || '|' || doc_id), 1, 15))::bigint as key from sized s join plan using (domain, lang, source)),
run as (select *, sum(n_tokens) over (partition by domain, lang, source order by key, doc_id, n_tokens rows between unbounded preceding and current row) as upto from keyed)
select doc_id, domain, lang, source, n_tokens, least(whole + (upto <= rest)::int, {epochs})::bigint as copies from run"""
    )
