"""Registered queries over the given tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits
from .model import Profile
from .operators import algebra, classes, collapse, incidence, network, summary
from .plans.adapters import line_alignments, line_incidence, part_genes, read_incidence, table
from .sinks.ec import write_ec
from .sources.ec import read_ec
from .sources.text import all_targets, name_differences
from .tables import shared_folder, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

HAPS = ["A", "N", "R"]
#: Parameters of the registered queries: genotypes by gene, reads that a cell needs, bin size, the gene looked up.
GENOTYPES = [("Brand#1", "A"), ("Brand#1", "N"), ("Brand#2", "R")]
MINIMUM, BIN, GENE = 500, 100_000, 7
RUN_SPAN = 1 << 20  # order numbers in which runs are numbered by one task

_LINES = """al as (select l_orderkey as read_id, p_brand as target, l_returnflag as hap, l_partkey, l_suppkey, l_shipdate, c_nationkey as cell, l_linestatus, p_type
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
v as (select * from al where l_linestatus = 'F'),
a as (select distinct read_id as ec_id, target, hap, 1.0::double as v from v),
n as (select distinct read_id as ec_id, cell as sample, 1::bigint as n from v)"""
_SETS = "s as (select read_id, cell, string_agg(distinct target, ',' order by target) as ec_key from v group by read_id, cell)"
_GROUPS = "g as (select distinct p_brand as target, substr(p_brand, 1, 7) as gene from part)"


def query(sql: str, *ctes: str):
    """Registers a function under its name, with its SQL on top of the named CTEs."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"with {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return register


def _valid(spark: SparkSession, sf_dir: str, cell: bool = False) -> DataFrame:
    return line_alignments(spark, sf_dir, cell).where("l_linestatus = 'F'")


def _cells(spark: SparkSession, sf_dir: str, reads: DataFrame) -> DataFrame:
    """Reads with their cell: joined after lines have become reads."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cell"))
    return reads.join(orders, "read_id").join(customer, "o_custkey").drop("o_custkey")


def _counted(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    """Reads per class, and per cell if asked: by masks while the loci fit into 63 bits, else by sets."""
    part = table(spark, sf_dir, "part")
    loci = sorted(r[0] for r in part.select("p_brand").distinct().take(64))
    if len(loci) > 63:
        lines = _valid(spark, sf_dir)
        return collapse.count_by_prints(lines, ["read_id"], "target") if not by else collapse.count_by_prints(_cells(spark, sf_dir, lines), ["read_id", "cell"], "target", by)
    # the bit of a brand comes with the join that brings the brand
    bit = F.array_position(F.array(*[F.lit(x) for x in loci]), F.col("p_brand")) - 1
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("read_id"), "l_partkey")
    masks = lines.join(part.select("p_partkey", bits.mask_of(bit).alias("bit")), F.col("l_partkey") == F.col("p_partkey")).groupBy("read_id").agg(F.bit_or("bit").alias("mask"))
    return classes.name_masks(classes.count_classes(_cells(spark, sf_dir, masks) if by else masks, by, "mask"), loci)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("target"), F.substring("p_brand", 1, 7).alias("gene")).distinct()


def _haplotypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(HAPS)), "hap_idx int, hap string")


# classes and counts


@query("select ec_key, count(*) as n from s group by ec_key", _LINES, _SETS)
def ec_counts(spark, sf_dir):
    return _counted(spark, sf_dir, [])


@query("select ec_key, cell, count(*) as n from s group by ec_key, cell", _LINES, _SETS)
def ec_cell_counts(spark, sf_dir):
    return _counted(spark, sf_dir, ["cell"])


@query("select cell, count(*) as total from s group by cell", _LINES, _SETS)
def cell_totals(spark, sf_dir):
    return _counted(spark, sf_dir, ["cell"]).groupBy("cell").agg(F.sum("n").alias("total"))


@query("select ec_key, count(*) as total from s group by ec_key", _LINES, _SETS)
def ec_totals(spark, sf_dir):
    return _counted(spark, sf_dir, ["cell"]).groupBy("ec_key").agg(F.sum("n").alias("total"))


@query(f"select ec_key, cell, count(*) as n from s where cell in (select cell from s group by cell having count(*) >= {MINIMUM}) group by ec_key, cell", _LINES, _SETS)
def cells_min_count(spark, sf_dir):
    return classes.keep_cells(_counted(spark, sf_dir, ["cell"]), MINIMUM)


@query("select count(*) as all_alignments, count_if(l_linestatus = 'F')::bigint as valid_alignments, count(distinct case when l_linestatus = 'F' then read_id end) as unique_reads from al", _LINES)
def total_counts(spark, sf_dir):
    ok = F.col("l_linestatus") == "F"
    return line_alignments(spark, sf_dir, cell=False).agg(F.count("*").alias("all_alignments"), F.count_if(ok).alias("valid_alignments"), F.count_distinct(F.when(ok, F.col("read_id"))).alias("unique_reads"))


@query(
    """select user_id, run, string_agg(distinct event_type, ',' order by event_type) as ec_key from (
  select user_id, event_type, sum(c) over (partition by event_type order by event_id rows unbounded preceding)::bigint as run from (
    select *, (coalesce(user_id <> lag(user_id) over (partition by event_type order by event_id), false))::int as c from events)) group by user_id, run"""
)
def read_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    runs = classes.number_any_runs(events, "user_id", "event_id", ["event_type"], RUN_SPAN)
    return classes.read_sets(runs, ["user_id", "run"], "event_type")


@query("select ec_key, (row_number() over (order by first, ec_key) - 1)::bigint as idx from (select ec_key, min(read_id) as first from s group by ec_key)", _LINES, _SETS)
def ec_ordinals(spark, sf_dir):
    return classes.dense_index(classes.read_sets(_valid(spark, sf_dir), ["read_id"], "target"), "ec_key", "read_id", "idx")


# incidence


@query("select ec_id, target, sum(1 << list_position(['A', 'N', 'R'], hap)::int - 1)::bigint as mask from a group by ec_id, target", _LINES)
def incidence_mask(spark, sf_dir):
    return incidence.to_mask(line_incidence(spark, sf_dir), _haplotypes(spark))


@query("select ec_id, target, hap, v from a", _LINES)
def mask_decode(spark, sf_dir):
    haps = _haplotypes(spark)
    return incidence.from_mask(incidence.to_mask(line_incidence(spark, sf_dir), haps), haps)


@query("select target, hap, (coalesce(max(l_suppkey) - min(l_suppkey) + 1, 0))::bigint as span from v group by target, hap", _LINES)
def target_span(spark, sf_dir):
    lines = _valid(spark, sf_dir).withColumn("tid", F.concat_ws("_", "target", "hap")).withColumn("pos", F.col("l_suppkey"))
    refs = lines.select("tid", bits.target_of(F.col("tid")).alias("target"), bits.haplotype_of(F.col("tid")).alias("hap")).distinct()
    return summary.target_span(lines.select("tid", "pos"), refs)


# sums, unique hits, normalisation


@query("select ec_id, hap, sum(v) as v from a group by ec_id, hap", _LINES)
def sum_locus(spark, sf_dir):
    return summary.sum_locus(line_incidence(spark, sf_dir))


@query("select ec_id, target, sum(v) as v from a group by ec_id, target", _LINES)
def sum_haplotype(spark, sf_dir):
    return summary.sum_haplotype(line_incidence(spark, sf_dir))


@query("select hap, target, sample, sum(v * n) as reads from a join n using (ec_id) group by hap, target, sample", _LINES)
def alignment_counts(spark, sf_dir):
    return summary.alignment_counts(*read_incidence(spark, sf_dir), by=["sample"])


@query("select hap, target, sum(v * n) as reads from a join n using (ec_id) where ec_id in (select ec_id from a group by ec_id having count(*) = 1) group by hap, target", _LINES)
def unique_allelic(spark, sf_dir):
    return summary.unique_allelic(*read_incidence(spark, sf_dir))


_UNIQUE = "u as (select ec_id, min(target) as target from a group by ec_id having count(distinct target) = 1)"


@query("select target, sum(n)::bigint as reads from u join n using (ec_id) group by target", _LINES, _UNIQUE)
def unique_locus(spark, sf_dir):
    return summary.unique_locus(*read_incidence(spark, sf_dir))


@query(
    "select p.target as locus, "
    + ", ".join(f"coalesce((select sum(v * n) from a join n using (ec_id) where a.target = p.target and hap = '{h}'), 0)::double as aln_{h}" for h in HAPS)
    + ", "
    + ", ".join(f"coalesce((select sum(v * n) from a join n using (ec_id) join one using (ec_id) where a.target = p.target and hap = '{h}'), 0)::double as uniq_{h}" for h in HAPS)
    + ", coalesce((select sum(n) from u join n using (ec_id) where u.target = p.target), 0)::bigint as locus_uniq from (select distinct p_brand as target from part) p",
    _LINES,
    _UNIQUE,
    "one as (select ec_id from a group by ec_id having count(*) = 1)",
)
def alignment_report(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("target")).distinct()
    return summary.alignment_report(*read_incidence(spark, sf_dir), HAPS, targets)


def _normalized(axis: str, keys: str):
    grouped = "gene" in keys
    source = "a join g using (target)" if grouped else "a"
    gene = ", gene" if grouped else ""

    def run(spark, sf_dir):
        a = line_incidence(spark, sf_dir)
        out = summary.normalize(a, axis, _groups(spark, sf_dir) if grouped else None)
        return out.select("ec_id", "target", "hap", *["gene"] * grouped, F.round("v", 6).alias("v"))

    run.__name__ = f"normalize_{axis}"
    query(f"select ec_id, target, hap{gene}, round(v / sum(v) over (partition by {keys}), 6) as v from {source}", _LINES, *[_GROUPS] * grouped)(run)


for _axis, _keys in {"locus": "ec_id, target", "haplotype": "ec_id, hap", "read": "ec_id", "group": "ec_id, gene", "haplogroup": "ec_id, gene, hap"}.items():
    _normalized(_axis, _keys)

_PARTS = "p as (select distinct read_id as ec_id, l_partkey as target, target as gene, hap, 1.0::double as v from v)"


def _bundled(spark, sf_dir, reset):
    a = _valid(spark, sf_dir).select(F.col("read_id").alias("ec_id"), F.col("l_partkey").alias("target"), "hap").distinct().withColumn("v", F.lit(1.0))
    genes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("gene"))
    return summary.bundle(a, genes, reset)


@query("select ec_id, gene as target, hap, sum(v) as v from p group by all", _LINES, _PARTS)
def bundle(spark, sf_dir):
    return _bundled(spark, sf_dir, False)


@query("select distinct ec_id, gene as target, hap, 1.0::double as v from p", _LINES, _PARTS)
def bundle_reset(spark, sf_dir):
    return _bundled(spark, sf_dir, True)


@query("select ec_id, target, hap, v from a join g using (target) where (gene, hap) in (" + ", ".join(f"('{g}', '{h}')" for g, h in GENOTYPES) + ")", _LINES, _GROUPS)
def genotype_mask(spark, sf_dir):
    return summary.genotype_mask(line_incidence(spark, sf_dir), _groups(spark, sf_dir), spark.createDataFrame(GENOTYPES, "gene string, hap string"))


_KEYED = """t as (select ec_id, string_agg(target || ':' || hap || ':' || v, ',' order by target, hap) as rows from m group by ec_id),
k as (select ec_id, coalesce(rows, '') as rows from (select ec_id from n union select ec_id from m) left join t using (ec_id)),
f as (select ec_id, min(ec_id) over (partition by rows) as first from k)"""
_MASKED = "m as (select ec_id, target, hap, v from a join g using (target) where (gene, hap) in (" + ", ".join(f"('{g}', '{h}')" for g, h in GENOTYPES) + "))"
_BUNDLED = "m as (select ec_id, gene as target, hap, 1.0::double as v from a join g using (target) group by ec_id, gene, hap)"


def _masked_profile(spark, sf_dir):
    a, n = read_incidence(spark, sf_dir)
    return summary.genotype_mask(a, _groups(spark, sf_dir), spark.createDataFrame(GENOTYPES, "gene string, hap string")), n


@query("select first as ec_id, sample, sum(n)::bigint as n from n join f using (ec_id) group by first, sample", _LINES, _GROUPS, _MASKED, _KEYED)
def recollapse_masked_counts(spark, sf_dir):
    return collapse.recollapse(*_masked_profile(spark, sf_dir))[1]


@query("select m.* from m join f using (ec_id) where ec_id = first", _LINES, _GROUPS, _MASKED, _KEYED)
def recollapse_masked_rows(spark, sf_dir):
    return collapse.recollapse(*_masked_profile(spark, sf_dir))[0]


@query("select first as ec_id, sample, sum(n)::bigint as n from n join f using (ec_id) group by first, sample", _LINES, _GROUPS, _BUNDLED, _KEYED)
def recollapse_bundled_counts(spark, sf_dir):
    a, n = read_incidence(spark, sf_dir)
    return collapse.recollapse(summary.bundle(a, _groups(spark, sf_dir), reset=True), n)[1]


# matrix algebra: b is the incidence of the other lines, w a weight for each coordinate

_B = "b as (select distinct read_id as ec_id, target, hap, 2.0::double as v from al where l_linestatus = 'O')"


def _other(spark, sf_dir, by=("ec_id",)):
    return line_incidence(spark, sf_dir, "O", 2.0, by)


def _cellwise(spark, sf_dir):
    """Both, dealt by all axes: they are joined by them."""
    return line_incidence(spark, sf_dir, by=algebra.AXES), _other(spark, sf_dir, algebra.AXES)


@query("select ec_id, target, hap, sum(v) as v from (select * from a union all select * from b) group by all", _LINES, _B)
def mat_add(spark, sf_dir):
    return algebra.add(line_incidence(spark, sf_dir), _other(spark, sf_dir))


@query("select ec_id, target, hap, sum(v) as v from (select * from a union all select ec_id, target, hap, -v from b) group by all having sum(v) <> 0", _LINES, _B)
def mat_sub(spark, sf_dir):
    return algebra.subtract(line_incidence(spark, sf_dir), _other(spark, sf_dir))


@query("select ec_id, target, hap, a.v * b.v as v from a join b using (ec_id, target, hap)", _LINES, _B)
def mat_mul_elem(spark, sf_dir):
    return algebra.multiply(*_cellwise(spark, sf_dir))


@query("select ec_id, target, hap, v * 2.5 as v from a", _LINES)
def mat_scale(spark, sf_dir):
    return algebra.scale(line_incidence(spark, sf_dir), 2.5)


@query("select ec_id, gene as target, hap, sum(v * length(target)) as v from a join g using (target) group by all", _LINES, _GROUPS)
def mat_mul_matrix(spark, sf_dir):
    m = _groups(spark, sf_dir).select("target", F.col("gene").alias("to"), F.length("target").cast("double").alias("v"))
    return algebra.matmul(line_incidence(spark, sf_dir), m)


def _multiplied(name: str, axes: list[str]):
    on = ", ".join(axes)

    def run(spark, sf_dir):
        return algebra.multiply(line_incidence(spark, sf_dir), _other(spark, sf_dir).groupBy(*axes).agg(F.sum("v").alias("v")))

    run.__name__ = name
    query(f"select ec_id, target, hap, a.v * w.v as v from a join (select {on}, sum(v) as v from b group by all) w using ({on})", _LINES, _B)(run)


for _name, _axes in {"locus": ["target"], "read": ["ec_id"], "read_hap": ["ec_id", "hap"], "read_locus": ["ec_id", "target"], "hap_locus": ["hap", "target"]}.items():
    _multiplied(f"mat_mul_{_name}", _axes)


@query("select ec_id, hap, v from a where target = 'Brand#11'", _LINES)
def cross_section_locus(spark, sf_dir):
    return algebra.cross_section(line_incidence(spark, sf_dir), "target", "Brand#11")


@query("select ec_id, target, v from a where hap = 'N'", _LINES)
def cross_section_hap(spark, sf_dir):
    return algebra.cross_section(line_incidence(spark, sf_dir), "hap", "N")


@query("select target, hap, v from a where ec_id = 7", _LINES)
def cross_section_read(spark, sf_dir):
    return algebra.cross_section(line_incidence(spark, sf_dir), "ec_id", 7)


@query("select ec_id, target, hap, v from a union all select ec_id + 10000000, target, hap, v from b", _LINES, _B)
def combine(spark, sf_dir):
    return algebra.combine(line_incidence(spark, sf_dir), _other(spark, sf_dir), 10_000_000)


@query("select ec_id, target, hap, 1.0::double as v from b", _LINES, _B)
def reset(spark, sf_dir):
    return algebra.reset(_other(spark, sf_dir))


@query("select ec_id, target, hap, 2.0::double as v from b union all select ec_id, target, hap, v from a where not exists (select 1 from b where b.ec_id = a.ec_id and b.target = a.target and b.hap = a.hap)", _LINES, _B)
def set_value(spark, sf_dir):
    return algebra.set_value(*_cellwise(spark, sf_dir))


@query("select count(distinct target) as num_loci, count(distinct hap) as num_haplotypes, count(*) as nnz, (select count(distinct sample) from n) as num_samples, (select count(distinct ec_id) from n) as num_ecs from a", _LINES)
def profile_shape(spark, sf_dir):
    return summary.shape(*read_incidence(spark, sf_dir))


@query(
    "select ec_key, sample, count(*) as n from (select read_id, 's' || (read_id % 2) as sample, string_agg(distinct target, ',' order by target) as ec_key from al group by read_id) group by all",
    _LINES,
)
def ec_merge(spark, sf_dir):
    lines = line_alignments(spark, sf_dir, cell=False).withColumn("sample", F.concat(F.lit("s"), (F.col("read_id") % 2).cast("string"))).withColumn("file", F.col("read_id") % 4)
    per_file = classes.count_classes(classes.read_sets(lines, ["read_id", "sample", "file"], "target"), ["sample", "file"])
    return algebra.merge_counts(per_file)


def _class_file(spark, sf_dir, status: str, haps: list[str]) -> Profile:
    """The lines of one status as the tables of a class file with its own order of haplotypes, read back by name."""
    lines = line_alignments(spark, sf_dir, cell=False).where(F.col("l_linestatus") == status)
    order = spark.createDataFrame(list(enumerate(haps)), "hap_idx long, hap string")
    targets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("target")).distinct()
    targets = classes.dense_index(targets.withColumn("_o", F.col("target")), "target", "_o", "target_idx")
    a = incidence.to_mask(line_incidence(spark, sf_dir, status), order)
    n = lines.groupBy(F.col("read_id").alias("ec_id")).agg(F.count("*").alias("n")).withColumn("sample_idx", F.col("ec_id") % 2)
    names = spark.createDataFrame([(0, f"{status}0"), (1, "shared")], "sample_idx long, sample string")
    named, n = written(a.join(targets, "target").select("ec_id", "target_idx", "mask"), "masks"), written(n, "counts")  # read many times
    return Profile.of_classes({"haplotypes": order, "targets": targets, "samples": names, "lengths": targets.select("target_idx", F.lit(0).cast("long").alias("hap_idx"), F.lit(1).cast("long").alias("length")), "a": named, "n": n})


@query(
    """select ec_key, sample, sum(n)::bigint as n from (
  select l_linestatus, read_id, string_agg(distinct target || ':' || hap, ',' order by target || ':' || hap) as ec_key, case when read_id % 2 = 0 then l_linestatus || '0' else 'shared' end as sample, count(*) as n
  from al group by l_linestatus, read_id) group by ec_key, sample""",
    _LINES,
)
def ec_merge_files(spark, sf_dir):
    """Two class files with haplotypes in opposite orders, merged by name."""
    both = Profile.merge([_class_file(spark, sf_dir, "F", HAPS), _class_file(spark, sf_dir, "O", HAPS[::-1])])
    return both.n.join(collapse.named_keys(both.a), "ec_id").select("ec_key", "sample", "n")


@query(
    """select (dense_rank() over (order by ec_key) - 1)::bigint as ec_id, array_to_string(list_sort(list_transform(string_split(ec_key, ','), lambda x: x || ':X')), ',') as ec_key, cell::varchar as sample, n
  from (select ec_key, cell, count(*) as n from s group by ec_key, cell)""",
    _LINES,
    _SETS,
)
def class_file(spark, sf_dir):
    """Classes per cell as one class file in the shared folder, written by ranges and read back."""
    counts = written(_counted(spark, sf_dir, ["cell"]), "counts")
    counts = written(classes.renumbered(counts), "numbered")
    loci = counts.select("ec_id", F.explode(F.split("ec_key", ",")).alias("target")).distinct()
    dense = lambda df, key, name: written(classes.dense_index(df.select(key, F.col(key).alias("_k")), key, "_k", name), name)
    targets, samples = dense(loci, "target", "target_idx"), dense(counts, "cell", "sample_idx").withColumn("sample", F.col("cell").cast("string"))
    haplotypes = spark.createDataFrame([(0, "X")], "hap_idx long, hap string")
    tables = {
        "haplotypes": haplotypes, "targets": targets, "samples": samples, "lengths": targets.select("target_idx", F.lit(0).alias("hap_idx"), F.lit(1).alias("length")),
        "a": loci.join(targets, "target").select("ec_id", "target_idx", F.lit(1).alias("mask")), "n": counts.join(samples, "cell").select("ec_id", "sample_idx", "n"),
    }
    path = f"{shared_folder(spark)}/classes-{uuid.uuid4().hex}.ec"
    write_ec(path, tables, counts.select("ec_id").distinct().count())
    back = Profile.of_classes(read_ec(spark, path))
    return back.n.join(collapse.named_keys(back.a), "ec_id").select("ec_id", "ec_key", "sample", "n")


@query("select ec_key, count(*) as n from (select l_orderkey, string_agg(distinct l_partkey::varchar, ',' order by l_partkey::varchar) as ec_key from lineitem where l_linestatus = 'F' group by l_orderkey) group by ec_key")
def ec_counts_parts(spark, sf_dir):
    """Classes over thousands of loci (parts), counted by fingerprints."""
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("read_id"), "l_partkey")
    return collapse.count_by_prints(lines, ["read_id"], "l_partkey")


@query("select ec_id, target, hap, v from a where ec_id in (select ec_id from n where sample < 5)", _LINES)
def pull_alignments(spark, sf_dir):
    a, n = read_incidence(spark, sf_dir)
    return summary.pull(a, n, n.where("sample < 5"))[0]


@query("select ec_id, sample, n from n where ec_id in (select ec_id from a where hap = 'R')", _LINES)
def pull_counts(spark, sf_dir):
    a, n = read_incidence(spark, sf_dir)
    return summary.pull(a, n, a.where("hap = 'R'"))[1]


@query("select ec_id, sample, n from n union all select ec_id + 10000000, sample, n from n where sample < 5", _LINES)
def combine_counts(spark, sf_dir):
    n = read_incidence(spark, sf_dir)[1]
    return algebra.combine_rows(n, n.where("sample < 5"), 10_000_000)


@query("select sum(n)::bigint as n from (select count(*) as n from s)", _LINES, _SETS)
def total_reads(spark, sf_dir):
    return classes.total_count(_counted(spark, sf_dir, []))


@query("select (row_number() over (order by hap) - 1)::bigint as hap_idx, hap from (select distinct hap from a)", _LINES)
def haplotype_order(spark, sf_dir):
    return summary.sorted_haplotypes(line_incidence(spark, sf_dir))


@query("select target, " + ", ".join(f"sum(case when hap = '{h}' then v else 0 end)::double as {h}" for h in HAPS) + " from a where ec_id = 7 group by target", _LINES)
def print_read(spark, sf_dir):
    return summary.print_read(line_incidence(spark, sf_dir), 7, HAPS)


@query("select distinct ec_id from a where target = 'Brand#11' and hap = 'N'", _LINES)
def reads_of_locus(spark, sf_dir):
    return summary.reads_of_locus(line_incidence(spark, sf_dir), "Brand#11", "N")


@query("select distinct ec_id from a where target = 'Brand#11'", _LINES)
def reads_of_any_haplotype(spark, sf_dir):
    return summary.reads_of_locus(line_incidence(spark, sf_dir), "Brand#11")


@query(
    "select target, " + ", ".join(f"coalesce(max(case when hap = '{h}' then l_suppkey end) - min(case when hap = '{h}' then l_suppkey end) + 1, 0)::bigint as {h}" for h in HAPS) + " from v group by target",
    _LINES,
)
def range_report(spark, sf_dir):
    return summary.span_table(target_span(spark, sf_dir), HAPS)


@query(
    "select 'first' as side, target as name from (select distinct target from al where hap = 'R' and l_shipdate < '1993-01-01') where target not in (select target from al where hap = 'N' and l_partkey < 200) "
    "union all select 'second', target from (select distinct target from al where hap = 'N' and l_partkey < 200) where target not in (select target from al where hap = 'R' and l_shipdate < '1993-01-01')",
    _LINES,
)
def name_check(spark, sf_dir):
    lines = line_alignments(spark, sf_dir, cell=False)
    return name_differences(lines.where("hap = 'R' and l_shipdate < '1993-01-01'"), lines.where("hap = 'N' and l_partkey < 200"), "target")


# network, lookups, bins

_BY_SAMPLE = """sb as (select sample, x.target as gene_id_1, y.target as gene_id_2, count(*) as read_count
  from (select distinct ec_id, target from a) x join (select distinct ec_id, target from a) y using (ec_id) join n using (ec_id) group by all)"""


def _shared_by_cell(spark, sf_dir):
    a, n = read_incidence(spark, sf_dir)
    return network.shared_reads_by(a.select("ec_id", F.col("target").alias("gene")), n)


@query("select sample, gene_id_1 as gene_id, read_count from sb where gene_id_1 = gene_id_2", _LINES, _BY_SAMPLE)
def sample_totals(spark, sf_dir):
    return _shared_by_cell(spark, sf_dir).where("gene_id_1 = gene_id_2").select("sample", F.col("gene_id_1").alias("gene_id"), "read_count")


@query("select * from sb where gene_id_1 <> gene_id_2", _LINES, _BY_SAMPLE)
def sample_edges(spark, sf_dir):
    return network.gene_edges(_shared_by_cell(spark, sf_dir))


_SHARED = "sh as (select x.target as gene_id_1, y.target as gene_id_2, count(*) as read_count from (select distinct ec_id, target from a) x join (select distinct ec_id, target from a) y using (ec_id) group by all)"
_INFO = "info as (select p_brand as gene_id, min(p_name) as symbol, count(*) as parts from part group by p_brand)"


def _shared(spark, sf_dir):
    a, n = read_incidence(spark, sf_dir)
    return network.shared_reads(a.select("ec_id", F.col("target").alias("gene")).distinct(), n)


def _info(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene_id")).agg(F.min("p_name").alias("symbol"), F.count("*").alias("parts"))


@query("select gene_id_1, gene_id_2, read_count from sh", _LINES, _SHARED)
def shared_reads(spark, sf_dir):
    return _shared(spark, sf_dir)


@query("select gene_id_1 as gene_id, read_count from sh where gene_id_1 = gene_id_2", _LINES, _SHARED)
def gene_totals(spark, sf_dir):
    return network.gene_totals(_shared(spark, sf_dir))


@query("select 'all' as sample_id, gene_id_1 as gene_id, symbol, parts, read_count from sh join info on gene_id = gene_id_1 where gene_id_1 = gene_id_2 and read_count > 0", _LINES, _SHARED, _INFO)
def gene_expression(spark, sf_dir):
    totals = network.gene_totals(_shared(spark, sf_dir)).withColumn("sample_id", F.lit("all"))
    return network.expression(_info(spark, sf_dir), totals, "all")


@query("select 'all' as sample_id, read_count, info.* from sh join info on gene_id = gene_id_2 where gene_id_1 = 'Brand#11' and gene_id_2 <> gene_id_1", _LINES, _SHARED, _INFO)
def gene_neighbors(spark, sf_dir):
    edges = network.gene_edges(_shared(spark, sf_dir)).withColumn("sample_id", F.lit("all"))
    return network.neighbors(edges, _info(spark, sf_dir), "all", "Brand#11")


@query(
    "select 'all' as sample_id, read_count, x.gene_id as g1_gene_id, x.symbol as g1_symbol, x.parts as g1_parts, y.gene_id as g2_gene_id, y.symbol as g2_symbol, y.parts as g2_parts "
    "from sh join info x on x.gene_id = gene_id_1 join info y on y.gene_id = gene_id_2 where gene_id_1 <> gene_id_2",
    _LINES,
    _SHARED,
    _INFO,
)
def gene_pairs(spark, sf_dir):
    edges = network.gene_edges(_shared(spark, sf_dir)).withColumn("sample_id", F.lit("all"))
    return network.gene_pairs(edges, _info(spark, sf_dir), "all")


@query("select to_json({gene_id: gene_id, symbol: symbol, parts: parts, read_count: read_count, sample_id: 'all'})::varchar as json from sh join info on gene_id = gene_id_1 where gene_id_1 = gene_id_2", _LINES, _SHARED, _INFO)
def expression_json(spark, sf_dir):
    totals = network.gene_totals(_shared(spark, sf_dir)).withColumn("sample_id", F.lit("all"))
    return network.as_json(network.expression(_info(spark, sf_dir), totals, "all").select("gene_id", "symbol", "parts", "read_count", "sample_id"))


@query("select to_json({gene_id: gene_id, symbol: symbol, parts: parts, read_count: read_count})::varchar as json from sh join info on gene_id = gene_id_2 where gene_id_1 = 'Brand#11' and gene_id_2 <> gene_id_1", _LINES, _SHARED, _INFO)
def neighbors_json(spark, sf_dir):
    edges = network.gene_edges(_shared(spark, sf_dir)).withColumn("sample_id", F.lit("all"))
    return network.as_json(network.neighbors(edges, _info(spark, sf_dir), "all", "Brand#11").select("gene_id", "symbol", "parts", "read_count"))


_GENES = """ge as (select p_partkey as gene_id, p_name as symbol, p_type as chr, floor(p_retailprice * 1000)::bigint as start_pos, floor(p_retailprice * 1000)::bigint + p_size * 10000 as end_pos, read_count
  from part join (select l_partkey, count(distinct l_orderkey) as read_count from lineitem group by l_partkey) on p_partkey = l_partkey)"""
_BINS = f"bi as (select chr, bin, max(log2(read_count)) as max_expr from (select chr, read_count, unnest(range(start_pos // {BIN}, end_pos // {BIN} + 1)) as bin from ge) group by all)"


@query("select chr, bin, round(max_expr, 6) as max_expr from bi", _GENES, _BINS)
def expr_bins(spark, sf_dir):
    return network.expression_bins(part_genes(spark, sf_dir), BIN).withColumn("max_expr", F.round("max_expr", 6))


@query("select t.chr, t.bin, round(coalesce(max_expr, 0), 6) as value from (select chr, unnest(range(0, max(bin) + 1)) as bin from bi group by chr) t left join bi using (chr, bin)", _GENES, _BINS)
def chr_bin_counts(spark, sf_dir):
    return network.dense_bins(network.expression_bins(part_genes(spark, sf_dir), BIN)).withColumn("value", F.round("value", 6))


@query("select chr, round(greatest(0, max(max_expr)), 6)::double as max_expr from bi group by chr", _GENES, _BINS)
def chr_largest(spark, sf_dir):
    return network.largest_bins(network.expression_bins(part_genes(spark, sf_dir), BIN)).withColumn("max_expr", F.round("max_expr", 6))


@query(f"select * from ge where gene_id = {GENE}", _GENES)
def gene_lookup(spark, sf_dir):
    return network.lookup_gene(part_genes(spark, sf_dir), GENE)


@query("select * from ge where upper(symbol) = upper('Red Widget') order by gene_id limit 1", _GENES)
def symbol_lookup(spark, sf_dir):
    return network.lookup_symbol(part_genes(spark, sf_dir), "Red Widget")


@query("select label from (select distinct p_name as label from part) where len(list_filter(string_split(lower(label), ' '), lambda w: starts_with(w, 'wid'))) > 0 and len(list_filter(string_split(lower(label), ' '), lambda w: starts_with(w, 'r'))) > 0 order by label limit 1000")
def option_filter(spark, sf_dir):
    return network.filter_options(table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct(), "Wid r")


@query("select gene_id, round(log10(read_count) / log10(1000), 6) as color_val, (start_pos + end_pos) / 2 as mid_pos from ge", _GENES)
def gene_plot(spark, sf_dir):
    return network.plotted(part_genes(spark, sf_dir)).select("gene_id", F.round("color_val", 6).alias("color_val"), "mid_pos")


@query("select p_partkey, case when k = 1 then p_name else p_name || '_' || k end as sample_id from (select *, row_number() over (partition by p_name order by p_partkey) as k from part)")
def sample_suffix(spark, sf_dir):
    files = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_partkey").alias("path"))
    return network.unique_names(files).select("p_partkey", "sample_id")


# scalar functions


@query("select distinct s_name, regexp_extract(s_name, '^(.+)#[^#]*$', 1) as target, regexp_extract(s_name, '^.+#([^#]*)$', 1) as hap from supplier where s_name like '_%#%'")
def ref_name_split(spark, sf_dir):
    name = F.translate("s_name", "#", "_")
    return table(spark, sf_dir, "supplier").where("s_name like '_%#%'").select("s_name", bits.target_of(name).alias("target"), bits.haplotype_of(name).alias("hap")).distinct()


@query("select s_suppkey, nullif(regexp_extract('chr' || s_suppkey || '_random', '^(?:CHR(?:OMOSOME)?)?([1-9][0-9]*|X|Y|MT?)', 1, 'i'), '') as chr from supplier")
def chromosome_norm(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", bits.chromosome(F.concat(F.lit("chr"), F.col("s_suppkey").cast("string"), F.lit("_random"))).alias("chr"))


@query("select o_orderkey, 'c' || o_custkey as cell from orders")
def cell_tag(spark, sf_dir):
    name = F.concat(F.repeat(F.lit("x|||"), F.lit(14)), F.lit("c"), F.col("o_custkey").cast("string"), F.lit("|||t"))
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.cell_of(name).alias("cell"))


@query("select event_id, (event_id << 16) | (user_id & 65535) as voffset, event_id as block, user_id & 65535 as within from events")
def virtual_offset(spark, sf_dir):
    v = bits.virtual_offset(F.col("event_id"), F.col("user_id").bitwiseAND(F.lit(65535).cast("bigint")))
    return table(spark, sf_dir, "events").select("event_id", v.alias("voffset"), bits.split_offset(v)["block"].alias("block"), bits.split_offset(v)["within"].alias("within"))


@query("select event_id, user_id as encoded, len(list_filter(range(0, 63), lambda i: (user_id >> i) & 1 = 1)) as ones from events")
def mask_encode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", bits.encode_bits(bits.decode_bits(F.col("user_id"), 40)).alias("encoded"), F.size(bits.set_bits(F.col("user_id"))).cast("long").alias("ones"))


# single operators on columns made from the tables


@query(
    """select flag, tid, count(*) as n from (select l_linenumber * 37 % 256 as flag, l_partkey % 50 as tid, l_suppkey % 50 as mate_tid, l_quantity::int - 2 as mate_pos from lineitem)
where flag & 4 = 0 and (flag & 1 = 0 or (flag & 128 = 0 and flag & 2 <> 0 and tid = mate_tid and mate_pos >= 0)) group by flag, tid"""
)
def valid_mates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 37 % 256).alias("flag"), (F.col("l_partkey") % 50).alias("tid"), (F.col("l_suppkey") % 50).alias("mate_tid"), (F.col("l_quantity").cast("int") - 2).alias("mate_pos"))
    return classes.valid_alignments(lines).groupBy("flag", "tid").agg(F.count("*").alias("n"))


@query("select case when instr(q, ' ') > 1 then split_part(q, ' ', 1) else q end as name, count(*) as n from (select case when event_id % 9 = 0 then ' ' else '' end || event_type || ' ' || user_id as q from events) group by name")
def read_names(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_id") % 9 == 0, " ").otherwise(""), "event_type", F.lit(" "), F.col("user_id").cast("string")).alias("q"))
    return names.groupBy(bits.read_name(F.col("q")).alias("name")).agg(F.count("*").alias("n"))


@query("select distinct ec_key as ec_id, target, substr(target, 7, 1) as hap, 1.0::double as v from (select ec_key, unnest(string_split(ec_key, ',')) as target from (select distinct ec_key from s))", _LINES, _SETS)
def class_incidence(spark, sf_dir):
    """Classes joined with the references that their keys name."""
    counts = _counted(spark, sf_dir, []).withColumn("ec_id", F.col("ec_key"))
    refs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tid"), F.col("p_brand").alias("target"), F.substring("p_brand", 7, 1).alias("hap")).distinct()
    return incidence.incidence(counts, refs)


@query(
    """select target, (row_number() over (order by k, o) - 1)::bigint as target_idx from (
  select target, min(k) as k, min(o) filter (where k = first) as o from (select *, min(k) over (partition by target) as first from (
    select p_name as target, 0 as k, p_partkey as o from part where p_size < 10 union all select p_name, 1, p_partkey from part)) group by target)"""
)
def targets_in_order(spark, sf_dir):
    """Listed targets first, then those that only the header has."""
    part = table(spark, sf_dir, "part")
    listed = part.where("p_size < 10").select(F.col("p_name").alias("target"), F.col("p_partkey").alias("target_idx"))
    return all_targets(listed, part.select(F.col("p_name").alias("target"), F.col("p_partkey").alias("tid")))


@query("select event_id, printf('%02d:%02d:%05.2f', s // 360000, s // 6000 % 60, (s % 6000) / 100.0) as elapsed from (select event_id, event_id * 12525 as s from events)")
def elapsed_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", bits.elapsed(F.col("event_id") * F.lit(125.25)).alias("elapsed"))


@query(
    """select ec_id, target, hap, sum(v) as v from (select * from a union all select ec_id, target, h.hap, 2.0::double from (select distinct ec_id, target from b) cross join (select unnest(['A', 'N', 'R']) as hap) h) group by all""",
    _LINES,
    "b as (select distinct read_id as ec_id, target, hap, 2.0::double as v from al where l_linestatus = 'O')",
)
def add_plane(spark, sf_dir):
    """A matrix without haplotypes, added to every haplotype."""
    plane = _other(spark, sf_dir).select("ec_id", "target", "v").distinct()
    return algebra.add(line_incidence(spark, sf_dir), plane, _haplotypes(spark))


@query("select p_partkey as gene_id, p_size / 2.0 + p_partkey as mid_pos from part where p_size % 7 <> 0")
def plot_without_m(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    genes = part.select(F.col("p_partkey").alias("gene_id"), F.when(F.col("p_size") % 7 == 0, "M").otherwise(F.col("p_type")).alias("chr"), F.col("p_partkey").alias("start_pos"), (F.col("p_partkey") + F.col("p_size")).alias("end_pos"), F.lit(10).alias("read_count"))
    return network.plotted(genes).select("gene_id", "mid_pos")


@query(
    """select ec_key, sample, count(*) as n from (
  select l_orderkey, string_agg(distinct p_brand || ':' || l_returnflag, ',' order by p_brand || ':' || l_returnflag) as ec_key, 's' as sample
  from lineitem join part on l_partkey = p_partkey where l_linestatus = 'F' group by l_orderkey) group by ec_key, sample"""
)
def profile_of_lines(spark, sf_dir):
    """The whole way from alignments and a header's references to a checked profile, by name."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    names = part.select("p_brand").distinct().crossJoin(spark.createDataFrame([(h,) for h in HAPS], "hap string"))  # brands x 3
    refs = names.select(F.concat_ws("_", "p_brand", "hap").alias("ref_name")).withColumns({"target": bits.target_of(F.col("ref_name")), "hap": bits.haplotype_of(F.col("ref_name")), "length": F.lit(100)})
    refs = classes.dense_index(refs.withColumn("_o", F.col("ref_name")), "ref_name", "_o", "tid").join(refs, "ref_name").withColumn("tid", F.col("tid").cast("int"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(refs.select("ref_name", "tid"), F.concat_ws("_", "p_brand", "l_returnflag") == F.col("ref_name"))
    alignments = lines.select(
        F.lit("f").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(" "), F.col("l_linenumber").cast("string")).alias("qname"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(4).alias("flag"), "tid", F.col("l_suppkey").cast("int").alias("pos"), F.lit(-1).alias("mate_tid"), F.lit(-1).alias("mate_pos"),
    )
    p = Profile.of_alignments(alignments, refs, sample="s").checked()
    return p.n.join(collapse.named_keys(p.a), "ec_id").select("ec_key", "sample", "n")


@query("select to_json({gene_id: p_partkey, symbol: p_name})::varchar as json from part")
def gene_list_json(spark, sf_dir):
    return network.as_json(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("symbol")))


@query("select to_json({sample_id: n_name, file: n_regionkey})::varchar as json from nation")
def sample_list_json(spark, sf_dir):
    return network.as_json(table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample_id"), F.col("n_regionkey").alias("file")))
