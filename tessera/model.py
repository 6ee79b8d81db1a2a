"""The data model: long-form tables around an equivalence-class profile.

alignments  file, ord, qname, flag, tid, pos, mate_tid, mate_pos
refs        tid, ref_name, length (from a header), with target and haplotype
A           ec_id, target, hap, v       the sparse incidence of classes
N           ec_id, sample, n            counts per class and sample (or cell)
groups      gene, target                isoforms of genes
A zero is an absent row.  Names are used as keys while computing; dense ordinals
are assigned only when a file format wants them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bits import cell_of, read_name
from .operators import algebra, classes, collapse, incidence, summary
from .sinks.ec import write_tables
from .sources.files import store_of
from .sources.text import all_targets, check_groups
from .tables import written

#: Places of a file in which runs of names are numbered by one task.
RUN_SPAN = 1 << 32


@dataclass(frozen=True)
class Profile:
    """Incidence, counts and dimension tables; immutable, so copies share everything."""

    a: DataFrame
    n: DataFrame
    targets: DataFrame | None = None  # target_idx, target
    haplotypes: DataFrame | None = None  # hap_idx, hap
    samples: DataFrame | None = None  # sample_idx, sample
    lengths: DataFrame | None = None  # target, hap, length
    groups: DataFrame | None = None  # gene, target

    @classmethod
    def of_classes(cls, tables: dict[str, DataFrame]) -> Profile:
        """From the tables of a class file (see sources.ec): numbers become names, masks become rows."""
        named = tables["a"].join(tables["targets"], "target_idx").select("ec_id", "target", "mask")
        n = tables["n"].join(tables["samples"], "sample_idx").select("ec_id", "sample", "n")
        lengths = tables["lengths"].join(tables["targets"], "target_idx").join(tables["haplotypes"], "hap_idx").select("target", "hap", "length")
        return cls(incidence.from_mask(named, tables["haplotypes"]), n, tables["targets"], tables["haplotypes"], tables["samples"], lengths).checked()

    @classmethod
    def of_alignments(
        cls, alignments: DataFrame, refs: DataFrame, sample: str | None = None, minimum: int | None = None, listed: DataFrame | None = None, adjacent: bool = False, drop_trailing: bool = False
    ) -> Profile:
        """From alignments as read_bam gives them and the references of their header.

        Only valid alignments count.  With `sample` all reads are of that sample and
        classes are numbered as they are first seen (file, then place in it).  Without,
        a read's cell is in its name, cells need `minimum` reads (1 at least), and the
        classes left are numbered in the order of their keys.  A read is one name, or,
        if `adjacent`, a run of equal names in a file; `drop_trailing` leaves out each
        file's last name.  Targets are the `listed` ones (target, target_idx) and then
        the others of the header.
        """
        ok = classes.valid_alignments(alignments).withColumn("qname", read_name(F.col("qname")))
        if drop_trailing:
            ok = classes.drop_trailing_read(ok)
        read = ["qname"]
        if adjacent:
            ok, read = classes.number_long_runs(ok, "qname", "ord", ["file"], RUN_SPAN), ["file", "run", "qname"]
        prints = collapse.read_prints(ok, read, "tid", F.struct("file", "ord"))
        cell = F.lit(sample) if sample is not None else F.coalesce(cell_of(F.col("qname")), F.raise_error(F.concat(F.lit("no cell in "), F.col("qname"))).cast("string"))
        counts = prints.withColumn("sample", cell).groupBy(*collapse.PRINT, "sample").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.min(F.struct(*read)).alias("witness"))
        if sample is None:
            counts = classes.keep_cells(counts, minimum or 1, "sample")
        counts = written(counts, "counts")
        named = collapse.print_names(counts, ok, read, "tid").join(counts.groupBy(*collapse.PRINT).agg(F.min("first").alias("first")), collapse.PRINT)
        order = "first" if sample is not None else "ec_key"
        index = classes.dense_index(named.withColumn("_o", F.col(order)), "ec_key", "_o", "ec_id")
        named = written(named.join(index, "ec_key").select(*collapse.PRINT, "ec_key", "ec_id"), "classes")
        n = counts.join(named, collapse.PRINT).select("ec_id", "sample", "n")
        header = refs.groupBy("target").agg(F.min("tid").alias("tid"))
        targets = all_targets(listed, header) if listed is not None else classes.dense_index(header, "target", "tid", "target_idx")
        names = refs.select("hap").distinct()
        samples = counts.select("sample").distinct()
        return cls(
            incidence.incidence(named, refs), n, targets, classes.dense_index(names.withColumn("_o", F.col("hap")), "hap", "_o", "hap_idx"),
            classes.dense_index(samples.withColumn("_o", F.col("sample")), "sample", "_o", "sample_idx"), refs.select("target", "hap", F.col("length").cast("long").alias("length")),
        )

    @classmethod
    def merge(cls, parts: list[Profile]) -> Profile:
        """Several profiles as one, matched by the names of targets, haplotypes and samples.

        Classes with the same targets and haplotypes are one and their counts add up,
        whatever order the files have their names in; classes without rows are one, too.
        Classes, targets and samples are numbered as first seen, haplotypes by name; a
        length is that of the first file that has it.
        """
        a, n = collapse.merged([(p.a, p.n) for p in parts])
        a, n = written(a, "kept_rows"), written(n, "kept_counts")
        index = written(classes.dense_index(n.select("ec_id").unionByName(a.select("ec_id")).withColumn("_o", F.col("ec_id")), "ec_id", "_o", "id"), "merged")
        renumbered = lambda df: df.join(index, "ec_id").drop("ec_id").withColumnRenamed("id", "ec_id")

        def union(table: str, key: str, idx: str, order=None) -> DataFrame:
            rows = [t.select(key, F.struct(F.lit(k).alias("k"), F.col(idx).cast("long").alias("i")).alias("_o")) for k, p in enumerate(parts) if (t := getattr(p, table)) is not None]
            every = reduce(DataFrame.unionByName, rows)
            return classes.dense_index(every if order is None else every.withColumn("_o", F.col(order)), key, "_o", idx)

        sizes = [p.lengths.select("target", "hap", F.struct(F.lit(k).alias("k"), "length").alias("x")) for k, p in enumerate(parts) if p.lengths is not None]
        lengths = reduce(DataFrame.unionByName, sizes).groupBy("target", "hap").agg(F.min("x").alias("x")).select("target", "hap", "x.length") if sizes else None
        groups = [p.groups for p in parts if p.groups is not None]
        return cls(
            renumbered(a).select("ec_id", "target", "hap", "v"), renumbered(n).select("ec_id", "sample", "n"), union("targets", "target", "target_idx"), union("haplotypes", "hap", "hap_idx", "hap"),
            union("samples", "sample", "sample_idx"), lengths, reduce(DataFrame.unionByName, groups).distinct() if groups else None,
        )

    def recollapsed(self) -> Profile:
        """With classes that have the very same rows made one, as after masking or bundling."""
        a, n = collapse.recollapse(self.a, self.n)
        return self.copy(a=a, n=n)

    def class_tables(self) -> dict[str, DataFrame]:
        """The tables of a class file (see sources.ec): names become numbers, rows become masks."""
        masks = incidence.to_mask(self.a, self.haplotypes).join(self.targets, "target").select("ec_id", "target_idx", "mask")
        n = self.n.join(self.samples, "sample").select("ec_id", "sample_idx", "n")
        lengths = self.lengths.join(self.targets, "target").join(self.haplotypes, "hap").select("target_idx", "hap_idx", "length")
        return {"haplotypes": self.haplotypes, "targets": self.targets, "lengths": lengths, "samples": self.samples, "a": masks, "n": n}

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> Profile:
        """From a folder that `save` wrote: all tables that are there, or those named."""
        store, inner, _ = store_of(path)
        names = names or [f.name for f in fields(cls) if store.get_file_info(f"{inner}/{f.name}").type == FileType.Directory]
        return cls(**{k: spark.read.parquet(f"{path}/{k}") for k in names}).checked()

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if (t := getattr(self, f.name)) is not None}

    def save(self, path: str) -> None:
        write_tables(self.tables(), path)

    def checked(self) -> Profile:
        """This profile, or an error when a dimension is empty, a name is twice in its
        dimension, or incidence or counts use a name that its dimension lacks."""
        for table, key, used in (("targets", "target", self.a), ("haplotypes", "hap", self.a), ("samples", "sample", self.n)):
            names = getattr(self, table)
            if names is None:
                continue
            count, distinct = names.agg(F.count("*"), F.count_distinct(key)).first()
            if not count or distinct < count:
                raise ValueError(f"{table}: {count} rows with {distinct} names")
            if missing := used.select(key).distinct().join(names, key, "left_anti").take(1):
                raise KeyError(f"{table} lack {missing[0][0]}")
        return self

    def with_groups(self, groups: DataFrame) -> Profile:
        """With genes, all of whose isoforms must be targets."""
        return self.copy(groups=check_groups(groups, self.targets))

    def copy(self, **changes) -> Profile:
        return replace(self, **changes)

    def pull(self, reads: DataFrame) -> Profile:
        """Only the classes in `reads` (ec_id)."""
        a, n = summary.pull(self.a, self.n, reads)
        return self.copy(a=a, n=n)

    def combine(self, other: Profile, offset: int) -> Profile:
        """The classes and counts of both; those of the other are renumbered from `offset`, none are merged."""
        return self.copy(a=algebra.combine(self.a, other.a, offset), n=algebra.combine_rows(self.n, other.n, offset))

    def finalize(self) -> Profile:
        """Without zeros, kept for repeated use until `release`."""
        return self.copy(a=self.a.where("v <> 0").persist(), n=self.n.where("n <> 0").persist())

    def release(self) -> None:
        self.a.unpersist()
        self.n.unpersist()
