"""Micro fixtures with results derived by hand, round trips and the registered queries against SQL."""

import re
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import tables
from tessera.functions import bits
from tessera.model import Profile
from tessera.operators import algebra, classes, collapse, incidence, network, summary
from tessera.plans import adapters
from tessera.queries import ORACLE, QUERIES
from tessera.sinks import ec as ec_sink
from tessera.sinks.bam import block_of, split_bam
from tessera.sinks.ec import read_viewer, write_ec, write_read_samples, write_samples, write_viewer
from tessera.sources import bam, ec, fastq, text

SF = "/root/testdata/sf0.001"
REFS = [(0, "T1_A", 100), (1, "T1_B", 101), (2, "T2_A", 200), (3, "T2_B", 201)]
ROWS = [  # qname, flag, tid, pos, mate_tid, mate_pos
    ("r1", 0, 0, 5, -1, -1), ("r1", 0, 1, 7, -1, -1), ("r2", 0, 0, 9, -1, -1), ("r2", 0, 1, 9, -1, -1), ("r3", 0, 2, 50, -1, -1),
    ("r3", 0, 2, 60, -1, -1), ("r4", 4, -1, -1, -1, -1), ("r5", 1 | 128, 3, 3, 3, 9), ("r6", 0, 1, 20, -1, -1),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return bam.BLOCK_MAGIC + bytes.fromhex("0000000000ff0600424302 00".replace(" ", "")) + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@pytest.fixture(scope="module")
def bam_file(tmp_path_factory):
    data = b"BAM\1" + struct.pack("<ii", 0, len(REFS))
    for _, name, size in REFS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    for q, flag, tid, pos, mt, mp in ROWS:
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(q) + 1, 0, 0, 0, flag, 0, mt, mp, 0) + q.encode() + b"\0"
        data += struct.pack("<i", len(body)) + body
    path = tmp_path_factory.mktemp("bam") / "x.bam"
    path.write_bytes(block(data[:150]) + block(data[150:]) + bam.END_BLOCK)  # a record straddles blocks
    return str(path)


def test_single_sample(spark, bam_file):
    al, refs = bam.read_bam(spark, bam_file), bam.read_refs(spark, bam_file)
    assert al.count() == 9
    ok = classes.valid_alignments(al)
    assert ok.count() == 7
    sets = classes.read_sets(ok, ["qname"])
    counts = classes.count_classes(sets).withColumn("ec_id", F.col("ec_key"))
    assert rows(counts.select("ec_key", "n")) == [("0,1", 2), ("1", 1), ("2", 1)]
    a = incidence.incidence(counts, refs)
    haps = spark.createDataFrame([(0, "A"), (1, "B")], "hap_idx int, hap string")
    masked = incidence.to_mask(a, haps)
    assert rows(masked) == [("0,1", "T1", 3), ("1", "T1", 2), ("2", "T2", 1)]
    assert rows(incidence.from_mask(masked, haps).select("ec_id", "target", "hap")) == rows(a.select("ec_id", "target", "hap"))
    n = counts.select("ec_id", F.lit("s").alias("sample"), "n")
    report = summary.alignment_report(a, n, ["A", "B"], refs.select("target").distinct())
    assert rows(report) == [("T1", 2.0, 3.0, 0.0, 1.0, 3), ("T2", 1.0, 0.0, 1.0, 0.0, 1)]
    assert rows(summary.target_span(ok, refs)) == [("T1", "A", 5), ("T1", "B", 14), ("T2", "A", 11), ("T2", "B", 0)]
    groups = spark.createDataFrame([("g1", "T1"), ("g2", "T2")], "gene string, target string")
    types = spark.createDataFrame([("g1", "A"), ("g2", "A"), ("g2", "B")], "gene string, hap string")
    assert rows(incidence.to_mask(summary.genotype_mask(a, groups, types), haps)) == [("0,1", "T1", 1), ("2", "T2", 1)]
    one = summary.normalize(a, "read").where("ec_id = '0,1'")
    assert [r.v for r in one.collect()] == [0.5, 0.5]


def bam_bytes(records, block_size):
    data = b"BAM\1" + struct.pack("<ii", 0, len(REFS))
    for _, name, size in REFS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    for q, flag, tid, pos, mt, mp in records:
        bases = 30
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(q) + 1, 9, 0, 1, flag, bases, mt, mp, 0) + q.encode() + b"\0" + struct.pack("<I", bases << 4) + bytes(15) + bytes(bases)
        data += struct.pack("<i", len(body)) + body
    return b"".join(block(data[k : k + block_size]) for k in range(0, len(data), block_size)) + bam.END_BLOCK


@pytest.mark.parametrize("block_size", [150, 2500])
def test_one_file_in_many_partitions(spark, tmp_path, block_size):
    """Records straddle blocks and ranges; each is read once, in order, whatever the ranges."""
    made = [(f"read{k:05}" + "x" * (k % 17), 0, k % 4, k, -1, -1) for k in range(400)]
    (tmp_path / "a").mkdir()
    for name, some in (("a/one.bam", made), ("two.BAM", made[:7]), ("none.bam", [])):
        (tmp_path / name).write_bytes(bam_bytes(some, block_size))
    whole = bam.read_bam(spark, str(tmp_path / "a" / "one.bam"))
    assert whole.rdd.getNumPartitions() == 1
    for split in (1_500, 4_000):
        part = bam.read_bam(spark, str(tmp_path / "a"), split)
        assert part.rdd.getNumPartitions() >= 2
        assert [r.qname for r in part.orderBy("ord").collect()] == [q for q, *_ in made] == [r.qname for r in whole.orderBy("ord").collect()]
        assert rows(part.select("ord", "qname", "tid", "pos", "mate_pos")) == rows(whole.select("ord", "qname", "tid", "pos", "mate_pos"))
    assert bam.read_bam(spark, str(tmp_path), 4_000).count() == 407  # every file of the folder
    (tmp_path / "cut.bam").write_bytes(bam_bytes(made[:3], 97)[:-5])
    with pytest.raises(ValueError):
        bam.check_file(str(tmp_path / "cut.bam"))


LONG_SIZES = [20] * 12 + [250_000] + [35] * 900 + [600_000] + [500] * 600 + [1_500_000, 10, 300_000] + [44] * 900 + [700_000]


@pytest.fixture(scope="module")
def long_file(tmp_path_factory):
    """Records of up to 1.5 million bases among short ones; quality bytes look like records."""
    data = b"BAM\1" + struct.pack("<ii", 0, len(REFS))
    for _, name, size in REFS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    out, fake = [data], struct.pack("<iiiBBHHHiiii", 60, 1, 5, 3, 9, 0, 1, 0, 10, -1, -1, 0) + b"no\0" + bytes(25)
    for k, bases in enumerate(LONG_SIZES):
        q = f"read{k // 2}".encode()
        quality = (fake * (bases // len(fake) + 1))[:bases] if k % 2 else bytes((7 * i + k) % 41 for i in range(min(bases, 997))) * (bases // 997 + 1)
        body = struct.pack("<iiBBHHHiiii", k % 4, k, len(q) + 3, 9, 0, 1, 0, bases, -1, -1, 0) + q + b" x\0" + struct.pack("<I", bases << 4) + bytes((bases + 1) // 2) + quality[:bases]
        out.append(struct.pack("<i", len(body)) + body)
    data, path = b"".join(out), tmp_path_factory.mktemp("long") / "long.bam"
    path.write_bytes(b"".join(block_of(data[k : k + 60_000], 1) for k in range(0, len(data), 60_000)) + bam.END_BLOCK)
    return str(path)


@pytest.mark.parametrize("split", [3_000, 20_000, 100_000, 64 << 20])
def test_splits_are_exact_whatever_the_records(spark, long_file, split):
    """Wrong guesses inside long records, and ranges that one record fills, are put right."""
    got = bam.read_bam(spark, long_file, split).orderBy("ord").select("qname", "tid", "pos").collect()
    assert [tuple(r) for r in got] == [(f"read{k // 2}", k % 4, k) for k in range(len(LONG_SIZES))]


def test_wrong_guesses_are_found(spark, long_file, monkeypatch):
    """Even with a guess at every record-like place, and with none at all, the ranges agree."""
    want = rows(bam.record_ranges(spark, long_file, 10_000).select("number", "start", "stop", "records"))
    for guess in (lambda path, cut, n: None, lambda path, cut, n: (bam.first_block(bam.open_file(path), cut) or 0) << 16):
        monkeypatch.setattr(bam, "guess_record", guess)
        assert rows(bam.record_ranges(spark, long_file, 10_000).select("number", "start", "stop", "records")) == want
    assert sum(r[3] for r in want) == len(LONG_SIZES)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_split_alignment_file(spark, long_file, tmp_path, parts):
    made = split_bam(spark, long_file, parts, str(tmp_path)).collect()
    assert len(made) == parts and sum(r.records for r in made) == len(LONG_SIZES)
    whole, back = bam.read_bam(spark, long_file), bam.read_bam(spark, str(tmp_path))
    assert rows(back.select("qname", "tid", "pos", "flag")) == rows(whole.select("qname", "tid", "pos", "flag"))
    assert back.groupBy("qname").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0  # no read in two files
    assert rows(bam.read_refs(spark, str(tmp_path / "part_0.bam"))) == rows(bam.read_refs(spark, long_file))


def test_mate_rules(spark):
    one = ("q", 0, 0, 0, 0, 0)
    cases = [(1 | 2, 0, 0, True), (1, 0, 0, False), (1 | 2, 1, 0, False), (1 | 2, 0, -1, False), (1 | 2 | 128, 0, 0, False), (0, -1, -1, True), (4, 0, 0, False)]
    for flag, mate, mate_pos, ok in cases:
        df = spark.createDataFrame([(one[0], flag, 0, 5, mate, mate_pos)], "qname string, flag int, tid int, pos int, mate_tid int, mate_pos int")
        assert (classes.valid_alignments(df).count() == 1) == ok
    assert [spark.range(1).select(bits.read_name(F.lit(x))).first()[0] for x in ("a b c", " a", "ab")] == ["a", " a", "ab"]
    assert bits.partition_bounds(7, 3) == [(0, 3), (3, 5), (5, 7)] and bits.partition_bounds(2, 5) == [(0, 1), (1, 2)]


def test_masks_and_sets_agree(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (3, "a"), (3, "b"), (3, "a")], "read int, target string")
    loci = ["b", "a"]
    masks = classes.read_masks(df, ["read"], F.array_position(F.array(*map(F.lit, loci)), F.col("target")) - 1)
    named = classes.name_masks(classes.count_classes(masks, key="mask"), loci)
    assert rows(named) == rows(classes.count_classes(classes.read_sets(df, ["read"], "target"))) == [("a", 1), ("a,b", 2)]
    assert classes.total_count(named).first().n == 3
    cells = spark.createDataFrame([("a", "c", 1), ("a,b", "c", 2)], "ec_key string, cell string, n long")
    assert rows(classes.renumbered(cells).select("ec_id", "ec_key")) == [(0, "a"), (1, "a,b")]


def test_long_runs_equal_runs(spark):
    made = [("x" if k % 5 else "y", k, (k // 3) % 2) for k in range(200)] + [("z", 3, 1)]
    df = spark.createDataFrame(made, "g string, o long, q int")
    want = rows(classes.number_runs(df, "q", "o", ["g"]).select("g", "o", "run"))
    assert all(rows(classes.number_long_runs(df, "q", "o", ["g"], span).select("g", "o", "run")) == want for span in (1, 7, 1000))


def test_profile(spark, tmp_path):
    names = {"haplotypes": [(0, "A"), (1, "B")], "targets": [(0, "T1"), (1, "T2")], "samples": [(0, "s")]}
    tables = {k: spark.createDataFrame(v, f"{c}_idx long, {c} string") for (k, v), c in zip(names.items(), ("hap", "target", "sample"), strict=True)}
    tables |= {"a": spark.createDataFrame([(0, 0, 3), (1, 1, 2)], "ec_id long, target_idx long, mask long"), "n": spark.createDataFrame([(0, 0, 4), (1, 0, 2)], "ec_id long, sample_idx long, n long")}
    tables["lengths"] = spark.createDataFrame([(0, 0, 5), (0, 1, 6), (1, 0, 7), (1, 1, 8)], "target_idx long, hap_idx long, length long")
    p = Profile.of_classes(tables)
    assert rows(p.a) == [(0, "T1", "A", 1.0), (0, "T1", "B", 1.0), (1, "T2", "B", 1.0)] and rows(p.n) == [(0, "s", 4), (1, "s", 2)]
    p.save(str(tmp_path / "p"))
    back = Profile.load(spark, str(tmp_path / "p"))
    assert rows(back.a) == rows(p.a) and rows(back.n) == rows(p.n)
    both = p.combine(p, 2)
    assert rows(both.n) == [(0, "s", 4), (1, "s", 2), (2, "s", 4), (3, "s", 2)] and both.a.count() == 6
    assert rows(p.pull(spark.createDataFrame([(1,)], "ec_id long")).a) == [(1, "T2", "B", 1.0)]
    kept = p.copy(a=p.a.unionByName(p.a.limit(1).withColumn("v", F.lit(0.0)))).finalize()
    assert kept.a.count() == 3
    kept.release()
    with pytest.raises(KeyError):
        p.with_groups(spark.createDataFrame([("g", "T9")], "gene string, target string"))
    with pytest.raises(KeyError):
        p.copy(targets=tables["targets"].limit(1)).checked()
    with pytest.raises(ValueError):
        p.copy(samples=tables["samples"].limit(0)).checked()
    two = spark.createDataFrame([(0, "T1", 2.0)], "ec_id long, target string, v double")
    assert rows(algebra.add(p.a, two, tables["haplotypes"])) == [(0, "T1", "A", 3.0), (0, "T1", "B", 3.0), (1, "T2", "B", 1.0)]
    assert rows(algebra.add_value(p.a, p.a.where("ec_id = 1"))) == [(0, "T1", "A", 1.0), (0, "T1", "B", 1.0), (1, "T2", "B", 2.0)]


def test_reports_and_keys(spark, tmp_path):
    totals = spark.createDataFrame([("s", "g1", 2), ("s", "g2", 0)], "sample_id string, gene_id string, read_count long")
    edges = spark.createDataFrame([("s", "g1", "g2", 1)], "sample_id string, gene_id_1 string, gene_id_2 string, read_count long")
    genes = spark.createDataFrame([("g1", "x"), ("g2", "y")], "gene_id string, symbol string")
    samples = spark.createDataFrame([("s", "f.bam")], "sample_id string, file string")
    write_viewer(str(tmp_path / "v"), totals, edges, genes, samples)
    assert rows(spark.read.parquet(str(tmp_path / "v" / "gene_edge"))) == rows(edges)
    back = read_viewer(spark, str(tmp_path / "v"))
    assert rows(back["gene_info"]) == rows(genes) and rows(network.as_json(back["sample"])) == [('{"sample_id":"s","file":"f.bam"}',)]
    with pytest.raises(ValueError):
        write_viewer(str(tmp_path / "w"), totals.union(totals), edges, genes, samples)
    assert network.exactly_one(network.lookup_gene(genes, "g2")).symbol == "y"
    with pytest.raises(LookupError):
        network.exactly_one(network.lookup_gene(genes, "g3"))
    assert rows(network.as_json(genes.limit(1))) == [('{"gene_id":"g1","symbol":"x"}',)]
    write_samples(samples, str(tmp_path / "s"))
    assert rows(text.read_samples(spark, str(tmp_path / "s"))) == [("s", "f.bam")]
    write_read_samples(spark.createDataFrame([("r1",)], "read_id string"), "s", str(tmp_path / "m"))
    write_read_samples(spark.createDataFrame([("r2",)], "read_id string"), "t", str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m"))) == [("r1", "s"), ("r2", "t")]
    spans = spark.createDataFrame([("b", "A", 4), ("a", "B", 2)], "target string, hap string, span long")
    assert [tuple(r) for r in summary.span_table(spans, ["A", "B"]).collect()] == [("a", 0, 2), ("b", 4, 0)]
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "target string")
    text.check_same([names("a", "b"), names("b", "a")], "target")
    with pytest.raises(ValueError):
        text.check_same([names("a"), names("a", "c")], "target")
    listed, header = spark.createDataFrame([("b", 0), ("a", 1)], "target string, target_idx long"), spark.createDataFrame([("a", 0), ("c", 1)], "target string, tid int")
    assert rows(text.all_targets(listed, header)) == [("a", 1), ("b", 0), ("c", 2)]


def test_stream_counts(spark, tmp_path):
    from tessera.streaming.counts import windowed_counts

    spark.sql("select timestamp'2024-01-01 00:01:00' as t, 'a' as k union all select timestamp'2024-01-01 00:02:00', 'a'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "t", ["k"]).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("counted").collect()] == [2]


def fastq_bytes(n):
    """Records whose qualities begin with @ and + and so look like names."""
    out = []
    for k in range(n):
        size = 20 + 7 * (k % 40)
        out.append(f"@read{k} extra\n{('ACGT' * 80)[k % 3:][:size]}\n+\n{('@+' * 200)[k % 2:][:size]}\n")
    return "".join(out).encode()


@pytest.mark.parametrize("split", [500, 5_000, 1 << 20])
def test_compressed_fastq_in_ranges(spark, tmp_path, split):
    data = fastq_bytes(3_000)
    blocked = b"".join(block_of(data[k : k + 7_001]) for k in range(0, len(data), 7_001)) + bam.END_BLOCK
    (tmp_path / "x.fastq.gz").write_bytes(blocked)
    (tmp_path / "plain.fastq").write_bytes(data)
    got = fastq.read_blocked_fastq(spark, str(tmp_path / "x.fastq.gz"), split)
    assert split > len(blocked) or got.rdd.getNumPartitions() > 5
    lines = data.decode().split("\n")
    want = [(lines[k][1:].split()[0], lines[k + 1], lines[k + 3]) for k in range(0, len(lines) - 1, 4)]
    assert [tuple(r) for r in got.orderBy("ord").select("read_id", "sequence", "quality").collect()] == want
    assert rows(text.read_fastq(spark, str(tmp_path / "x.fastq.gz"), split)) == rows(text.read_fastq(spark, str(tmp_path / "plain.fastq"))) == rows(spark.createDataFrame([w[:2] for w in want], "a string, b string"))
    (tmp_path / "odd.fastq.gz").write_bytes(block_of(data[:-30]) if len(data) < 60_000 else block_of(data[:1000]) + bam.END_BLOCK)
    with pytest.raises(Exception, match="record|bytes that are none"):
        fastq.read_blocked_fastq(spark, str(tmp_path / "odd.fastq.gz"), 1 << 20).count()


def test_stream_of_reads(spark, tmp_path):
    """Reads close by watermark, in whatever batches their alignments come; batch and stream agree on `events`."""
    from tessera.streaming.classes import add_counts, closed_reads, counted

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("qname"), F.col("event_type").alias("locus"), F.col("ts").alias("time"))
    span = events.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    parts = 4
    for k in range(parts):  # each read's alignments are spread over the batches of its days
        low, high = span.a + (span.b - span.a) * k / parts, span.a + (span.b - span.a) * (k + 1) / parts
        events.where((F.col("time") >= F.lit(low)) & (F.col("time") < F.lit(high)) | (F.lit(k == parts - 1) & (F.col("time") == F.lit(high)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([("end", "x")], "qname string, locus string").withColumn("time", F.lit(span.b) + F.expr("interval 30 days"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closed = closed_reads(stream, "qname", "locus", "time", gap="36 hours", late="2 days")
    q = closed.writeStream.foreachBatch(add_counts(str(tmp_path / "totals"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = classes.count_classes(classes.read_sets(events, ["qname"], "locus")).select("ec_key", "n")
    assert rows(counted(spark, str(tmp_path / "totals")).select("ec_key", "n")) == rows(want)


def test_multisample(spark):
    reads = [("f1", 0, "q1", "c1", 0), ("f1", 1, "q2", "c1", 0), ("f1", 2, "q3", "c2", 0), ("f1", 3, "q3", "c2", 2), ("f2", 0, "q4", "c2", 0), ("f2", 1, "q4", "c2", 2), ("f2", 2, "q5", "c1", 2)]
    al = spark.createDataFrame(reads, "file string, ord int, qname string, cell string, tid int")
    count = lambda x: classes.count_classes(classes.read_sets(x, ["qname", "cell"]), ["cell"])
    assert rows(count(al)) == [("0", "c1", 2), ("0,2", "c2", 2), ("2", "c1", 1)]
    assert rows(count(classes.drop_trailing_read(al))) == [("0", "c1", 2), ("0,2", "c2", 1)]
    assert rows(classes.keep_cells(count(al), 3).select("ec_key", "cell", "n")) == [("0", "c1", 2), ("2", "c1", 1)]
    b = spark.createDataFrame([(1, "T1"), (2, "T1"), (2, "T2"), (3, "T2")], "ec_id int, gene string")
    n = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "ec_id int, n long")
    assert rows(network.shared_reads(b, n)) == [("T1", "T1", 4), ("T1", "T2", 2), ("T2", "T1", 2), ("T2", "T2", 3)]


def test_edges(spark):
    one = spark.range(1)
    name = lambda s: tuple(one.select(bits.target_of(F.lit(s)), bits.haplotype_of(F.lit(s))).first())
    assert [name(s) for s in ("A_B_C", "_A", "NOUND", "X_")] == [("A_B", "C"), ("_A", ""), ("NOUND", ""), ("X", "")]
    chrom = lambda s: one.select(bits.chromosome(F.lit(s))).first()[0]
    assert [chrom(s) for s in ("chr1", "chr1_random", "x", "MT", "Mito", "XY", "GL0001", "0", "chrUn")] == ["1", "1", "x", "MT", "M", "X", None, None, None]
    assert one.select(bits.set_bits(F.lit(121))).first()[0] == [0, 3, 4, 5, 6]
    assert one.select(bits.elapsed(F.lit(3725.5))).first()[0] == "01:02:05.50"
    runs = classes.number_runs(spark.createDataFrame([(0, "r1"), (1, "r2"), (2, "r1")], "ord int, q string").withColumn("f", F.lit(1)), "q", "ord", ["f"])
    assert runs.select("q", "run").distinct().count() == 3
    assert rows(classes.read_sets(spark.createDataFrame([(1, 2), (1, 10)], "q int, tid int"), ["q"])) == [(1, "10,2")]


def test_text_sources(spark, tmp_path):
    put = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    assert rows(text.read_targets(spark, put("t", "#c\nb x\n\na\nb\n#d\nc\n"))) == [("a", 1), ("b", 0), ("c", 2)]
    assert rows(text.read_groups(spark, put("g", "g1\ta\tb\ng2\tc\n"))) == [("g1", "a"), ("g1", "b"), ("g2", "c")]
    assert rows(text.read_genotypes(spark, put("y", "#h\n#i\ng1\tAB\n"))) == [("g1", "A"), ("g1", "B")]
    genes, groups = text.read_gene_info(spark, put("i", "G\tchr2\t1\t9\t+\tsym\tname\tt1,t2\nH\tchrUn\t1\t9\t+\ts\tn\tt3\n"))
    assert rows(groups) == [("G", "t1"), ("G", "t2")] and genes.first().chromosome == "2"
    assert rows(text.read_fastq(spark, put("q", "@a 1\nAC\n+\n!!\n@b\nGT\n+\n@@\n"))) == [("a", "AC"), ("b", "GT")]
    ecs, targets = text.read_salmon(spark, put("e", "2\n2\nT_A\nT_B\n1\t0\t5\n2\t0\t1\t7\n"), put("u", "Name\tLength\tEffectiveLength\nT_A\t9\t8.5\nT_B\t7\t6.5\n"))
    with pytest.raises(Exception, match="no effective length"):
        text.read_salmon(spark, str(tmp_path / "e"), put("u2", "Name\tLength\tEffectiveLength\nT_A\t9\t8.5\n"))[1].collect()
    assert rows(text.read_salmon_targets(spark, put("t2", "T_B\t7\nT_C\t5\n"), targets)) == [("T_A", 0), ("T_B", 1), ("T_C", 2)]
    text.split_fastq(spark, str(tmp_path / "q"), 2, str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == 8
    assert rows(ecs.select("idx", "n")) == [(0, 5), (0, 7), (1, 7)] and rows(targets) == [("T_A", 0, 8.5), ("T_B", 1, 6.5)]


def test_class_file_round_trip(spark, tmp_path):
    made = {
        "haplotypes": spark.createDataFrame([(0, "A"), (1, "B")], "hap_idx long, hap string"),
        "targets": spark.createDataFrame([(0, "T1"), (1, "Tä")], "target_idx long, target string"),
        "samples": spark.createDataFrame([(0, "s0"), (1, "s1"), (2, "s2")], "sample_idx long, sample string"),
        "lengths": spark.createDataFrame([(0, 0, 5), (0, 1, 6), (1, 0, 7), (1, 1, 0)], "target_idx long, hap_idx long, length long"),
        "a": spark.createDataFrame([(0, 0, 3), (0, 1, 1), (2, 1, 2)], "ec_id long, target_idx long, mask long"),
        "n": spark.createDataFrame([(0, 0, 4), (2, 2, 9)], "ec_id long, sample_idx long, n long"),
    }
    path = str(tmp_path / "x.ec")
    write_ec(path, made, 3)
    back = ec.read_ec(spark, path)
    assert all(rows(back[t]) == rows(made[t]) for t in made)
    both = Profile.merge([Profile.of_classes(back)] * 2)
    assert rows(both.n) == [(0, "s0", 8), (1, "s2", 18)] and rows(collapse.named_keys(both.a)) == [(0, "T1:A,T1:B,Tä:A"), (1, "Tä:B")]
    assert rows(both.class_tables()["a"]) == [(0, 0, 3), (0, 1, 1), (1, 1, 2)]


def _matrix(cells: dict[tuple[int, int], int], size: int) -> bytes:
    starts = [sum(k[0] < m for k in cells) for m in range(size + 1)]
    order = sorted(cells)
    return struct.pack(f"<{2 + len(starts) + 2 * len(order)}i", size + 1, len(order), *starts, *[k[1] for k in order], *[cells[k] for k in order])


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_class_file_from_ranges(spark, tmp_path, monkeypatch, adaptive):
    """Slices that tasks wrote give the very bytes of a plain writer: a row that holds nearly all
    entries, rows without any between, before and after, steps smaller than a slice, empty matrices."""
    monkeypatch.setattr(ec_sink, "STEP", 50)
    monkeypatch.setattr(ec, "RANGE_ROWS", 70)
    a = {(m, t): (m + t) % 3 + 1 for m in (*range(100, 400, 3), 700) for t in range(m % 5)}
    n = {**{(1, m): m + 1 for m in range(0, 900, 2)}, (3, 5): 7, (3, 899): 1}
    frame = lambda cells, names: spark.createDataFrame([(*k, v) for k, v in cells.items()], names).repartition(7)
    tables = {
        "haplotypes": spark.createDataFrame([(0, "A"), (1, "B")], "hap_idx long, hap string"), "lengths": spark.createDataFrame([(0, 0, 5)], "target_idx long, hap_idx long, length long"),
        "targets": spark.createDataFrame([(t, f"T{t}") for t in range(5)], "target_idx long, target string"), "samples": spark.createDataFrame([(s, f"s{s}") for s in range(5)], "sample_idx long, sample string"),
        "a": frame(a, "ec_id long, target_idx long, mask long"), "n": frame(n, "sample_idx long, ec_id long, n long"),
    }
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        write_ec(str(tmp_path / "x.ec"), tables, 900)
        write_ec(f"file://{tmp_path}/none.ec", dict(tables, a=tables["a"].where("false"), n=tables["n"].where("false")), 900)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert (tmp_path / "x.ec").read_bytes().endswith(_matrix(a, 900) + _matrix(n, 5))
    assert (tmp_path / "none.ec").read_bytes().endswith(_matrix({}, 900) + _matrix({}, 5))
    back = ec.read_ec(spark, f"file://{tmp_path}/x.ec")
    assert rows(back["a"]) == rows(tables["a"]) and rows(back["n"].select("sample_idx", "ec_id", "n")) == rows(tables["n"])


def test_class_file_refuses_what_it_cannot_hold(spark, tmp_path):
    one = lambda *r: spark.createDataFrame(list(r), "ec_id long, target_idx long, mask long")
    tables = {
        "haplotypes": spark.createDataFrame([(0, "A")], "hap_idx long, hap string"), "lengths": spark.createDataFrame([(0, 0, 5)], "target_idx long, hap_idx long, length long"),
        "targets": spark.createDataFrame([(0, "T")], "target_idx long, target string"), "samples": spark.createDataFrame([(0, "s")], "sample_idx long, sample string"),
        "n": spark.createDataFrame([(0, 0, 1)], "ec_id long, sample_idx long, n long"),
    }
    for bad in (one((2, 0, 1)), one((0, 1, 1)), one((0, 0, -1)), one((0, 0, 1 << 31)), one((0, 0, None)), one((0, 0, 1), (0, 0, 1))):
        with pytest.raises(Exception, match="outside a matrix|two entries"):
            write_ec(str(tmp_path / "bad.ec"), dict(tables, a=bad), 2)
    assert not list(tmp_path.iterdir())


def test_profile_of_a_single_sample(spark, bam_file, tmp_path):
    """Fixture A from the file to the reports, and through a class file and a folder of tables."""
    al, refs = bam.read_bam(spark, bam_file), bam.read_refs(spark, bam_file)
    p = Profile.of_alignments(al, refs, sample="s").checked()
    keys = {r.ec_id: r.ec_key for r in collapse.named_keys(p.a).collect()}
    assert keys == {0: "T1:A,T1:B", 1: "T2:A", 2: "T1:B"} and rows(p.n) == [(0, "s", 2), (1, "s", 1), (2, "s", 1)]  # first seen first
    assert rows(p.targets) == [("T1", 0), ("T2", 1)] and rows(p.lengths) == [("T1", "A", 100), ("T1", "B", 101), ("T2", "A", 200), ("T2", "B", 201)]
    tables = p.class_tables()
    assert rows(tables["a"]) == [(0, 0, 3), (1, 1, 1), (2, 0, 2)]
    write_ec(str(tmp_path / "a.ec"), tables, 3)
    again = Profile.of_classes(ec.read_ec(spark, str(tmp_path / "a.ec")))
    assert rows(again.a.select("ec_id", "target", "hap")) == rows(p.a.select("ec_id", "target", "hap")) and rows(again.n) == rows(p.n)
    report = summary.alignment_report(p.a, p.n, ["A", "B"], p.targets)
    assert rows(report) == [("T1", 2.0, 3.0, 0.0, 1.0, 3), ("T2", 1.0, 0.0, 1.0, 0.0, 1)]
    assert {r.ec_key: r.n for r in Profile.of_alignments(al, refs, sample="s", adjacent=True).n.join(collapse.named_keys(p.a), "ec_id").collect()} == {"T1:A,T1:B": 2, "T2:A": 1, "T1:B": 1}
    whole = p.with_groups(spark.createDataFrame([("g1", "T1"), ("g2", "T2")], "gene string, target string"))
    whole.save(str(tmp_path / "p"))
    back = Profile.load(spark, str(tmp_path / "p"))
    assert set(back.tables()) == {"a", "n", "targets", "haplotypes", "samples", "lengths", "groups"}
    assert all(rows(back.tables()[t]) == rows(df) for t, df in whole.tables().items())
    assert rows(Profile.of_alignments(al, refs, sample="s", listed=spark.createDataFrame([("T2", 0)], "target string, target_idx long")).targets) == [("T1", 1), ("T2", 0)]


def test_reads_may_come_back(spark):
    """r1, r2, r1 are two reads by name and three by adjacency; names end at their first space."""
    made = [("f", 0, "r1 x", 0), ("f", 1, "r1 y", 1), ("f", 2, "r2", 0), ("f", 3, "r1", 2)]
    al = spark.createDataFrame([(f, o, q, 0, t, o, -1, -1) for f, o, q, t in made], bam.SCHEMA)
    refs = spark.createDataFrame([(i, n, size, *n.split("_")) for i, n, size in REFS], "tid int, ref_name string, length int, target string, hap string")
    counts = lambda **k: {r.ec_key: r.n for p in [Profile.of_alignments(al, refs, sample="s", **k)] for r in p.n.join(collapse.named_keys(p.a), "ec_id").collect()}
    assert counts() == {"T1:A,T1:B,T2:A": 1, "T1:A": 1}
    assert counts(adjacent=True) == {"T1:A,T1:B": 1, "T1:A": 1, "T2:A": 1}


def test_profile_of_cells(spark):
    """Fixture B: two files, cells in the names, a minimum count, and the compatible loss of the last reads."""
    tag = "|||".join
    reads = [("f1", "q1", "c1", [0]), ("f1", "q2", "c1", [0]), ("f1", "q3", "c2", [0, 2]), ("f2", "q4", "c2", [0, 2]), ("f2", "q5", "c1", [2])]
    made = [(f, 10 * k + i, tag([q, *"abcdefghijklm", c]), 0, t, 1, -1, -1) for k, (f, q, c, tids) in enumerate(reads) for i, t in enumerate(tids)]
    al = spark.createDataFrame(made, bam.SCHEMA)
    refs = spark.createDataFrame([(i, n, size, *n.split("_")) for i, n, size in REFS], "tid int, ref_name string, length int, target string, hap string")

    def counts(**k):
        p = Profile.of_alignments(al, refs, **k)
        return rows(p.n.join(collapse.named_keys(p.a), "ec_id").select("ec_key", "sample", "n"))

    assert counts() == [("T1:A", "c1", 2), ("T1:A,T2:A", "c2", 2), ("T2:A", "c1", 1)]
    assert counts(drop_trailing=True) == [("T1:A", "c1", 2), ("T1:A,T2:A", "c2", 1)]
    assert counts(minimum=3) == [("T1:A", "c1", 2), ("T2:A", "c1", 1)]
    assert counts(minimum=3, drop_trailing=True) == []
    p = Profile.of_alignments(al, refs, minimum=3)
    assert rows(p.n.select("ec_id").distinct()) == [(0,), (1,)] and rows(p.samples) == [("c1", 0)]
    with pytest.raises(Exception, match="no cell in plain"):
        Profile.of_alignments(al.withColumn("qname", F.lit("plain")), refs).n.count()


def class_file(spark, haps, targets, samples, a, n):
    frame = lambda kind, names: spark.createDataFrame(list(enumerate(names)), f"{kind}_idx long, {kind} string")
    t = {"haplotypes": frame("hap", haps), "targets": frame("target", targets), "samples": frame("sample", samples)}
    t["lengths"] = spark.createDataFrame([(i, j, 10 * i + j) for i in range(len(targets)) for j in range(len(haps))], "target_idx long, hap_idx long, length long")
    return Profile.of_classes(t | {"a": spark.createDataFrame(a, "ec_id long, target_idx long, mask long"), "n": spark.createDataFrame(n, "ec_id long, sample_idx long, n long")})


def test_class_file_of_version_1(spark, tmp_path):
    """Version 1 has no samples: counts belong to the file; other versions are refused."""
    text = lambda t: struct.pack("<i", len(t.encode())) + t.encode()
    head = struct.pack("<ii", 1, 2) + text("A") + text("B") + struct.pack("<i", 2) + text("T1") + struct.pack("<ii", 5, 6) + text("Tä") + struct.pack("<ii", 7, 8)
    body = struct.pack("<ii", 4, 4) + struct.pack("<4i", 0, 2, 2, 4) + struct.pack("<4i", 0, 1, 0, 1) + struct.pack("<4i", 3, 1, 2, 2) + struct.pack("<i", 3) + struct.pack("<3i", 4, 9, 1)
    (tmp_path / "old.ec").write_bytes(head + body)
    tables = ec.read_ec(spark, str(tmp_path / "old.ec"))
    assert rows(tables["samples"]) == [(0, "old.ec")] and rows(tables["n"]) == [(0, 0, 4), (1, 0, 9), (2, 0, 1)]
    assert rows(tables["a"]) == [(0, 0, 3), (0, 1, 1), (2, 0, 2), (2, 1, 2)] and rows(tables["lengths"]) == [(0, 0, 5), (0, 1, 6), (1, 0, 7), (1, 1, 8)]
    p = Profile.of_classes(tables)
    assert rows(collapse.named_keys(p.a)) == [(0, "T1:A,T1:B,Tä:A"), (2, "T1:B,Tä:B")] and rows(p.n) == [(0, "old.ec", 4), (1, "old.ec", 9), (2, "old.ec", 1)]
    (tmp_path / "none.ec").write_bytes(struct.pack("<i", 0))
    with pytest.raises(Exception, match="version 0"):
        ec.read_ec(spark, str(tmp_path / "none.ec"))["a"].count()


def test_two_dimensional_operands(spark):
    a = spark.createDataFrame([(0, "T", "A", 1.0), (1, "T", "B", 4.0)], "ec_id long, target string, hap string, v double")
    plane, haps = spark.createDataFrame([(0, "T", 1.0), (1, "U", 2.0)], "ec_id long, target string, v double"), spark.createDataFrame([(0, "A"), (1, "B")], "hap_idx int, hap string")
    assert rows(algebra.add(a, plane, haps)) == [(0, "T", "A", 2.0), (0, "T", "B", 1.0), (1, "T", "B", 4.0), (1, "U", "A", 2.0), (1, "U", "B", 2.0)]
    assert rows(algebra.subtract(a, plane, haps)) == [(0, "T", "B", -1.0), (1, "T", "B", 4.0), (1, "U", "A", -2.0), (1, "U", "B", -2.0)]
    with pytest.raises(ValueError):
        algebra.add(a, plane)


def test_merge_by_name(spark):
    """Orders of names differ; the second file's class 2 and the first's class 3 have no rows."""
    one = class_file(spark, ["A", "B"], ["T1", "T2"], ["s", "t"], [(0, 0, 1), (1, 1, 1), (2, 0, 3)], [(0, 0, 5), (1, 0, 6), (2, 1, 7), (3, 0, 8)])
    two = class_file(spark, ["B", "A", "C"], ["T2", "T1", "a:b,c"], ["t"], [(0, 1, 2), (1, 1, 1), (3, 2, 4)], [(0, 0, 10), (1, 0, 20), (2, 0, 30), (3, 0, 40)])
    p = Profile.merge([one, two]).checked()
    named = p.n.join(collapse.named_keys(p.a), "ec_id", "left").select("ec_key", "sample", "n")
    assert rows(named) == sorted([("T1:A", "s", 5), ("T1:A", "t", 10), ("T2:A", "s", 6), ("T1:A,T1:B", "t", 7), (None, "s", 8), (None, "t", 30), ("T1:B", "t", 20), (r"a\:b\,c:C", "t", 40)], key=str)
    assert rows(p.haplotypes) == [("A", 0), ("B", 1), ("C", 2)] and rows(p.targets) == [("T1", 0), ("T2", 1), ("a:b,c", 2)] and rows(p.samples) == [("s", 0), ("t", 1)]
    assert [r.ec_id for r in p.n.select("ec_id").distinct().orderBy("ec_id").collect()] == [0, 1, 2, 3, 4, 5]
    assert rows(p.lengths.where("target = 'T1'")) == [("T1", "A", 0), ("T1", "B", 1), ("T1", "C", 12)]
    back = Profile.of_classes(p.class_tables())
    assert rows(back.a) == rows(p.a)


def test_merging_reads_lines_once(spark):
    """Class files are written before they are merged, so what follows doesn't make them from lines again."""
    assert not [f for f in QUERIES["ec_merge_files"](spark, SF).inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("hashed", [collapse.lanes, lambda *c: [F.lit(1).cast("long")] * 2])
def test_recollapse(spark, hashed):
    """Also when all rows share one hash, so that only the comparison of rows tells classes apart."""
    a = spark.createDataFrame([(1, "T", "A", 1.0), (2, "T", "A", 1.0), (3, "T", "B", 1.0), (4, "T", "A", 2.0), (5, "T", "A", 1.0), (5, "U", "A", 1.0), (6, "U", "A", 1.0), (6, "T", "A", 1.0), (9, "T", "A", 0.0)], "ec_id long, target string, hap string, v double")
    n = spark.createDataFrame([(k, s, k) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9) for s in ("x", "y")], "ec_id long, sample string, n long")
    kept, counts = collapse.recollapse(a, n, hashed)
    assert rows(counts) == sorted([(e, s, k) for e, k in {1: 3, 3: 3, 4: 4, 5: 11, 7: 24}.items() for s in ("x", "y")], key=str)
    assert rows(kept) == [(1, "T", "A", 1.0), (3, "T", "B", 1.0), (4, "T", "A", 2.0), (5, "T", "A", 1.0), (5, "U", "A", 1.0)]
    assert rows(collapse.recollapse(a.limit(0), n.limit(0))[1]) == []


def test_prints_equal_sets(spark):
    made = [(k % 90, f"n{(k * k) % 23}") for k in range(400)] * 2
    al = spark.createDataFrame(made, "read long, tid string")
    want = rows(classes.count_classes(classes.read_sets(al, ["read"])).select("ec_key", "n"))
    assert rows(collapse.count_by_prints(al, ["read"])) == want
    plan = collapse.count_by_prints(al, ["read"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ordinals_run_in_the_jvm(spark, kind):
    made = [(f"k{(7 * k) % 50:02}", 1000 - k) for k in range(300)]
    df = spark.createDataFrame(made, "key string, o long").select("key", F.col("o").cast(kind).alias("o"))
    index = classes.dense_index(df, "key", "o", "idx")
    first = {}
    for k, o in made:
        o = str(o) if kind == "string" else o
        first[k] = min(first.get(k, o), o)
    assert rows(index) == sorted([(k, i) for i, k in enumerate(sorted(first, key=lambda k: (first[k], k)))], key=str)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "RDD" not in plan
    assert classes.dense_index(df.limit(0), "key", "o", "idx").count() == 0


def test_pairs_of_large_classes(spark):
    """A class of 1,500 genes in blocks of 100, beside small ones, gives the pairs of the plain product."""
    b = spark.range(1500).select(F.lit(1).alias("ec_id"), F.concat(F.lit("g"), "id").alias("gene")).unionByName(spark.createDataFrame([(2, "g1"), (2, "g2"), (3, "g2"), (4, "g1"), (4, "g2")], "ec_id int, gene string"))
    n = spark.createDataFrame([(1, "s", 3), (2, "s", 5), (3, "t", 7), (4, "t", 1)], "ec_id int, sample string, n long")
    got = network.shared_reads(b, n, block=100)
    assert got.count() == 1500 * 1500 and got.agg(F.sum("read_count")).first()[0] == 3 * 1500 * 1500 + 6 * 4 + 7
    assert network.shared_reads(b, n).exceptAll(got).isEmpty()
    assert network.shared_reads_by(b, n, block=100).exceptAll(network.shared_reads_by(b, n)).isEmpty()


@pytest.mark.parametrize("name", ["mat_add", "mat_sub", "incidence_mask", "mask_decode", "set_value", "add_plane"])
def test_tasks_stay_small(spark, name, monkeypatch):
    """A table of more rows is dealt to more tasks; with many parts lines meet them in hash tables; rows are the same."""
    monkeypatch.setattr(tables, "ROWS", 500, raising=False)
    monkeypatch.setattr(adapters, "BROADCAST_ROWS", 10, raising=False)
    got = QUERIES[name](spark, SF)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 1500 and len(sizes) > 4
    test_query_equals_sql(spark, name)


@pytest.mark.parametrize("name", ["mat_add", "mat_sub", "incidence_mask", "mask_decode", "set_value", "add_plane"])
def test_joins_of_lines_are_dealt(spark, name, monkeypatch):
    """Lines meet many parts in as many tasks as there are rows for; nothing depends on the number of shuffle partitions."""
    monkeypatch.setattr(tables, "ROWS", 500)
    monkeypatch.setattr(adapters, "BROADCAST_ROWS", 10)
    shuffles = re.findall(r"hashpartitioning\([^)]*, (\d+)\)", QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert set(shuffles) == {str(-(-adapters.table(spark, SF, "lineitem").count() // 500))}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine, sql = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    cols = sorted(sql.columns)
    assert cols == sorted(mine.columns)
    assert sorted(map(tuple, mine[cols].astype(str).values)) == sorted(map(tuple, sql[cols].astype(str).values))
