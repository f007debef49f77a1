import gzip

import numpy as np
from pyspark.sql import functions as F

from methyloom import cli
from methyloom.functions.register import register_functions
from methyloom.operators import genes, motifs, sites
from methyloom.sources import fasta, readers, writers


def test_allc_bed_and_sizes(spark, tmp_path):
    with gzip.open(tmp_path / "c1.allc.tsv.gz", "wt") as f:
        f.write("chr\tpos\tstrand\tcontext\tmc\tcov\tp\nchr2\t10\t+\tCGA\t1\t2\t1\nchr1\t7\t-\tCGT\t0\t3\t1\n")
    (tmp_path / "sizes").write_text("chr2\t100\nchr1\t50\t9\t9\n")
    sizes = readers.read_chrom_sizes(spark, str(tmp_path / "sizes"))
    assert [tuple(r) for r in sizes.orderBy("chrom_order").collect()] == [("chr2", 100, 0), ("chr1", 50, 1)]
    a = readers.read_allc(spark, str(tmp_path / "c1.allc.tsv.gz"), cell=r"([^/]+)\.allc\.tsv\.gz$")
    assert sorted((r.cell, r.chrom, r.pos, r.cov) for r in a.collect()) == [("c1", "chr1", 7, 3), ("c1", "chr2", 10, 2)]
    writers.write_allc(a, str(tmp_path / "out"), sizes)
    again = readers.read_allc(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in again.collect()) == [("chr1", 7, "-", "CGT", 0, 3, 1), ("chr2", 10, "+", "CGA", 1, 2, 1)]
    (tmp_path / "b.bed").write_text("chr1\t5\t9\nchr2\t1\t4\nchrX\t0\t2\n")
    bed = readers.read_bed(spark, str(tmp_path / "b.bed"), named=False, chrom_sizes=sizes)
    assert sorted(tuple(r) for r in bed.collect()) == [("chr1", 5, 9, "region_1"), ("chr2", 1, 4, "region_0")]
    assert readers.parse_paths(str(tmp_path / "*.bed")) == [str(tmp_path / "b.bed")]


def test_fasta_contexts_and_regions(spark, tmp_path):
    seq = "".join(np.random.default_rng(0).choice(list("ACGTN"), 997, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
    (tmp_path / "g.fa").write_text(">c1 x\n" + "\n".join(seq[i : i + 60] for i in range(0, 997, 60)) + "\n>c2\nACGTACGT\n")
    chunks = fasta.read_fasta(spark, str(tmp_path / "g.fa"), chunk=100, pad=7)
    assert "".join(r.seq[r.lead : r.lead + r.length] for r in chunks.where("chrom = 'c1'").orderBy("start").collect()) == seq
    regions = spark.createDataFrame([("r1", "c1", 95, 305), ("r2", "c2", 0, 8), ("r3", "c1", 990, 997)], "region STRING, chrom STRING, start BIGINT, end BIGINT")
    got = {r.region: r.seq for r in writers.region_sequences(regions, chunks).collect()}
    assert got == {"r1": seq[95:305], "r2": "ACGTACGT", "r3": seq[990:]}
    rc = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}
    rows = [("c1", i + 1, "+" if seq[i] == "C" else "-") for i in range(997) if seq[i] in "CG"]
    out = {r.pos: r.context for r in sites.add_context(spark.createDataFrame(rows, "chrom STRING, pos BIGINT, strand STRING"), chunks).collect()}
    want = {}
    for _, pos, strand in rows:
        i = pos - 1
        c = seq[i : i + 3] if strand == "+" else "".join(rc[b] for b in reversed(seq[max(0, i - 2) : i + 1]))
        if len(c) == 3:
            want[pos] = c
    assert out == want


def test_pileup_to_counts(spark):
    p = spark.createDataFrame([("c", 1, "C", 4, "..T^].$+2AG,", "x"), ("c", 2, "G", 3, ",a-1ca", "x"), ("c", 3, "A", 1, ".", "x"), ("c", 4, "C", 0, "", "")], "chrom STRING, pos BIGINT, ref_base STRING, depth INT, bases STRING, quals STRING")
    assert sorted(tuple(r) for r in sites.pileup_counts(p).collect()) == [("c", 1, "+", 3, 4), ("c", 2, "-", 1, 3)]


def test_gtf(spark, tmp_path):
    (tmp_path / "x.gtf").write_text('#c\nchr1\ts\tgene\t11\t20\t.\t-\t.\tgene_id "g1"; gene_name "A";\nchr1\ts\tgene\t1\t50\t.\t+\t.\tgene_id "g2"; gene_name "A";\nchr1\ts\texon\t3\t5\t.\t+\t.\tgene_id "g2"; transcript_id "t";\nchr1\ts\texon\t9\t12\t.\t+\t.\tgene_id "g2"; transcript_id "t";\n')
    g = readers.read_gtf(spark, str(tmp_path / "x.gtf"))
    assert {r.gene_id: r.pos for r in genes.transcription_starts(g).collect()} == {"g1": 19, "g2": 0}
    assert [tuple(r) for r in genes.ids_by_name(g).collect()] == [("A", "g2")]
    assert [tuple(r) for r in genes.to_bed12(g).select("start", "end", "sizes", "starts").collect()] == [(2, 12, [3, 4], [0, 6])]


def test_motif_files_and_thresholds(tmp_path):
    (tmp_path / "m").write_text("MEME version 4\nMOTIF M1 x\nletter-probability matrix: alength= 4 w= 2 nsites= 10 E= 0\n 0.9 0.1 0 0\n 0 0 1 0\n")
    (m,) = readers.read_motifs(str(tmp_path / "m"))
    assert (m["name"], m["nsites"], m["pfm"]) == ("M1", 10.0, [[0.9, 0.1, 0, 0], [0, 0, 1, 0]])
    w = motifs.weights([[10, 0, 0, 0], [0, 10, 0, 0], [0, 0, 10, 0]] * 2)
    assert 0 < motifs.balanced_threshold(w, fold=10) <= w.max(1).sum()


def test_command_line(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("chr1\t1\t+\tCGA\t1\t2\t1\nchr1\t2\t-\tCGA\t3\t4\t1\nchr1\t250\t+\tCAA\t0\t4\t1\n")
    (tmp_path / "s").write_text("chr1\t1000\n")
    base = ["--input", str(tmp_path / "a.tsv"), "--output"]
    cli.main(["generate-mcds", *base, str(tmp_path / "m"), "--chrom-sizes", str(tmp_path / "s"), "--bin-size", "100"], spark)
    assert sorted((r.cell, r.start, r.mc_type, r.mc, r.cov) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("a", 0, "CGN", 4, 6), ("a", 200, "CHN", 0, 4)]
    cli.main(["extract-allc", *base, str(tmp_path / "e"), "--contexts", "CGN", "--strandness", "merge"], spark)
    assert [r._c1 for r in spark.read.option("sep", "\t").csv(str(tmp_path / "e") + "/pattern=CGN").collect()] == ["1"]
    register_functions(spark)
    assert spark.sql("SELECT * FROM matching_contexts('CY')").count() == 2
    assert abs(spark.sql("SELECT binom_sf(10D, 3D, 0.2D) AS p").first().p - 0.1208738816) < 1e-9


def test_stream_ingest(spark, tmp_path):
    from methyloom.streaming import ingest

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.tsv").write_text(f"chr1\t{i + 1}\t+\tCGA\t1\t2\t1\nchr1\t150\t+\tCGA\t0\t1\t1\n")
    s = ingest.allc_stream(spark, str(tmp_path / "in"), 1)
    ingest.drain(ingest.running_bins(s, 100), "running_bins", str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in spark.table("running_bins").collect()) == [("chr1", 0, 3, 6), ("chr1", 1, 0, 3)]
    assert ingest.append_to_store(s, str(tmp_path / "store"), str(tmp_path / "cp2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "store")).agg(F.sum("cov")).first()[0] == 9


def test_file_facts(spark, tmp_path):
    import gzip
    import hashlib

    from methyloom.sources import readers

    data = {"a": gzip.compress(b"x"), "b": b"plain\xff"}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    got = {r.file.rsplit("/", 1)[1]: (r.size, r.gzip, r.md5) for r in readers.file_facts(spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), k == "a", hashlib.md5(v).hexdigest()) for k, v in data.items()}


def test_dataset_classes(spark):
    from methyloom.dataset import BaseStore, RegionSet

    r = spark.createDataFrame([("r1", "chr1", 0, 100), ("r2", "chr1", 150, 300), ("r3", "chr2", 5, 9)], "region STRING, chrom STRING, start BIGINT, end BIGINT")
    bed = spark.createDataFrame([("t", "chr1", 10, 90), ("t", "chr2", 0, 4)], "track STRING, chrom STRING, start BIGINT, end BIGINT")
    rs = RegionSet(r).annotate_by_beds(bed)
    assert sorted((x.region, x.track) for x in rs.table("beds").collect()) == [("r1", "t"), ("r2", None), ("r3", None)]
    assert [len(c) for c in rs.chunks(2)] == [2, 1] and list(next(rs.chunks(9))["region"]) == ["r1", "r2", "r3"]
    assert rs.without_blacklist(bed.drop("track")).regions.count() == 2
    base = spark.createDataFrame([("chr1", 10, "s", 1, 2), ("chr1", 11, "s", 2, 2), ("chr1", 200, "t", 0, 3)], "chrom STRING, pos BIGINT, sample STRING, mc BIGINT, cov BIGINT")
    book = spark.createDataFrame([("chr1", 10, "CGA", "+"), ("chr1", 11, "CGT", "-"), ("chr1", 200, "CAN", "+")], "chrom STRING, pos BIGINT, context STRING, strand STRING")
    store = BaseStore(base, book)
    assert store.select_mc_type("CHN").base.count() == 1 and store.select_mc_type("CGN").base.count() == 2
    assert sorted((x.pos, x.mc, x.cov) for x in store.merge_strands().base.collect()) == [(10, 3, 4), (200, 0, 3)]
    assert sorted((x["sample"], x.region, x.mc, x["cov"]) for x in store.region_counts(r).collect()) == [("s", "r1", 3, 4), ("t", "r2", 0, 3)]
    assert store.fetch("chr1", 9, 11).base.count() == 2
