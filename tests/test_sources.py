"""Readers and writers over small files."""

import datetime as dt

import pytest

from helixmill.operators.reference import bed_problems, exact_search, junction_motif, largest_contig, apply_policy, policy_counts, probe_windows, projection
from helixmill.operators.runs import Registry, fingerprint
from helixmill.sources import readers, sinks
from pyspark.sql import functions as F


def test_labelled_csv(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_text("sequence,labels\n10000100,1;-2\n00100001,\n")
    rows = readers.labelled_csv(spark, str(f)).orderBy("row_index").collect()
    assert [(r.row_index, r.sample_id, r.sequence, r.labels) for r in rows] == [(0, "row_0", "10000100", "1;-2"), (1, "row_1", "00100001", "")]
    f.write_text("seq,labels\n1,1\n")
    with pytest.raises(readers.SourceError):
        readers.labelled_csv(spark, str(f))


def test_fasta(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_text(">a first one\r\nACGT\r\n\r\nNN\r\n>b\nacgt\n>c\n")
    rows = {r.id: (r.description, r.seq) for r in readers.fasta(spark, str(f)).collect()}
    assert rows == {"a": ("first one", "ACGTNN"), "b": ("", "acgt"), "c": ("", "")}
    want = spark.createDataFrame([("a", 1, 5), ("a", 4, 9), ("z", 0, 1), ("a", -1, 2)], "id string, start long, stop long")
    got = sorted((r.id, r.start, r.bases) for r in readers.fetch(readers.chunked(readers.fasta(spark, str(f)), 2), want, 2).collect())
    assert got == [("a", -1, ""), ("a", 1, "CGTN"), ("a", 4, ""), ("z", 0, "")]


def test_sam_and_bed(spark, tmp_path):
    f = tmp_path / "x.sam"
    f.write_text("@HD\tVN:1.6\nq\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGT\t*\tNM:i:1\tAS:i:3\tAS:i:4\nu\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    assert [tuple(r)[1:] for r in readers.sam(spark, str(f)).collect()] == [("q", 0, "chr1", 5, 60, "4M", 1, 4)]
    b = tmp_path / "x.bed"
    b.write_text("chr1\t0\t20\trow_1\t.\t+\nchr1\t0\t20\trow_1\t.\t+\nchr2\t5\t25\trow_2\t.\t-\textra\n")
    assert sorted(tuple(r) for r in readers.bed(spark, str(b)).collect()) == [("row_1", "chr1", 0, 20, "+"), ("row_2", "chr2", 5, 25, "-")]


def test_assembly_report(spark, tmp_path):
    f = tmp_path / "r.txt"
    cols = "\t".join(readers.ASSEMBLY)
    rows = ["1\tassembled-molecule\t1\tChromosome\tCM1\t=\tNC_1\tPrimary Assembly\t100\tchr1", "U\tunlocalized-scaffold\t1\tC\tGL1\t=\tna\tPrimary Assembly\t30\tu", "A\talt-scaffold\t1\tC\tGL2\t=\tNT_1\tALT_REF_LOCI_1\t9\ta", "MT\tassembled-molecule\tMT\tM\tJ1\t=\tNC_12\tnon-nuclear\t16\tM"]
    f.write_text(f"# comment\r\n# {cols}\r\n" + "\r\n".join(rows) + "\r\n")
    r = apply_policy(readers.assembly_report(spark, str(f)), ("refseq", "genbank"))
    assert {(x.sequence_name, x.category, x.accession, x.reason) for x in r.collect()} == {("1", "chromosome", "NC_1", None), ("U", "unlocalized", "GL1", None), ("A", None, "NT_1", "outside_policy"), ("MT", "mitochondrion", "NC_12", None)}
    assert tuple(largest_contig(r).collect()[0]) == ("NC_1", 100)
    only = apply_policy(readers.assembly_report(spark, str(f)), ("refseq",))
    assert only.where("sequence_name = 'U'").collect()[0].reason == "source_namespace_unrepresented"
    assert sum(x.n for x in policy_counts(r).collect()) == 4


def test_listings(spark, tmp_path):
    f = tmp_path / "md5.txt"
    a, b = "a" * 32, "b" * 32
    f.write_text(f"{a}  ./x.gz\n{b}  ./d/y.gz\n{a}  ./d//y.gz\n{a} z\n{a} z\nzz q\n{a}  /abs\nalone\n")
    entries, problems = readers.checksum_listing(spark, str(f))
    assert {tuple(r) for r in entries.collect()} == {("x.gz", a)}
    assert sorted(r.problem for r in problems.collect()) == ["conflicting_duplicate", "duplicate_path", "malformed_line", "malformed_path_absolute", "malformed_token"]
    f.write_text("# c\n\n a/b \n")
    assert [r.path for r in readers.path_list(spark, str(f)).collect()] == ["a/b"]
    r = readers.inventory(spark, [str(f)]).collect()[0]
    assert r.size == 11 and len(r.sha256) == 64
    t = tmp_path / "c.toml"
    t.write_text("[a]\nb = 1\n")
    assert readers.toml_config(str(t)) == {"a": {"b": 1}}
    i = tmp_path / "x.fai"
    i.write_text("chr1\t10\t6\t5\t6\n")
    assert tuple(readers.fasta_index(spark, str(i)).collect()[0]) == ("chr1", 10, 6, 5, 6)


def test_index_build(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_bytes(b">a x\nACGT\nAC\n>b\r\nACG\r\n\n>c\n")
    assert [tuple(r) for r in readers.build_fasta_index(spark, str(f)).collect()] == [("a", 6, 5, 4, 5), ("b", 3, 17, 3, 5), ("c", 0, 26, 0, 0)]


def test_checks_and_reports(spark, tmp_path):
    from helixmill.operators import checks as C
    from helixmill.operators import reports as R

    f = tmp_path / "x"
    f.write_bytes(b"abc")
    sha = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    rows = [(str(f), 3, sha), (str(f), 4, sha), (str(f), 3, "0" * 64), (str(tmp_path / "none"), 1, sha)]
    e = spark.createDataFrame(rows, "path string, size long, sha256 string")
    assert sorted(r.problem for r in C.file_problems(spark, e).collect()) == ["hash", "missing", "size"]
    with pytest.raises(C.CheckError):
        C.require(C.file_problems(spark, e))
    C.require(C.file_problems(spark, e.limit(0)))
    a = spark.createDataFrame([("x", "A" * 32), ("y", "b" * 32), ("z", "c" * 32)], "path string, md5 string")
    b = spark.createDataFrame([("x", "a" * 32), ("y", "0" * 32)], "path string, md5 string")
    assert {tuple(r) for r in C.checksum_problems(b, a).collect()} == {("y", "changed"), ("z", "not_listed")}
    assert C.manifest_problems({"a": " "}, ("a", "b")) == ["missing: a", "missing: b"] and C.policy_problems(["refseq", "x", "x"], []) == ["unknown namespace: x", "unknown namespace: x", "repeated namespace: x", "no roles"]
    assert len(C.preflight_problems(None, 1, 9, 8, 2, 4)) == 3
    log = spark.createDataFrame([("[M::main] Version: 2.31",), ("[M::x] kmer size: 15; skip: 5; Error",)], "line string")
    assert {(r.fact, r.value) for r in C.log_facts(log).collect()} == {("version", "2.31"), ("kmer", "15"), ("skip", "5"), ("error", "Error")}
    r = R.build_report({"t": b, "u": a.limit(0)}, "one")
    assert r["recommendation"] is None and "| x | " in R.markdown(r, "T") and "no rows" in R.markdown(r, "T")
    assert "## one" in R.combined_markdown(R.combined_report({"one": r}, b), "all")


def test_sinks(spark, tmp_path):
    sinks.write_json({"b": 1, "a": [2]}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text().index('"a"') < (tmp_path / "x.json").read_text().index('"b"')
    assert sinks.fixed_decimals(0.1234565) == "0.123456" and sinks.fixed_decimals(None) == ""
    df = spark.createDataFrame([("a", [1, 2], None)], "id string, xs array<int>, n int")
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert sorted({r.value.rstrip() for r in spark.read.text(str(tmp_path / "t")).collect()}) == ["a\t1;2", "id\txs\tn"]
    for _ in range(2):
        sinks.append_rows(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_search_and_motifs(spark):
    s = "ACGTTGCAAGCTTACGGATCCTTAGGCATCGATCGGA"
    turn = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    p = spark.createDataFrame([("p", s[:34])], "name string, seq string")
    c = spark.createDataFrame([("c1", "GG" + s.lower()), ("c2", turn + "T"), ("c3", "A")], "id string, seq string")
    got = sorted(tuple(r) for r in exact_search(p, c).collect())
    assert got == [("p", "c1", 2, 36, "+"), ("p", "c2", 3, 37, "-")]
    df = spark.createDataFrame([("GT", "AG", "+"), ("CT", "AC", "-"), ("CC", "TT", "+"), ("", "AG", "+")], "l string, r string, s string")
    _, _, ok = junction_motif(F.col("l"), F.col("r"), F.col("s"))
    assert [x[0] for x in df.select(ok).collect()] == [True, True, False, None]


def test_bed_rules(spark):
    good, rest = "c\t0\t10\tp\t1\t+", ["c\t0\t10\tp\t1\t+", "d\t0\t10\tp\t1\t+", "c\t0\t10\tx\t1\t+", "c\ta\t10\tp\t1\t+", "c\t5\t100\tp\t.\t*", "c\t0\t10"]
    df = spark.createDataFrame([(x,) for x in [good, *rest, ""]], "line string").coalesce(1)
    known = spark.createDataFrame([("p",)], "name string")
    assert sorted(r.problem for r in bed_problems(df, "c", 50, known).collect()) == ["bounds", "columns", "contig", "positions", "repeated", "score_not_whole", "strand", "unknown_pattern"]


def test_probe(spark):
    c = spark.createDataFrame([("a", "ACGTNACGTACGTAC"), ("b", "NNN")], "id string, seq string")
    rows = probe_windows(c, 4, 3).collect()
    assert len(rows) == 1 and rows[0].id == "a" and "N" not in "ACGTNACGTACGTAC"[rows[0].start : rows[0].stop]
    assert projection(10, 20, 100, 5, 1024, 0, None, 8, 100)["memory_ok"] is False
    assert projection(10, 20, 100, 5, 1024, 1, 8, 8, 100) | {} == {"scale": 2.0, "wall_seconds": 300.0, "output_bytes": 20.0, "peak_gib": 1024 * 1024 / 2**30 + 2, "no_hits": False, "wall_ok": True, "output_ok": True, "memory_ok": True}


def test_registry(spark, tmp_path):
    r, built = Registry(spark, f"file://{tmp_path}/runs"), []

    def build():
        built.append(1)
        return spark.range(3)

    key = fingerprint({"a": 1}, "x")
    assert r.run("s", key, build).count() == 3 and r.run("s", key, build).count() == 3
    assert len(built) == 1 and r.is_valid("s", key) and not r.is_valid("s", fingerprint({"a": 2}, "x"))
    r.run("s", fingerprint({"a": 2}, "x"), build)
    assert len(built) == 2 and not r.is_valid("s", key)


def test_stream(spark, tmp_path):
    from helixmill.streaming.audit import stream_class_counts

    t = dt.datetime(2025, 1, 1)
    rows = [(1, "5;-7", t), (1, "5;-7", t), (2, "5;5", t), (None, "9", t)]
    schema = "row_index long, labels string, loaded_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = stream_class_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), {}).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.label_value, r.n_records) for r in spark.table("counts").collect()} == {(5, 2), (-7, 1)}


def test_derived_reference(spark, tmp_path):
    from helixmill.sources import readers, sinks

    contigs = spark.createDataFrame([("GB1", "ACGTacgtNN"), ("GB2", "AAAA"), ("GB9", "CC")], "id string, seq string")
    policy = spark.createDataFrame([("GB1", None, 10), ("GB2", None, 4), ("GB3", "outside_policy", 5)], "accession string, reason string, length long")
    m = sinks.write_derived_fasta(contigs, policy, str(tmp_path / "ref"))
    assert (m["contigs"], m["bases"], m["upper"], m["lower"]) == (2, 14, 8, 4)
    assert sorted((r.id, r.seq) for r in readers.fasta(spark, str(tmp_path / "ref")).collect()) == [("GB1", "ACGTacgtNN"), ("GB2", "AAAA")]
    more = policy.unionByName(spark.createDataFrame([("GB9", None, 7), ("GB7", None, 1)], policy.schema))
    _, problems = readers.selected_contigs(contigs.unionByName(contigs.where("id = 'GB1'")), more)
    assert sorted(tuple(r) for r in problems.collect()) == [("GB1", "repeated"), ("GB7", "missing"), ("GB9", "length")]
    with pytest.raises(ValueError):
        sinks.write_derived_fasta(contigs, more, str(tmp_path / "ref2"))
    assert not (tmp_path / "ref2").exists()


def test_lenient_checksums_and_reads(spark, tmp_path):
    from helixmill.sources import readers

    a, b = "0" * 31 + "A", "f" * 32
    (tmp_path / "sums").write_text(f"{a}  ./x/one.fa\r\n{b} *one.fa\nnonsense\n{b}  two.fa\n")
    assert sorted(tuple(r) for r in readers.lenient_checksums(spark, str(tmp_path / "sums")).collect()) == [("one.fa", b), ("two.fa", b)]
    x = spark.createDataFrame([("a", "AC"), ("b", "G")], "id string, seq string")
    reads, problems = readers.concatenated_reads(x, spark.createDataFrame([("b", "T")], x.schema))
    assert reads.count() == 3 and [tuple(r) for r in problems.collect()] == [("b", 2)]


def test_compare_and_set(spark, tmp_path):
    from helixmill.operators.runs import Registry, StaleError

    r = Registry(spark, str(tmp_path))
    for i in range(3):
        assert r.run("s", f"k{i}", lambda: spark.range(i + 1)).count() == i + 1
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("gen=")]) == 2  # the last one and the one before
    with pytest.raises(StaleError):
        r.replace({"a": 1}, {"generation": "another"}, "s", "pointer.json")
    (tmp_path / "s" / ".pointer.json.lock").write_text("")
    with pytest.raises(StaleError):
        r.replace({"a": 1}, r.current("s"), "s", "pointer.json")
