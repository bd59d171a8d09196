import json
import os
import random
import time

import pytest

from motifgrid.cli import main
from motifgrid.operators.search import search
from motifgrid.plans import catalogue
from motifgrid.plans.spec import ArgumentError, BadFileFormat, SearchSpec, parse_arguments, parse_query, read_query
from motifgrid.operators.tiling import tile
from motifgrid.operators.search import search_files
from motifgrid.sources.genome import files_2bit, parse_2bit, read_2bit, read_2bit_files, read_fasta, read_genome, tiles_2bit, write_2bit
from motifgrid.sources.sinks import HEADER, write_parts, write_report
from motifgrid.streaming.genomes import stream_fasta, stream_search


def sequences(frame):
    return sorted((r["chr_name"], bytes(r["seq"]).decode()) for r in frame.collect())


def test_fasta(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_bytes(b">chr1 some words\r\nACGT\r\nacgn\r\n>empty\n>chr2\nGG\n\nTT\n>chr2\nA\n>last")
    found = read_fasta(spark, str(path))
    assert sequences(found) == [("chr1 some words", "ACGTacgn"), ("chr2", "A"), ("chr2", "GGTT")]
    assert len({r["chr_ord"] for r in found.collect()}) == 3
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nA\n")
    with pytest.raises(BadFileFormat):
        read_fasta(spark, str(tmp_path / "bad.fa"))
    (tmp_path / "nameless.fa").write_text(">a\nA\n>\nACGT\n")
    with pytest.raises(Exception, match="has no name"):
        read_fasta(spark, str(tmp_path / "nameless.fa")).collect()
    assert read_fasta(spark, str(path), max_line=4).count() == 3
    with pytest.raises(Exception, match="more than 3 bases"):
        read_fasta(spark, str(path), max_line=3).collect()
    (tmp_path / "nothing.fa").write_text("")
    assert read_fasta(spark, str(tmp_path / "nothing.fa")).count() == 0


def test_fasta_over_many_partitions(spark, tmp_path):
    text = "".join(f">s{i}\n" + "\n".join(["ACGTN" * 10] * (i % 7)) + "\n" for i in range(200))
    (tmp_path / "g.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = read_fasta(spark, str(tmp_path / "g.fa"))
        assert found.rdd.getNumPartitions() > 4
        assert sequences(found) == sorted((f"s{i}", "ACGTN" * 10 * (i % 7)) for i in range(200) if i % 7)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folder(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nAC\n")
    (tmp_path / "b.fa").write_text(">b\nGT")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.fa").write_text(">d\nTT\n")
    assert sequences(read_genome(spark, str(tmp_path))) == [("a", "AC"), ("b", "GT")]
    assert read_genome(spark, str(tmp_path / "deep" / ".." / "deep")).count() == 1


def test_2bit(spark, tmp_path):
    rows = [("one", "ACGTNNNNTTGCA"), ("zwei é", "NNACG"), ("three", "T"), ("empty", ""), ("n", "NNN")]
    blob = write_2bit(rows)
    assert [(n, s.decode()) for n, s in parse_2bit(blob)] == rows
    (tmp_path / "g.2bit").write_bytes(blob)
    assert sequences(read_genome(spark, str(tmp_path / "g.2bit"))) == sorted(r for r in rows if r[1])
    for bad in (b"\0" * 16, blob[:4] + b"\1" + blob[5:], blob[:-1], blob[:10]):
        with pytest.raises(BadFileFormat):
            list(parse_2bit(bad))
        (tmp_path / "bad.2bit").write_bytes(bad)
        with pytest.raises(BadFileFormat):
            read_2bit(spark, str(tmp_path / "bad.2bit"))


def test_tiles_of_a_2bit_file(spark, tmp_path):
    """Ranges read by many tasks are the tiles of the whole sequences."""
    draw = random.Random(2)
    rows = [(f"s{i}", "".join(draw.choice(["A", "C", "G", "T", "N" * draw.randint(1, 9)]) for _ in range(draw.choice([1, 7, 400])))) for i in range(9)]
    path = str(tmp_path / "g.2bit")
    (tmp_path / "g.2bit").write_bytes(write_2bit(rows))
    for overlap, size in ((0, 100), (24, 101), (5, 3)):
        found = tiles_2bit(spark, path, overlap, size, 6)
        assert found.rdd.getNumPartitions() == 6
        want = tile(spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(rows)], "chr_ord long, chr_name string, seq string"), overlap, size)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert sequences(read_2bit(spark, f"file://{path}")) == sorted(rows)
    spec = SearchSpec("NNNN", ("ACGT",), 1)
    assert sorted(map(tuple, search_files(spark, path, spec).collect())) == sorted(map(tuple, search(read_genome(spark, path), spec).collect())) != []


QUERY = "genome.fa\nNNNNRG 1 0\nACGTNN 2 first\nTTTTNN 2 second\n"


def test_query(tmp_path):
    found = parse_query(QUERY)
    assert found.genome == "genome.fa" and found.spec == SearchSpec("NNNNRG", ("ACGTNN", "TTTTNN"), 2, 1, 0) and found.labels == ("first", "second")
    (tmp_path / "q.in").write_bytes(QUERY.replace("\n", "\r\n").encode())
    assert read_query(str(tmp_path / "q.in")) == found
    assert parse_query("g\nNN\nAC 1\nAC 1 label").labels == (None, "label")


@pytest.mark.parametrize("text", ["", "g", "g\nNN", "g\nNN 1\nAC 1", "g\nNN 1 x\nAC 1", "g\nNU\nAC 1", "g\nNN\nAU 1", "g\nNN\nAC", "g\nNN\nAC x", "g\nNN\nAC -1", "g\nNN\nAC 1\nAC 2", "g\nNN\nAC 1 l\nAC 1", "g\nNN\nACG 1", "g\nNN\nAC 1\n\nAC 1", "g\nNN 1 1 1\nAC 1"])
def test_bad_queries(text):
    with pytest.raises(ArgumentError):
        parse_query(text)


def test_arguments():
    assert parse_arguments([]) is None and parse_arguments(["q", "C", "o", "more"]).out == "o"
    for bad in (["q"], ["q", "C"], ["q", "C0", "o"], ["q", "X", "o"]):
        with pytest.raises(ArgumentError):
            parse_arguments(bad)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.fa").write_text(">c one\nTTACGTAGGTT\n>d\nACGTCAG\n")
    (tmp_path / "q.in").write_text(f"{tmp_path}/g.fa\nNNNNNRG\nACGTNNN 1\n")
    out = str(tmp_path / "out.tsv")
    assert main([str(tmp_path / "q.in"), "C", out], spark) == 0
    lines = open(out).read().splitlines()
    assert lines[0] == HEADER and "X\tACGTNNN\tACGTAGG\tc one\t2\t+\t0\t0" in lines
    log = json.load(open(out + ".log"))
    assert log["matches"] == len(lines) - 1 and log["genome"] == {"path": f"{tmp_path}/g.fa", "bytes": os.path.getsize(tmp_path / "g.fa")} and log["query"]["max_mismatches"] == 1
    capsys.readouterr()
    assert main([str(tmp_path / "q.in"), "G", "-"], spark) == 0
    assert capsys.readouterr().out.splitlines()[0] == HEADER and not os.path.exists("-.log")
    assert main([]) == 0 and main(["x"]) == 1 and main([str(tmp_path / "none"), "C", out], spark) == 1


def test_reports(spark, tmp_path):
    frame = spark.createDataFrame([("a", "ACGTACGT"), ("b", "TACGTT")], "chr_name string, seq string")
    sites = search(frame, SearchSpec("NNNN", ("ACGT",), 0))
    n = write_report(sites, str(tmp_path / "r.tsv"))
    write_parts(sites, str(tmp_path / "parts"))
    one = sorted(open(tmp_path / "r.tsv").read().splitlines()[1:])
    parts = [f.read_text().splitlines() for f in (tmp_path / "parts").glob("part-*")]
    assert sorted(line for p in parts for line in p[1:]) == one and len(one) == n == 6
    assert {p[0] for p in parts} == {HEADER}


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fa").write_text(">a\nTTACGTAGG\n>b\nACGTCAG\n")
    spec = SearchSpec("NNNNNRG", ("ACGTNNN",), 1)
    query = stream_search(stream_fasta(spark, str(folder)), spec).writeStream.format("memory").queryName("sites").outputMode("append").start()
    try:
        query.processAllAvailable()
        (folder / "c.fa").write_text(">c\nACGTTGG\n")
        query.processAllAvailable()
    finally:
        query.stop()
    expected = search(read_fasta(spark, str(folder)), spec)
    assert sorted(map(tuple, spark.table("sites").collect())) == sorted(map(tuple, expected.collect())) != []


def test_2bit_files_of_many_sequences(spark, tmp_path):
    """Files of bounded size in a time that grows with the bases, read by tasks that share a file; no sequence is lost."""
    draw = random.Random(5)
    text = "".join(draw.choice("ACGTN") for _ in range(4000))
    rows = [(f"s{i}", text[i % 1000 : i % 1000 + 2000]) for i in range(20000)] + [("empty", ""), ("n", "N" * 9)]
    began = time.process_time()
    files = list(files_2bit(rows, 1 << 22))
    assert time.process_time() - began < 10  # letter by letter and copying all records before: over a minute
    assert len(files) > 5 and max(map(len, files)) < 1.1 * (1 << 22)
    paths = [f"file://{tmp_path}/{k}.2bit" for k in range(len(files))]
    for k, data in enumerate(files):
        (tmp_path / f"{k}.2bit").write_bytes(data)
    found = read_2bit_files(spark, paths, part=1 << 20, batch=1 << 18)
    assert found.rdd.getNumPartitions() > len(files)
    got = found.collect()
    assert sorted((r.chr_name, bytes(r.seq).decode()) for r in got) == sorted(r for r in rows if r[1])
    assert len({r.chr_ord for r in got}) == len(got)
    assert read_2bit_files(spark, []).count() == 0


def test_2bit_query_with_null_and_empty_texts(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "Nan, acgt"), (4, "q")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.QUERIES["twobit_roundtrip"](spark, str(tmp_path)).collect()
    assert {(r.chr_name, r.n) for r in found} == {("doc3", 7), ("doc4", 1)}
