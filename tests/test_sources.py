import random
import re

from strandloom.sources import annotation, tables
from tests.genomes import random_gene, write_genome


def test_cds_rows_win_over_gene_rows(spark, tmp_path):
    p = tmp_path / "g.gff"
    p.write_text("c1\tt\tgene\t1\t4\t.\t+\t0\tID=g1\nc1\tt\tgene\t5\t8\t.\t+\t0\tID=g2\nc1\tt\tCDS\t1\t4\t.\t+\t0\tID=cds1\nbroken line\nc1\tt\tCDS\tx\t4\t.\t+\t0\tID=no\n")
    got = annotation.gff_genes(annotation.whole_files(spark, [str(p)])).collect()
    assert [(r.genome_id, r.gene_id, r.sequence) for r in got] == [("g", "cds1", "")]


def test_gene_rows_where_there_is_no_cds_and_strands(spark, tmp_path):
    p = tmp_path / "g.gff"
    p.write_text("c1\tt\tgene\t1\t4\t.\t+\t0\tName=a\r\nc2\tt\tgene\t2\t5\t.\t-\t0\tx=1\r\n##FASTA\r\n>c1 x\r\nATCG\r\nATCG\r\n>c2\r\nGCTAGCTA\r\n")
    got = {r.gene_id: r.sequence for r in annotation.gff_genes(annotation.whole_files(spark, [str(p)])).collect()}
    assert got == {"a": "ATCG", "c2_2_5": "CTAG"}


def test_many_files_in_order(spark, tmp_path):
    paths = [write_genome(tmp_path, f"g{i}", [("x", 101, 190, "-", random_gene(1))]) for i in range(3)]
    got = annotation.gff_genes(annotation.whole_files(spark, paths)).orderBy("file_idx").collect()
    assert [r.genome_id for r in got] == ["g0", "g1", "g2"] and {r.sequence for r in got} == {random_gene(1)}


def test_genbank_and_fasta(spark, tmp_path):
    (tmp_path / "a.gbk").write_text("LOCUS x\nORIGIN\n        1 acgta cgtac\n       11 ggg\n//\nORIGIN\n 1 ttt\n//\n")
    (tmp_path / "b.fa").write_text(">s1 first\nAC>GT\nAA\n>empty\n>s2\nTT\n")
    assert annotation.genbank_sequences(annotation.whole_files(spark, [str(tmp_path / "a.gbk")])).first().sequence == "acgtacgtacggg"
    got = [(r.id, r.header, r.sequence) for r in annotation.fasta_records(annotation.whole_files(spark, [str(tmp_path / "b.fa")])).collect()]
    assert got == [("s1", "s1 first", "AC>GTAA"), ("s2", "s2", "TT")]


def test_wide_tables(spark, tmp_path):
    p = tmp_path / "pa.csv"
    p.write_text(",".join([f'"{c}"' for c in tables.METADATA] + ["g1", "g2", "g3", "g4"]) + "\n" + "\n".join(",".join([name, *[""] * 13, *cells]) for name, cells in (("a", ("x", "y", "", "0")), ("b", ("x", "FALSE", "z", "")), ("c", ("", "1", "2", "3")))) + "\n")
    got = {(r.cluster_id, r.genome_id) for r in tables.presence_csv(spark, str(p)).collect()}
    assert got == {("a", "g1"), ("a", "g2"), ("b", "g1"), ("b", "g3"), ("c", "g2"), ("c", "g3"), ("c", "g4")}
    assert tables.genome_count(spark, str(p)) == 4
    r = tmp_path / "m.Rtab"
    r.write_text("Gene\tg1\tg2\na\t1\t0\nb\ttrue\tpresent\n")
    assert {(x.cluster_id, x.genome_id) for x in tables.rtab(spark, str(r)).collect()} == {("a", "g1"), ("b", "g1"), ("b", "g2")}


def test_results_of_other_tools(spark, tmp_path):
    (tmp_path / "ani.tsv").write_text("Ref_file\tQuery_file\tANI\n/d/genome_a.fa\t/d/genome_b.fa\t95.500\t90\t91\n")
    r = tables.ani_pairs(spark, str(tmp_path / "ani.tsv")).collect()
    assert [(x.g1, x.g2, round(x.ani, 6)) for x in r] == [("genome_a", "genome_b", 0.955)]
    (tmp_path / "growth.txt").write_text("# c\n1 10.0\n2 15.5\n\n1 10\n2 8\n")
    assert [(x.block, x.n, x["size"]) for x in tables.growth_points(spark, str(tmp_path / "growth.txt")).collect()] == [(0, 1, 10.0), (0, 2, 15.5), (1, 1, 10.0), (1, 2, 8.0)]
    (tmp_path / "assoc.csv").write_text("Gene,Naive_p,extra\na,0.01,1\nb,bad,2\n")
    assert [(x.gene, x.p_value, x.odds_ratio) for x in tables.associations(spark, str(tmp_path / "assoc.csv")).collect()] == [("a", 0.01, 1.0), ("b", 1.0, 1.0)]


def test_growth_blocks_over_ranges_and_parts(spark, tmp_path):
    """Blocks are those of the whole text however it is cut into ranges, batches and part files; no row holds a whole file."""
    rng = random.Random(4)
    lines = [[rng.choice(["1 2.5", "7 1e1 x", "# c", "", "", " \t", "3", "\r", "x 1", "4 5\r", "  6 7"]) for _ in range(60)] for _ in range(3)]
    texts = ["\n" + "\n".join(lines[0]) + "\n", "\n\n" + "\n".join(lines[1]) + "\n", "8 9\n" + "\n".join(lines[2])]

    def want(text):
        found = []
        for k, body in enumerate(re.split(r"\n\s*\n", text)):
            for line in re.split("\r?\n", body):
                f = re.split(r"\s+", line.strip(" "))
                if not line.startswith("#") and len(f) >= 2 and f[0].isdigit() and f[1]:
                    found.append((k, int(f[0]), float(f[1])))
        return sorted(found)

    for k, text in enumerate(texts):
        (tmp_path / f"g{k}.txt").write_bytes(text.encode())
    (tmp_path / "whole").mkdir()
    whole = "".join(texts)
    cuts = [0, *sorted(rng.sample([i + 1 for i, c in enumerate(whole) if c == "\n"], 6)), len(whole)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / "whole" / f"part-{k:05}-x.txt").write_bytes(whole[a:b].encode())
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        for path, text in [(f"g{k}.txt", t) for k, t in enumerate(texts)] + [("whole", whole)]:
            got = tables.growth_points(spark, f"file://{tmp_path}/{path}")
            assert sorted((r.block, r.n, r["size"]) for r in got.collect()) == want(text), path
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)
