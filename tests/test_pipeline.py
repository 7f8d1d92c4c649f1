import pytest
from pyspark.errors import AnalysisException

from strandloom import pipeline, tools
from strandloom.config import SINKS, Config, ConfigError, InputError, StrandloomError, ToolMissing
from strandloom.operators import combine
from strandloom.sources import annotation, tables
from strandloom.streaming import arrivals
from tests.genomes import random_gene, write_genome


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("genomes")


@pytest.fixture(scope="module")
def result(spark, folder):
    paths = []
    for g in range(4):
        genes = [(f"gene{k}", 201 + 300 * k, 290 + 300 * k, "+-"[k % 2], random_gene(100 + k)) for k in range(5) if (g, k) != (3, 4)]
        paths.append(write_genome(folder, f"g{g}", genes, seed=g))
    return pipeline.run(spark, paths, Config(output=f"file://{folder}/out", formats=SINKS))


def test_clusters_follow_sequences_not_ids(result):
    got = result.placed.groupBy("gene_id").agg({"cluster_id": "min", "genome_id": "count"}).collect()
    assert len({r[1] for r in got}) == 5 and {r["count(genome_id)"] for r in got} == {3, 4}


def test_graph_is_the_gene_order(result):
    assert result.nodes.count() == 5 and result.edges.count() == 4
    assert {r.support for r in result.edges.collect()} <= {3, 4}


def test_outputs_are_there_and_read_back(spark, result, folder):
    assert set(result.paths) == set(SINKS)
    back = {(r.cluster_id, r.genome_id) for r in tables.rtab(spark, result.paths["rtab"]).collect()}
    assert back == {(r.cluster_id, r.genome_id) for r in result.presence.collect()}
    nodes, edges = tables.graph_markup(spark, result.paths["graph"])
    assert {(r.cluster_id, r.support) for r in nodes.collect()} == {(r.cluster_id, r.support) for r in result.nodes.collect()}
    assert {(r.src, r.dst) for r in edges.collect()} == {(r.src, r.dst) for r in result.edges.collect()}
    assert tables.gene_data(spark, result.paths["genes"]).count() == 5


def test_integrating_a_genome(spark, result, folder):
    path = write_genome(folder, "late", [("n1", 201, 290, "+", random_gene(100)), ("n2", 501, 590, "+", random_gene(999))], seed=9)
    genes = annotation.gff_genes(annotation.whole_files(spark, [path]))
    nodes, edges, placed = combine.integrate(result.nodes, result.edges, result.centroids, genes)
    assert nodes.count() == 6 and {r.new for r in placed.collect()} == {True, False}
    assert "late_n2" in {r.cluster_id for r in nodes.collect()}


def test_merging_graphs(spark, result):
    one = (result.nodes, result.edges, result.centroids)
    nodes, edges = combine.merge_graphs([one, one])
    assert nodes.count() == 5 and edges.count() == 4


def test_streamed_arrivals(spark, result, folder, tmp_path):
    store, inputs = f"file://{tmp_path}/store", tmp_path / "in"
    inputs.mkdir()
    arrivals.write_version(store, 0, result.nodes, result.edges, result.centroids)
    write_genome(inputs, "late2", [("n1", 201, 290, "+", random_gene(101)), ("n2", 501, 590, "-", random_gene(777))], seed=10)
    q = arrivals.watch(spark, str(inputs), store, f"file://{tmp_path}/checkpoint")
    q.awaitTermination(120)
    nodes, edges, centroids = arrivals.read_version(spark, store, 1)
    assert nodes.count() == 6 and centroids.count() == 6


def test_bad_settings_and_inputs(spark, tmp_path):
    with pytest.raises(ConfigError):
        Config(output="x", identity=1.5).validate()
    with pytest.raises(ConfigError):
        Config(output="x", formats=("nope",)).validate()
    p = tmp_path / "e.gff"
    p.write_text("##gff-version 3\n")
    with pytest.raises(InputError):
        pipeline.run(spark, [str(p)], Config(output=f"file://{tmp_path}"))


def test_quality_reports_leave_genomes_out(spark, folder, tmp_path):
    paths = [write_genome(tmp_path, f"q{g}", [("a", 201, 290, "+", random_gene(100))], seed=40 + g) for g in range(3)]
    (tmp_path / "q1.txt").write_text("Completeness: 20\nContamination: 1\n")
    (tmp_path / "q2.txt").write_text("Completeness: 99\nContamination: 1\n")
    config = Config(output=f"file://{tmp_path}/out", qc=(str(tmp_path / "q1.txt"), str(tmp_path / "q2.txt")), lengths=0.5, formats=("summary",))
    got = pipeline.run(spark, paths, config)
    assert {r.genome_id for r in got.genes.select("genome_id").distinct().collect()} == {"q0", "q2"}
    with pytest.raises(ConfigError):
        Config(output="x", lengths=2.0).validate()


def test_a_format_that_fails_is_left_out(result, tmp_path, monkeypatch, caplog):
    def broken(*_):
        raise AnalysisException("no such folder\nmore")

    monkeypatch.setattr(pipeline.sink, "matrix_rtab", broken)
    paths = pipeline.write(result, Config(output=f"file://{tmp_path}/out", formats=("rtab", "summary")))
    assert set(paths) == {"summary"} and "rtab was not written: no such folder" in caplog.text


def test_reports_and_graph_tables(spark, result, folder):
    text = "\n".join(r.value for r in spark.read.text(result.paths["graph_html"]).collect())
    assert "Nodes" in text and "is_core" in text
    assert spark.read.parquet(result.paths["graph_parquet"] + "/edges").columns == ["from", "to", "support", "genome_count"]
    dna = annotation.fasta_records(spark.read.text(result.paths["dna"], wholetext=True))
    assert {r.sequence for r in dna.collect()} == {r.sequence for r in result.centroids.collect()}


def test_groups_for_an_aligner_from_saved_files(spark, tmp_path):
    genes = spark.createDataFrame([("a", "", "x", "c", "1", "9", "+", "5", "ACGT", "T"), ("b", "", "x", "c", "1", "9", "+", "2", "CCCC", "P"), ("c", "", "x", "c", "1", "9", "+", "5", "GGGG", "G"), ("d", "", "x", "c", "1", "9", "+", "5", "", "")], ", ".join(f"{c} string" for c in ("gene_id", "gene_name", "annotation", "contig", "start", "end", "strand", "support", "dna_sequence", "protein_sequence")))
    presence = spark.createDataFrame([(c, f"g{g}") for c, n in (("a", 5), ("b", 2), ("c", 1), ("d", 5)) for g in range(n)], "cluster_id string, genome_id string")
    got = tables.alignment_groups(genes, presence, 5, core=True)
    assert {(r.cluster_id, r.name) for r in got.collect()} == {("a", f"a__g{g}") for g in range(5)}
    assert tables.alignment_groups(genes, presence, 5).count() == 7 and tables.alignment_groups(genes, None, 5).count() == 0


def test_programs_end_in_time():
    assert tools.run(["cat"], stdin=b"x") == b"x"
    with pytest.raises(ToolMissing):
        tools.run(["no-such-program-here"])
    with pytest.raises(StrandloomError):
        tools.run(["sleep", "5"], limit=0.1)
    with pytest.raises(StrandloomError):
        tools.run(["false"])
