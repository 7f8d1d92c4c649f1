from strandloom.sinks import files as sink
from strandloom.sources import tables

TEXT = r"""graph [
  directed 0
  node [
    id "dnaA"
    label "dnaA"
    support 3
    is_paralog 1
    is_highly_variable 0
    length 6
    seq "ATGAAA,ATGA"
    protein "MK"
    genomes [
      "g1"
      "g2"
    ]
    member "a1;a2"
    contig_end_genomes "g1,g2"
    annotation "[Fe] hydrogenase \"small\" [E. coli] C:\\x node ["
  ]
  node [
    id "b]"
    label "b]"
    support 1
    is_paralog 0
    is_highly_variable 1
    length 0
  ]
  edge [
    source "dnaA"
    target "b]"
    support 2
    genomes [
      "g2"
    ]
  ]
]
"""
NUMBERED = 'graph [\n\tnode [\r\n id 7\n label "x"\n genomes "g1;g2"\n paralog 1\n ]\n node [\n id 8\n label "a"\n ]\n edge [\n source 7\n target 8\n weight 4\n genomes "g1;g3"\n ]\n edge [\n source 9\n target 7\n ]\n]'


def read(spark, path):
    nodes, edges = tables.graph_markup(spark, path)
    return {r.cluster_id: r for r in nodes.collect()}, {(r.src, r.dst): (r.genomes, r.support) for r in edges.collect()}


def test_a_graph_file_as_others_write_it(spark, tmp_path):
    (tmp_path / "g.gml").write_text(TEXT)
    nodes, edges = read(spark, f"file://{tmp_path}/g.gml")
    a, b = nodes["dnaA"], nodes["b]"]
    assert (a.support, a.genomes, a.members, a.contig_end_genomes, a.is_paralog, a.is_highly_variable, a.sequence) == (3, ["g1", "g2"], ["a1", "a2"], ["g1", "g2"], True, False, "ATGAAA")
    assert a.annotation == r'[Fe] hydrogenase "small" [E. coli] C:\x node ['
    assert (b.support, b.genomes, b.is_highly_variable, b.annotation, b.sequence) == (1, [], True, "", "")
    assert edges == {("b]", "dnaA"): (["g2"], 2)}


def test_numbers_for_ids_and_lists_in_one_value(spark, tmp_path):
    (tmp_path / "n.gml").write_text(NUMBERED)
    nodes, edges = read(spark, f"file://{tmp_path}/n.gml")
    assert (nodes["x"].genomes, nodes["x"].is_paralog, nodes["x"].support, nodes["a"].genomes) == (["g1", "g2"], True, 1, [])
    assert edges == {("a", "x"): (["g1", "g3"], 4), ("9", "x"): ([], 0)}


def test_a_large_file_in_many_ranges(spark, tmp_path):
    lines = ["graph ["]
    for i in range(3000):
        lines += ["  node [", f'    id "n{i}"', f"    support {i}", "    genomes [", f'      "g{i}"', '      "h"', "    ]", f'    annotation "[{i}]"', "  ]"]
    for i in range(2999):
        lines += ["  edge [", f'    source "n{i}"', f'    target "n{i + 1}"', f"    support {i}", "  ]"]
    (tmp_path / "big.gml").write_text("\n".join([*lines, "]"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        nodes, edges = read(spark, f"file://{tmp_path}/big.gml")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(nodes) == 3000 and all((r.support, r.genomes, r.annotation) == (int(c[1:]), sorted([f"g{c[1:]}", "h"]), f"[{c[1:]}]") for c, r in nodes.items())
    assert {p: s for p, (_, s) in edges.items()} == {tuple(sorted((f"n{i}", f"n{i + 1}"))): i for i in range(2999)}


def test_what_is_written_reads_back(spark, tmp_path):
    rows = [("a", 2, ["g1", "g2"], ["m1"], ["g1"], True, False, ['x "y" \\ [z]\nw'], "ATGAAATAG"), ("b", 1, [], [], [], False, True, [], None)]
    nodes = spark.createDataFrame(rows, "cluster_id string, support long, genomes array<string>, members array<string>, contig_end_genomes array<string>, is_paralog boolean, is_highly_variable boolean, annotations array<string>, sequence string")
    edges = spark.createDataFrame([("a", "b", ["g1"], 1), ("a", "a", ["g2"], 1)], "src string, dst string, genomes array<string>, support long")
    sink.write_graph(nodes, edges, f"file://{tmp_path}/out.gml")
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out.gml").glob("part-*")) if p.stat().st_size)
    assert text.startswith('graph [\n  directed 0\n  node [\n    id "a"\n    label "a"\n    support 2\n    is_paralog 1\n    is_highly_variable 0\n    length 9\n    seq "ATGAAATAG"\n') and text.endswith("  ]\n]")
    assert '    annotation "x \\"y\\" \\\\ [z] w"\n' in text and '    genomes [\n      "g1"\n      "g2"\n    ]\n    member "m1"\n    contig_end_genomes "g1"\n' in text
    (tmp_path / "one.gml").write_text(text)
    for path in (f"{tmp_path}/out.gml", f"{tmp_path}/one.gml"):
        back, wires = read(spark, f"file://{path}")
        assert (back["a"].support, back["a"].genomes, back["a"].members, back["a"].contig_end_genomes, back["a"].sequence, back["a"].annotation) == (2, ["g1", "g2"], ["m1"], ["g1"], "ATGAAATAG", 'x "y" \\ [z] w')
        assert wires == {("a", "b"): (["g1"], 1), ("a", "a"): (["g2"], 1)}


def test_lines_are_not_shuffled(spark, tmp_path):
    """A block over many ranges, files of few lines beside it, and no exchange but at the borders and of names."""
    big = ["graph [", "  node [", '    id "long"', "    genomes [", *[f'      "g{i:05}"' for i in range(4000)], "    ]", '    annotation "end"', "  ]", "  edge [", '    source "long"', '    target "x"', "  ]", "]"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gml").write_text("\n".join(big))
    (tmp_path / "in" / "b.gml").write_text('node [\n id 1\n label "x"\n]\nedge [\n source 1\n target 1\n]')
    (tmp_path / "in" / "c.gml").write_text("graph [\n]")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        nodes, edges = tables.graph_markup(spark, f"file://{tmp_path}/in")
        assert {r.cluster_id: (len(r.genomes), r.annotation) for r in nodes.collect()} == {"long": (4000, "end"), "x": (0, "")}
        assert sorted((r.src, r.dst) for r in edges.collect()) == [("long", "x"), ("x", "x")]
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Window") <= 2
