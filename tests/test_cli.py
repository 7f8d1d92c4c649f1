from strandloom.cli import main
from tests.genomes import random_gene, write_genome


def test_run_and_subcommands(spark, tmp_path, capsys):
    paths = [write_genome(tmp_path, f"g{g}", [(f"x{k}", 201 + 300 * k, 290 + 300 * k, "+", random_gene(50 + k)) for k in range(3)], seed=g) for g in range(3)]
    out = f"file://{tmp_path}/out"
    assert main(["run", *paths, "-o", out, "--formats", "rtab,graph,genes", "--no-refind"], spark) == 0
    assert main(["analyze", "--rtab", f"{out}/gene_presence_absence.Rtab", "-o", f"{out}/a", "--accumulation", "--abundance", "--itol", "--graph", f"{out}/final_graph.gml", "--neighbourhood", "cluster_1", "--depth", "1"], spark) == 0
    assert spark.read.csv(f"{out}/a/neighbourhood.csv", header=True).count() == 3
    assert spark.read.csv(f"{out}/a/power_law.csv", header=True).count() == 1
    capsys.readouterr()
    assert main(["extract-gene", f"{out}/gene_data.csv", "cluster_0"], spark) == 0
    assert capsys.readouterr().out.splitlines()[1] == random_gene(50)
    assert main(["extract-gene", f"{out}/gene_data.csv", "nope"], spark) == 1
    late = write_genome(tmp_path, "late", [("n", 201, 290, "+", random_gene(51))], seed=8)
    assert main(["integrate", f"{out}/final_graph.gml", late, "-o", f"{out}/more.gml"], spark) == 0
    assert main(["merge", f"{out}/final_graph.gml", f"{out}/more.gml", "-o", f"{out}/both.gml"], spark) == 0
    assert main(["filter-pa", f"{out}/gene_data.csv", "-o", f"{out}/filtered.csv"], spark) == 0
    assert main(["msa", *paths, "-o", f"{out}/msa"], spark) == 0


def test_association_and_quality(spark, tmp_path):
    (tmp_path / "m.Rtab").write_text("Gene\tg1\tg2\tg3\tg4\na\t1\t1\t0\t0\nb\t1\t1\t1\t1\n")
    (tmp_path / "p.tsv").write_text("genome\tresistant\ng1\t1\ng2\t1\ng3\t0\ng4\t0\n")
    out = f"file://{tmp_path}/o"
    assert main(["analyze", "--rtab", str(tmp_path / "m.Rtab"), "-o", out, "--phenotypes", str(tmp_path / "p.tsv"), "--epistasis"], spark) == 0
    rows = {r["cluster_id"]: float(r["p_value"]) for r in spark.read.csv(f"{out}/associations.csv", header=True).collect()}
    assert abs(rows["a"] - 1 / 3) < 1e-9 and rows["b"] == 1.0
    for name, text in (("good", "Completeness: 95.5\nContamination: 1"), ("bad", "completeness 60\ncontamination 3")):
        (tmp_path / f"{name}.txt").write_text(text)
    (tmp_path / "ani.tsv").write_text("/x/good.fa\t/x/bad.fa\t95.0\n")
    assert main(["qc", str(tmp_path / "good.txt"), str(tmp_path / "bad.txt"), "-o", out, "--ani", str(tmp_path / "ani.tsv")], spark) == 0
    assert {r["genome_id"]: r["passed"] for r in spark.read.csv(f"{out}/qc.csv", header=True).collect()} == {"good": "true", "bad": "false"}
    (tmp_path / "q.tsv").write_text("genome\tx\nzz\t1\n")
    assert main(["analyze", "--rtab", str(tmp_path / "m.Rtab"), "-o", out, "--phenotypes", str(tmp_path / "q.tsv")], spark) == 1


def test_structure_tree_and_several_traits(spark, tmp_path):
    genomes = [f"g{k}" for k in range(8)]
    lines = ["Gene\t" + "\t".join(genomes), "a\t" + "\t".join("11101000"), "b\t" + "\t".join("10101010"), "core\t" + "\t".join("1" * 8)]
    (tmp_path / "m.Rtab").write_text("\n".join(lines) + "\n")
    (tmp_path / "p.csv").write_text("genome,resistant,growth.rate\n" + "".join(f"{g},{int(k < 4)},{'' if k == 7 else k * k}\n" for k, g in enumerate(genomes)))
    (tmp_path / "t.nwk").write_text("((g0:1,g1:1,g2:1)x:2,(g3:1,g4:1)y:1,(g5:1,g6:1,g7:1)z:3)r;\n")
    out = f"file://{tmp_path}/o"
    common = ["analyze", "--rtab", str(tmp_path / "m.Rtab"), "-o", out]
    assert main([*common, "--phenotypes", str(tmp_path / "p.csv")], spark) == 1
    (tmp_path / "b.csv").write_text("genome,resistant,second\n" + "".join(f"{g},{int(k < 4)},{k % 2 if k else ''}\n" for k, g in enumerate(genomes)))
    assert main([*common, "--phenotypes", str(tmp_path / "b.csv")], spark) == 0
    assert {r["trait"] for r in spark.read.csv(f"{out}/associations.csv", header=True).collect()} == {"resistant", "second"}
    assert main([*common, "--phenotypes", str(tmp_path / "p.csv"), "--structured", "--continuous", "--tree", str(tmp_path / "t.nwk")], spark) == 0
    rows = {(r["cluster_id"], r["trait"]): r for r in spark.read.csv(f"{out}/associations.csv", header=True).collect()}
    assert len(rows) == 6 and rows["a", "growth.rate"]["n"] == "7" and float(rows["core", "resistant"]["p_value"]) == 1.0
    changes = {r["name"]: (r["gains"], r["losses"]) for r in spark.read.csv(f"{out}/branch_changes.csv", header=True).collect()}
    assert changes["x"] == ("2", "0") and changes["g1"] == ("0", "1") and changes["g4"] == ("2", "0")
    assert {r["parameter"] for r in spark.read.csv(f"{out}/panstripe_rates.csv", header=True).collect()} == {"gain_rate", "loss_rate", "alpha", "convergence", "r_squared"}
