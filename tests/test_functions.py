import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as seq
from strandloom.functions import text as txt


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_reverse_complement_and_slices(spark):
    contig = F.lit("GCTAGCTA")
    got = one(spark, seq.reverse_complement(F.lit("AaCgN")), seq.slice_sequence(F.lit("ATCGATCG"), F.lit(1), F.lit(4), F.lit("+")), seq.slice_sequence(contig, F.lit(2), F.lit(5), F.lit("-")), seq.slice_sequence(contig, F.lit(5), F.lit(9), F.lit("+")))
    assert got == ("NCGTT", "ATCG", "CTAG", "")


@pytest.mark.parametrize("dna,with_stop,protein", [("ATGTTTTTCTAA", "MFF*", "MFF"), ("GTGTTT", "MF", "MF"), ("TTGTTT", "MF", "MF"), ("ATGNTT", "MX", "MX"), ("AT", "", ""), ("augUUU", "MF", "MF"), ("", "", "")])
def test_translation(spark, dna, with_stop, protein):
    assert one(spark, seq.translate_with_stop(F.lit(dna)), seq.translate(F.lit(dna))) == (with_stop, protein)


@pytest.mark.parametrize("a,b,want", [("ATCGATCGATCG", "GGGGGGGGGGGG", 0.25), ("ATCGATCG", "ATCGGGGG", 0.625), ("ATCG", "ATCGTT", 1.0), ("", "A", 0.0)])
def test_identity_by_min(spark, a, b, want):
    assert one(spark, seq.identity_by_min(F.lit(a), F.lit(b)))[0] == pytest.approx(want)


def test_identity_by_max_folds_case(spark):
    assert one(spark, seq.identity_by_max(F.lit("acgt"), F.lit("ACGTAC")))[0] == pytest.approx(4 / 6)


@pytest.mark.parametrize("q,t,want", [("ATCG", "XXXATCGYYY", 0), ("ATCG", "XXXATCAYYY", 1), ("AAA", "TTTTTT", 3), ("ACGT", "", 4), ("ACGT", "AGT", 1)])
def test_infix_distance(q, t, want):
    assert seq.infix_distance(q, t) == want


def test_infix_distance_agrees_with_all_substrings(spark):
    import random

    rng = random.Random(3)

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(60):
        q, t = ("".join(rng.choice("ACG") for _ in range(rng.randint(1, n))) for n in (6, 9))
        want = min(edit(q, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert seq.infix_distance(q, t) == want


def test_attributes_and_escapes(spark):
    m, esc, back, stem = one(spark, txt.attributes(F.lit("ID=a;x=1=2;ID=b;bare")), txt.gff_escape(F.lit("a%;b,c")), txt.gml_unescape(txt.gml_escape(F.lit('a"&b'))), txt.file_stem(F.lit("file:/x/y.z/genome.v1.gff")))
    assert (m, esc, back, stem) == ({"ID": "b", "x": "1=2"}, "a%25%3Bb%2Cc", 'a"&b', "genome.v1")


def test_fasta_scan_reads_texts_with_record_lines(spark, tmp_path):
    from strandloom.plans import functions_queries

    texts = ["ac gt\n", ">inner one\nAC\nGT\n>empty\n\n>two\r\nTT", "AA\n> quoted reply\nCC", None, "a > b"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        record = [f"en{i}", ""]
        for line in (t or "").splitlines():
            if line.startswith(">"):
                want.append(tuple(record))
                record = [(line[1:].split() or [""])[0], ""]
            else:
                record[1] += "".join(line.split())
        want.append(tuple(record))
    got = [(r.id, r.length) for r in functions_queries.fasta_scan(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((i, len(s)) for i, s in want if s)
