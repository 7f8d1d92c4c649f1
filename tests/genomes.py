"""Small annotation files for the tests."""

import random


def write_genome(folder, name, genes, contig=3000, seed=1, kind="CDS"):
    """genes: (id, start, end, strand, sequence or None); sequences are put into the contig."""
    rng = random.Random(seed)
    dna = [rng.choice("ACGT") for _ in range(contig)]
    flip = str.maketrans("ACGT", "TGCA")
    lines = ["##gff-version 3"]
    for gid, start, end, strand, sequence in genes:
        if sequence:
            dna[start - 1 : end] = sequence if strand == "+" else sequence.translate(flip)[::-1]
        lines.append("\t".join(["c1", "t", kind, str(start), str(end), ".", strand, "0", f"ID={gid};product=p {gid}"]))
    text = "".join(dna)
    lines += ["##FASTA", ">c1 contig", *[text[i : i + 80] for i in range(0, len(text), 80)], ""]
    path = folder / f"{name}.gff"
    path.write_text("\n".join(lines))
    return str(path)


def random_gene(seed, n=90):
    rng = random.Random(seed)
    return "ATG" + "".join(rng.choice("ACGT") for _ in range(n - 3))
