import numpy as np
import pytest

from seqloom import __main__ as M


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = np.random.default_rng(3)
    folder = tmp_path_factory.mktemp("cli")
    fasta, lines = [], ["contigName\tcontigLen\ttotalAvgDepth\tp/x.bam\tp/x.bam-var\ty\ty-var"]
    for i in range(40):
        x, y = (40, 3) if i % 2 else (4, 30)
        fasta.append(f">c{i} len\n" + "".join(rng.choice(list("ACGT"), 1200)))
        a, b = rng.normal(x, 0.5), rng.normal(y, 0.5)
        lines.append(f"c{i}\t1200\t{(a + b) / 2:.3f}\t{a:.3f}\t1.0\t{b:.3f}\t2.0")
    (folder / "a.fna").write_text("\n".join(fasta) + "\n")
    (folder / "c.tsv").write_text("\n".join(lines) + "\n")
    (folder / "bins").mkdir()
    (folder / "bins" / "one.fna").write_text("\n".join(fasta) + "\n")
    return folder


SIZES = ["--min-contig-size", "1000", "--min-bin-size", "5000", "--min-contig-count", "3", "--n-neighbours", "8"]


def written(folder):
    return sorted(line[1:] for p in ([folder] if folder.is_file() else folder.rglob("*.fna")) if p.is_file() for line in p.read_text().splitlines() if line.startswith(">"))


def test_recover_and_refine_of_its_output(spark, files):
    given = ["-C", str(files / "c.tsv"), *SIZES]
    M.main(["recover", "-r", str(files / "a.fna"), "-o", str(files / "out"), "--skip-refine", "--metrics", str(files / "metrics"), *given])
    assert written(files / "out") == sorted(f"c{i}" for i in range(40))
    lines = [x.split("\t") for p in (files / "metrics").glob("part-*") for x in p.read_text().splitlines()]
    assert lines and all(len(x) == 7 for x in lines) and all(0 <= float(v) for x in lines if int(x[1]) > 1 for v in x[3:])
    with pytest.raises(FileExistsError):
        M.main(["recover", "-r", str(files / "a.fna"), "-o", str(files / "out"), *given])
    M.main(["refine", "-d", str(files / "out"), "-o", str(files / "again"), *given])
    assert written(files / "again") == sorted(f"c{i}" for i in range(40))


def test_refine_of_listed_files_with_a_kmer_table(spark, files):
    from seqloom.functions import sequences as S
    from seqloom.sources import sequences, sinks

    contigs = sequences.read_contigs(spark, str(files / "a.fna"))
    table = S.kmer_table(contigs, "contig", "seq").select("contig", S.frequencies("counts").alias("freqs"))
    sinks.write_kmers(table, str(files / "kmers"))
    M.main(["refine", "-f", str(files / "bins" / "one.fna"), "-C", str(files / "c.tsv"), "-K", str(files / "kmers"), "-o", str(files / "better"), *SIZES])
    assert written(files / "better") == sorted(f"c{i}" for i in range(40))
    for p in (files / "better").glob("*.fna"):
        if "unbinned" not in p.name:
            assert len({int(c[1:]) % 2 for c in written(p)}) == 1


def test_coverage_is_asked_for(spark, files):
    with pytest.raises(SystemExit):
        M.main(["refine", "-d", str(files / "bins"), "-o", str(files / "none"), *SIZES])
