"""The built-in adapter, primer, flank and barcode catalog, and adapter FASTA files.

Catalog rows are collapsed by sequence: the first name stays, and rows that disagree about the
end count for both ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

MIN_LENGTH = 11


@dataclass(frozen=True)
class Adapter:
    name: str
    seq: str
    end: str  # "5", "3" or "both"


# Published oligo sequences; name, end, sequence.
CATALOG = """
LSK114_front 5 CCTGTACTTCGTTCAGTTACGTATTGC
LSK114_rear 3 AGCAATACGTAACTGAAC
LSK109_front 5 AATGTACTTCGTTCAGTTACGTATTGCT
LSK109_rear 3 GCAATACGTAACTGAACGAAGT
RAD both GTTTTCGCATTTATCGTGAAACGCTTTCGCGTTTTTCGTGCGCCGCTTCA
RNA004_rear 3 GGTTGTTTCTGTTGGTGCTG
cDNA_front 5 TTTCTGTTGGTGCTGATATTGCTGGG
cDNA_rear 3 ACTTGCCTGTCGCTCTATCTTCTTT
PCS110_front 5 TTTCTGTTGGTGCTGATATTGCTTT
PCS110_rear 3 ACTTGCCTGTCGCTCTATCTTCAGAGGAGAGTCCGCCGCCCGCAAGTTTT
GEN10X_front 5 CTACACGACGCTCTTCCGATCT
GEN10X_rear 3 GTACTCTGCGTTGATACCACTGCTT
PCR1_front 5 ACTTGCCTGTCGCTCTATCTTC
PCR1_rear 3 GAAGATAGAGCGACAGGCAAGT
PCR2_front 5 TTTCTGTTGGTGCTGATATTGC
PCR2_rear 3 GCAATATCAGCACCAACAGAAA
cDNA_SSP 5 TTTCTGTTGGTGCTGATATTGCTGCCATTACGGCCGGG
NB_front 5 ATTGCTAAGGTTAA
NB_rear 3 CAGCACCT
PBC_front 5 GGTGCTG
PBC_rear 3 TTAACCTTTCTGTTGGTGCTGATATTGC
RBK4_front 5 GCTTGGGTGTTTAACC
RBK_front_legacy 5 TATTGCT
RLB_front 5 CCGTGAC
RLB_rear 3 CGTTTTTCGTGCGCCGCTTC
RAB_16S_rear1 3 AGAGTTTGATCATGGCTCAG
RAB_16S_rear2 3 CGGTTACCTTGTTACGACTT
LWB_rear1 3 ACTTGCCTGTCGCTCTATCTTC
MAB_rear 3 CCATATCCGTGTCGCCCTT
BC01 both AAGAAAGTTGTCGGTGTCTTTGTG
BC02 both TCGATTCCGTTTGTAGTCGTCTGT
BC03 both GAGTCTTGTGTCCCAGTTACCAGG
BC04 both TTCGGATTCTATCGTGTTTCCCTA
BC05 both CTTGTCCAGGGTTTGTGTAACCTT
BC06 both TTCTCGCAAAGGCAGAAAGTAGTC
BC07 both GTGTTACCGTGGGAATGAATCCTT
BC08 both TTCAGGGAACAAACCAAGTTACGT
BC09 both AACTAGGCACAGCGAGTCTTGGTT
BC10 both AAGCGTTGAAACCTTTGTCCTCTC
BC11 both GTTTCATCTATCGGAGGGAATGGA
BC12 both CAGGTAGAAAGAAGCAGAATCGGA
BC13 both AGAACGACTTCCATACTCGTGTGA
BC14 both AACGAGTCTCTTGGGACCCATAGA
BC15 both AGGTCTACCTCGCTAACACCACTG
BC16 both CGTCAACTGACAGTGGTTCGTACT
BC17 both ACCCTCCAGGAAAGTACCTCTGAT
BC18 both CCAAACCCAACAACCTAGATAGGC
BC19 both GTTCCTCGTGCAGTGTCAAGAGAT
BC20 both TTGCGTCCTGTTACGAGAACTCAT
BC21 both GAGCCTCTCATTGTCCGTTCTCTA
BC22 both ACCACTGCCATGTATCAAAGTACG
BC23 both CTTACTACCCAGTGAACCTCCTCG
BC24 both GCATAGTTCTGCATGATGGGTTAG
BC25 both GTAAGTTGGGTATGCAACGCAATG
BC26 both CATACAGCGACTACGCATTCTCAT
BC27 both CGACGGTTAGATTCACCTCTTACA
BC28 both TGAAACCTAAGAAGGCACCGTATC
BC29 both CTAGACACCTTGGGTTGACAGACC
BC30 both TCAGTGAGGATCTACTTCGACCCA
BC31 both TGCGTACAGCAATCAGTTACATTG
BC32 both CCAGTAGAAGTCCGACAACGTCAT
BC33 both CAGACTTGGTACGGTTGGGTAACT
BC34 both GGACGAAGAACTCAAGTCAAAGGC
BC35 both CTACTTACGAAGCTGAGGGACTGC
BC36 both ATGTCCCAGTTAGAGGAGGAAACA
BC37 both GCTTGCGATTGATGCTTAGTATCA
BC38 both ACCACAGGAGGACGATACAGAGAA
BC39 both CCACAGTGTCAACTAGAGCCTCTC
BC40 both TAGTTTGGATGACCAAGGATAGCC
BC41 both GGAGTTCGTCCAGAGAAGTACACG
BC42 both CTACGTGTAAGGCATACCTGCCAG
BC43 both CTTTCGTTGTTGACTCGACGGTAG
BC44 both AGTAGAAAGGGTTCCTTCCCACTC
BC45 both GATCCAACAGAGATGCCTTCAGTG
BC46 both GCTGTGTTCCACTTCATTCTCCTG
BC47 both GTGCAACTTTCCCACAGGTAGTTC
BC48 both CATCTGGAACGTGGTACACCTGTA
BC49 both ACTGGTGCAGCTTTGAACATCTAG
BC50 both ATGGACTTTGGTAACTTCCTGCGT
BC51 both GTTGAATGAGCCTACTGGGTCCTC
BC52 both TGAGAGACAAGATTGTTCGTGGAC
BC53 both AGATTCAGACCGTCTCATGCAAAG
BC54 both CAAGAGCTTTGACTAAGGAGCATG
BC55 both TGGAAGATGAGACCCTGATCTACG
BC56 both TCACTACTCAACAGGTGGCATGAA
BC57 both GCTAGGTCAATCTCCTTCGGAAGT
BC58 both CAGGTTACTCCTCCGTGAGTCTGA
BC59 both TCAATCAAGAAGGGAAAGCAAGGT
BC60 both CATGTTCAACCAAGGCTTCTATGG
BC61 both AGAGGGTACTATGTGCCTCAGCAC
BC62 both CACCCACACTTACTTCAGGACGTA
BC63 both TTCTGAAGTTCCTGGGTCTTGAAC
BC64 both GACAGACACCGTTCATCGACTTTC
BC65 both TTCTCAGTCTTCCTCCAGACAAGG
BC66 both CCGATCCTTGTGGCTTCTAACTTC
BC67 both GTTTGTCATACTCGTGTGCTCACC
BC68 both GAATCTAAGCAAACACGAAGGTGG
BC69 both TACAGTCCGAGCCTCATGTGATCT
BC70 both ACCGAGATCCTACGAATGGAGTGT
BC71 both CCTGGGAGCATCAGGTAGTAACAG
BC72 both TAGCTGACTGTCTTCCATACCGAC
BC73 both AAGAAACAGGATGACAGAACCCTC
BC74 both TACAAGCATCCCAACACTTCCACT
BC75 both GACCATTGTGATGAACCCTGTTGT
BC76 both ATGCTTGTTACATCAACCCTGGAC
BC77 both CGACCTGTTTCTCAGGGATACAAC
BC78 both AACAACCGAACCTTTGAATCAGAA
BC79 both TCTCGGAGATAGTTCTCACTGCTG
BC80 both CGGATGAACATAGGATAGCGATTC
BC81 both CCTCATCTTGTGAAGTTGTTTCGG
BC82 both ACGGTATGTCGAGTTCCAGGACTA
BC83 both TGGCTTGATCTAGGTAAGGTCGAA
BC84 both GTAGTGGACCTAGAACCTGTGCCA
BC85 both AACGGAGGAGTTAGTTGGATGATC
BC86 both AGGTGATCCCAACAAGCGTAAGTA
BC87 both TACATGCTCCTGTTGTTAGGGAGG
BC88 both TCTTCTACTACCGATCCGAAGCAG
BC89 both ACAGCATCAATGTTTGGCTAGTTG
BC90 both GATGTAGAGGGTACGGTTTGAGGC
BC91 both GGCTCCATAGGAACTCACGCTACT
BC92 both TTGTGAGTGGAAAGATACAGGACC
BC93 both AGTTTCCATCACTTCAGACTTGGG
BC94 both GATTGTCCTCAAACTGCCACCTAC
BC95 both CCTGTCTGGAAGAAGAATGGACTT
BC96 both CTGAACGGTCATAGAGTCCACCAT
"""


def catalog_rows() -> list[tuple[int, str, str, str]]:
    """order, name, end, sequence of each line that has a plain ACGT sequence."""
    rows = [line.split() for line in CATALOG.split("\n") if line.strip()]
    return [(i, name, end, seq.upper()) for i, (name, end, seq) in enumerate(rows) if set(seq.upper()) <= set("ACGT")]


def catalog_frame(spark: SparkSession) -> DataFrame:
    """name, end, seq of the collapsed catalog."""
    rows = spark.createDataFrame(catalog_rows(), "ord int, name string, end string, seq string")
    return rows.groupBy("seq").agg(F.min_by("name", "ord").alias("name"), F.when(F.count_distinct("end") > 1, "both").otherwise(F.min("end")).alias("end"), F.min("ord").alias("ord"))


def catalog() -> list[Adapter]:
    found: dict[str, Adapter] = {}
    for _, name, end, seq in catalog_rows():
        old = found.get(seq)
        found[seq] = Adapter(name, seq, end) if old is None else old if old.end == end else Adapter(old.name, seq, "both")
    return list(found.values())


def parse_fasta(text: str) -> tuple[list[Adapter], list[str]]:
    """Usable adapters (both ends) and a warning for each skipped record; no usable one is an error."""
    kept, warnings = [], []
    for record in text.split(">")[1:]:
        head, _, body = record.partition("\n")
        name, seq = (head.split() or [""])[0], "".join(body.split()).upper()
        if not seq or set(seq) - set("ACGT"):
            warnings.append(f"adapter {name!r} skipped: not plain ACGT")
        elif len(seq) < MIN_LENGTH:
            warnings.append(f"adapter {name!r} skipped: shorter than {MIN_LENGTH} bp")
        else:
            kept.append(Adapter(name, seq, "both"))
    if not kept:
        raise ValueError("the adapter FASTA has no usable adapter")
    return kept, warnings


def read_fasta(spark: SparkSession, path: str) -> tuple[list[Adapter], list[str]]:
    """parse_fasta of a small file on any file system that Spark reads."""
    return parse_fasta("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


CATALOG_ORACLE = f"""
select min_by(name, ord) as name, case when count(distinct "end") > 1 then 'both' else min("end") end as "end", seq
from (values {", ".join(f"({i}, '{n}', '{e}', '{s}')" for i, n, e, s in catalog_rows())}) as t(ord, name, "end", seq) group by seq"""
