"""Column expressions over record headers, alignment records and report values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_fields(header: Column, fallback: bool = True) -> Column:
    """Struct of the fields of a '|'-delimited transcript header: fields 1, 2, 5 and 6 and the last field of digits alone.

    With `fallback`, an absent transcript or gene name is its id.
    """
    part = F.split(header, r"\|")
    field = lambda i: F.nullif(F.try_element_at(part, F.lit(i)), F.lit(""))
    name, gene = field(5), field(6)
    if fallback:
        name, gene = F.coalesce(name, field(1)), F.coalesce(gene, field(2))
    return F.struct(field(1).alias("transcript_id"), field(2).alias("gene_id"), name.alias("transcript_name"), gene.alias("gene_name"), last_number(header).alias("transcript_length"))


def last_number(header: Column) -> Column:
    """The last field of digits alone, null if there is none."""
    return F.try_element_at(F.filter(F.split(header, r"\|"), lambda x: x.rlike("^[0-9]+$")), F.lit(-1)).cast("int")


def length_before_last(name: Column, seq: Column) -> Column:
    """The last field but one if it is a number, else the sequence's length, 0 for '*' and null."""
    field = F.try_element_at(F.split(name, r"\|"), F.lit(-2))
    return F.when(field.rlike("^[0-9]+$"), field.cast("int")).when(seq != "*", F.length(seq)).otherwise(0)


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def cigar_bases(cigar: Column, operations: str) -> Column:
    """Sum of the run lengths of the operations in a CIGAR string; 0 for '*' and null."""
    runs = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)([{operations}])"), F.lit(1))
    return F.coalesce(F.aggregate(F.transform(runs, lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x), F.lit(0))


def tag(columns: Column, prefix: str, last: bool = False) -> Column:
    """Value of the first (or last) of the optional columns that begins with prefix; null if none does."""
    found = F.filter(columns, lambda x: x.startswith(prefix))
    return F.substring(F.try_element_at(found, F.lit(-1 if last else 1)), len(prefix) + 1, 1 << 30)


def percent(n: Column, d: Column) -> Column:
    """100 n / d as a double; 0 where d is 0 or null."""
    return F.coalesce(F.try_divide(F.lit(100.0) * n.cast("double"), d.cast("double")), F.lit(0.0))


def ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def passes(mapped: Column, coverage: Column, identity: Column, mapq: Column, least_coverage: float, least_identity: float, least_mapq: int) -> Column:
    return F.coalesce(mapped & (coverage >= least_coverage) & (identity >= least_identity) & (mapq >= least_mapq), F.lit(False))


def fail_reasons(mapped: Column, coverage: Column, identity: Column, mapq: Column, least_coverage: float, least_identity: float, least_mapq: int) -> Column:
    listed = F.concat_ws(
        ",",
        F.when(coverage < least_coverage, "low_coverage"),
        F.when(identity.isNull() | (identity < least_identity), "low_identity"),
        F.when(mapq < least_mapq, "low_mapq"),
    )
    return F.when(~mapped, "unmapped").otherwise(listed)


def alignment_status(mapped: Column, basic: Column, strict: Column) -> Column:
    return F.when(~mapped, "UNMAPPED").when(strict, "PASS_STRICT").when(basic, "PASS_BASIC").otherwise("LOW_QC")


def kmer_status(matched: Column, strict: float, basic: float) -> Column:
    return F.when(matched >= strict, "PASS_STRICT_KMER").when(matched >= basic, "PASS_BASIC_KMER").otherwise("LOW_KMER")


def positive_pairs(indices: Column, counts: Column) -> Column:
    """How many counts of two parallel slash lists are above 0; the shorter list bounds both; '', '.' and 'NA' are empty lists."""
    zipped = F.arrays_zip(F.split(indices, "/").alias("i"), F.split(counts, "/").alias("c"))
    missing = lambda c: c.isNull() | c.isin("", ".", "NA")
    return F.when(missing(indices) | missing(counts), 0).otherwise(F.size(F.filter(zipped, lambda x: x["i"].isNotNull() & (x["c"].cast("double") > 0)))).cast("long")


def strip_version(gene_id: Column) -> Column:
    return F.regexp_replace(gene_id, r"\.[0-9]+$", "")


def short_label(name: Column, prefixes: tuple[str, ...] = (), suffix: str = "_genomic", labels: dict[str, str] | None = None) -> Column:
    """A sample's label: known prefixes and the suffix off, then the label of a fixed map, if it has one."""
    out = name
    for prefix in prefixes:
        out = F.regexp_replace(out, f"^{prefix}", "")
    out = F.regexp_replace(out, f"{suffix}$", "")
    if labels:
        known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        out = F.coalesce(F.element_at(known, out), out)
    return out


def size_bucket(n: Column) -> Column:
    """2-5, 6-20, 21-100, 101-1000 or >1000; null below 2."""
    return F.when(n.between(2, 5), "2-5").when(n.between(6, 20), "6-20").when(n.between(21, 100), "21-100").when(n.between(101, 1000), "101-1000").when(n > 1000, ">1000")


def region_id(number: Column) -> Column:
    return F.format_string("SR%07d", number)


def human_number(value: Column) -> Column:
    """1.2M, 3.4k or the number as it is."""
    return F.when(value >= 1_000_000, F.format_string("%.1fM", value / 1e6)).when(value >= 1_000, F.format_string("%.1fk", value / 1e3)).otherwise(F.format_string("%d", value.cast("long")))


def six_digits(value: Column) -> Column:
    """A number as text with six significant digits and no zeros after them."""
    text = F.format_string("%.6g", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
