"""Scalar functions over sequences, names and loci, all of them native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(s: Column) -> Column:
    """Reverse complement of ACGTN; other symbols stay as they are."""
    return F.reverse(F.translate(s, "ACGTN", "TGCAN"))


def normalise(s: Column) -> Column:
    return F.upper(F.trim(s))


def find_all(hay: Column, needle: Column) -> Column:
    """0-based places of all occurrences, overlapping ones too; null for an empty needle.

    The text is cut before every occurrence in one pass, so that long texts aren't searched anew from each place.
    """
    ahead = F.concat(F.lit("(?="), F.regexp_replace(needle, r"([^\p{L}\p{N}])", r"\\$1"), F.lit(")"))
    sizes = F.transform(F.split(hay, ahead), lambda piece: F.length(piece))
    grown = lambda ends, n: F.array_append(ends, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + n)
    cuts = F.aggregate(F.slice(sizes, F.lit(1), F.greatest(F.size(sizes) - 1, F.lit(0))), F.array().cast("array<int>"), grown)
    first = F.when(F.startswith(hay, needle), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(F.length(needle) > 0, F.concat(first, cuts))


def canonical(s: Column) -> Column:
    """ACA three bases before the 3' end."""
    return (F.length(s) >= 6) & (F.substring(s, -6, 3) == "ACA")


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def first_index(hay: Column, needle: Column) -> Column:
    """0-based place of the first occurrence, -1 for none."""
    return F.position(needle, hay) - 1


def span(start: Column, end: Column) -> Column:
    return end - start


def overlap_bp(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def gtf_attribute(attributes: Column, key: str) -> Column:
    """Quoted value of a key, empty if absent."""
    return F.regexp_extract(attributes, f'{key} "([^"]+)"', 1)


def field(line: Column, number: int, sep: str = ",") -> Column:
    """Trimmed field from 1, empty if absent."""
    return F.coalesce(F.trim(F.try_element_at(F.split(line, sep), F.lit(number))), F.lit(""))


def repair_table_line(line: Column) -> Column:
    """Drops form feeds and a stray id at the end, and mends the miscased prefix."""
    out = F.regexp_replace(line, "\f", "")
    out = F.regexp_replace(out, r",?\s*AluACA106,\s*$", "")
    return F.regexp_replace(out, "^ALuACA", "AluACA")


def no_host(line: Column) -> Column:
    return F.rlike(line, F.lit("(?i)no apparent host gene"))


def locus(chrom: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    out = F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return out if strand is None else F.concat(out, F.lit("("), strand, F.lit(")"))


def fasta_name(name: Column) -> Column:
    """Cuts ::... and joins alternatives by _."""
    return F.replace(F.regexp_replace(name, "::.*$", ""), F.lit("|"), F.lit("_"))


def header_name(name: Column) -> Column:
    """The same without .idN at the end."""
    return F.regexp_replace(fasta_name(name), r"\.id\d+$", "")


def accession_number(acc: Column) -> Column:
    return F.regexp_extract(acc, r"(\d+)", 1).try_cast("long")


def id_number(name: Column) -> Column:
    """The number in an id, for numeric order."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("long")


def source_tag(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def percent_identity(identical: Column, length: Column) -> Column:
    """Null for an empty alignment."""
    return F.try_divide(100.0 * identical, length)


def coverage(aligned: Column, a_len: Column, b_len: Column) -> Column:
    """Of the shorter sequence; null if that is empty."""
    return F.try_divide(aligned, F.least(a_len, b_len))


def dominant(names: Column) -> Column:
    return F.split(names, r"\|")[0]


def repeat_class(names: Column) -> Column:
    return F.when(names == "none", "none").when(dominant(names).startswith("Alu"), "Alu").otherwise("other")


def json_field(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def symbol_from_summary(body: Column, gene_id: str) -> Column:
    """nomenclaturesymbol, or name where that is empty."""
    own = F.get_json_object(body, f"$.result.{gene_id}.nomenclaturesymbol")
    return F.when(F.length(own) > 0, own).otherwise(F.get_json_object(body, f"$.result.{gene_id}.name"))


def alternatives(names: Column) -> Column:
    return F.replace(names, F.lit(","), F.lit("|"))


def url_quote(s: Column) -> Column:
    """Percent encoding of a URL path: letters, digits and -_.~/ stay."""
    out = F.url_encode(s)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order, none for shorter strings."""
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def is_rna(s: Column) -> Column:
    return F.contains(s, F.lit("U"))
