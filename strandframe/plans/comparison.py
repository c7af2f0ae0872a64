"""The comparison of two sequence catalogues: overlaps, collapse, corrected intervals, replaced tier. What several deliverables need is written to the shared folder once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import EngineConfig
from ..operators import catalog, compare, report, search
from ..sources.shared import stored


@dataclass
class Inputs:
    """sno(name, seq, ord) and union(name, seq, ord) sequences, the union's BED, the catalogue with its tiers, and a genome to place sno in, or None."""

    sno: DataFrame
    union: DataFrame
    union_bed: DataFrame
    catalogue: DataFrame
    genome: search.Genome | None = None
    tier: str = "AluACA"


def deliverables(i: Inputs, config: EngineConfig | None = None, align: bool = False) -> dict[str, DataFrame]:
    """overlaps in report order, relation_sizes, merged sequences, decisions, corrected_bed, replaced catalogue and dropped counts; with a genome placements and their overlaps with the union."""
    c = config or EngineConfig.resolve(spark=i.sno.sparkSession)
    pairs = stored(compare.overlap_report(i.union, i.sno, align, c.kmer, c.min_cov, c.min_contained, c.gap_open, c.gap_extend), "pairs")
    merged, decisions = catalog.collapse(i.sno, i.union, c.offset_tol, c.kmer)
    merged, decisions = stored(merged, "merged"), stored(decisions, "decisions")
    kept = decisions.where("kept = 'snodb'").select("union_name").distinct()
    replaced = merged.where("part = 1").join(kept, merged["name"] == kept["union_name"], "left_semi").select("name", "seq", "ord")
    bed = catalog.corrected_intervals(i.union_bed, replaced)
    out = {
        "overlaps": compare.ordered_report(pairs),
        "relation_sizes": report.relation_sizes(pairs),
        "merged": merged,
        "decisions": decisions,
        "corrected_bed": bed,
        "replaced": catalog.replace_tier(i.catalogue, bed, i.tier),
        "dropped": catalog.dropped_rows(i.catalogue, i.tier),
    }
    if i.genome is not None:
        out["placements"] = stored(search.place(i.sno, i.genome), "placements")
        out["placement_check"] = report.placement_check(out["placements"], bed)
    return out
