"""Queries of the numbered problems; each reads its whole tables with the operators' default parameters."""

from __future__ import annotations

from . import mixing, neardup, packing, scanrepair, sentences, subjects, unify, vectors

QUERIES = {
    "p1_found": neardup.p1_found,
    "p1_groups": neardup.p1_groups,
    "p2_found": scanrepair.p2_found,
    "p2_paragraphs": scanrepair.p2_paragraphs,
    "p3_found": subjects.p3_found,
    "p3_shares": subjects.p3_shares,
    "p4_found": vectors.p4_found,
    "p5_found": unify.p5_found,
    "p5_forms": unify.p5_forms,
    "p5_titles_matched": unify.p5_titles_matched,
    "p6_containers": packing.p6_containers,
    "p6_fill": packing.p6_fill,
    "p7_mix": mixing.p7_mix,
    "p7_shares": mixing.p7_shares,
    "p7_shares_of_all": mixing.p7_shares_of_all,
    "p8_found": sentences.p8_found,
}

ORACLE_SQL: dict[str, str] = {}
