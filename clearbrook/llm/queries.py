"""The queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from . import decontaminate, htmltext, jaccard, mixing, negatives, packing, periodic, quality, sharding, substrings, toxicity, urlfilter, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_decontamination": decontaminate.query,
    "op3_url_filter": urlfilter.query,
    "op4_jaccard_join": jaccard.query,
    "op5_quality_rules": quality.query,
    "op6_sharding": sharding.query,
    "op7_toxicity": toxicity.query,
    "op8_mixing": mixing.query,
    "op9_html_extraction": htmltext.query,
    "op10_substring_dedup": substrings.query,
    "op11_packing": packing.query,
    "op12_hard_negatives": negatives.query,
    "op13_periodic_runs": periodic.query,
}

ORACLE_SQL = {
    "op1_warc": warc.SQL,
    "op2_decontamination": decontaminate.SQL,
    "op3_url_filter": urlfilter.SQL,
    "op4_jaccard_join": jaccard.SQL,
    "op5_quality_rules": quality.SQL,
    "op6_sharding": sharding.SQL,
    "op8_mixing": mixing.SQL,
    "op10_substring_dedup": substrings.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_periodic_runs": periodic.SQL,
}
