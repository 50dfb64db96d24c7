"""The queries of this subpackage and their SQL, where SQL can express them."""

from gazette.llm import byte_bpe, collocations, license_scan, line_dedup, lm_scoring, merkle, mpeg_audio, near_dedup, packing, sharding, spot_sigs, substring_dedup, toxicity

QUERIES = {
    "op1_packing": packing.query,
    "op2_near_dedup": near_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_sharding": sharding.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_spot_sigs": spot_sigs.query,
    "op7_mpeg_audio": mpeg_audio.query,
    "op8_license_scan": license_scan.query,
    "op9_line_dedup": line_dedup.query,
    "op10_lm_scoring": lm_scoring.query,
    "op11_merkle_manifest": merkle.query,
    "op12_substring_dedup": substring_dedup.query,
    "op13_collocations": collocations.query,
    "spot_links": spot_sigs.links_query,
}
ORACLE_SQL: dict[str, str] = {
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op12_substring_dedup": substring_dedup.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
