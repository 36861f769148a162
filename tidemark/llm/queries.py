"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from . import bpe, decontaminate, langid, manifest, neardup, quality, resampling, sharding, substrings, tokencount, topk, urlfilter, warc

QUERIES = {
    "op1_shard": sharding.op1_shard,
    "op2_bpe": bpe.op2_bpe,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_warc_fixity": warc.op4_warc_fixity,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_repeated_passages": substrings.op6_repeated_passages,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language": langid.op8_language,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_topk_search": topk.op10_topk_search,
    "op11_resample": resampling.op11_resample,
    "op12_manifest": manifest.op12_manifest,
    "op13_quality": quality.op13_quality,
}
ORACLE_SQL = {"op4_warc_fixity": warc.OP4_SQL, "op5_near_duplicates": neardup.OP5_SQL, "op7_decontaminate": decontaminate.OP7_SQL, "op9_url_filter": urlfilter.OP9_SQL, "op10_topk_search": topk.OP10_SQL, "op11_resample": resampling.OP11_SQL, "op12_manifest": manifest.OP12_SQL, "op13_quality": quality.OP13_SQL}
