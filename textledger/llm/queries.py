"""The operators' queries over their whole tables, and DuckDB SQL where SQL can express them."""

from . import chaining, cotraining, fm_index, minhash, mixing, periodic, pivot_search, quotes, ranked, secrets, templates, token_counts, warc

QUERIES = {
    "op1_topk_search": pivot_search.op1_topk_search,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontamination": fm_index.op4_decontamination,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_substring_dedup": chaining.op6_substring_dedup,
    "op7_chat_format": quotes.op7_chat_format,
    "op8_near_dedup": minhash.op8_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality": cotraining.op10_quality,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_main_text": templates.op12_main_text,
    "op13_ranked_search": ranked.op13_ranked_search,
}

ORACLES = {
    "op1_topk_search": pivot_search.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_decontamination": fm_index.OP4_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op7_chat_format": quotes.OP7_SQL,
    "op8_near_dedup": minhash.OP8_SQL,
    "op13_ranked_search": ranked.OP13_SQL,
}
