"""The operators over the whole of their tables."""

from __future__ import annotations

from tablefeed.llm.decontaminate import OP13_SQL, op13_benchmark_decontamination
from tablefeed.llm.divergence import OP11_SQL, op11_source_divergence
from tablefeed.llm.embed_dedup import OP1_SQL, op1_embedding_near_dedup
from tablefeed.llm.html import op7_html_extraction
from tablefeed.llm.interaction import OP12_SQL, op12_filter_interaction
from tablefeed.llm.minhash import op3_minhash_near_dedup
from tablefeed.llm.mixing import op2_mixing_sources
from tablefeed.llm.neighbours import op8_nearest_neighbours
from tablefeed.llm.packing import op10_best_fit_packing
from tablefeed.llm.quality import op5_quality_classifier
from tablefeed.llm.secrets import op9_secret_scan
from tablefeed.llm.sharding import op6_sharding
from tablefeed.llm.tokens import op4_token_counts

QUERIES = {
    query.__name__: query
    for query in (
        op1_embedding_near_dedup,
        op2_mixing_sources,
        op3_minhash_near_dedup,
        op4_token_counts,
        op5_quality_classifier,
        op6_sharding,
        op7_html_extraction,
        op8_nearest_neighbours,
        op9_secret_scan,
        op10_best_fit_packing,
        op11_source_divergence,
        op12_filter_interaction,
        op13_benchmark_decontamination,
    )
}

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": OP1_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_filter_interaction": OP12_SQL,
    "op13_benchmark_decontamination": OP13_SQL,
}
