"""The queries of this subpackage and, where SQL can express them on whole tables, their SQL."""

from .ann import op6_nearest_neighbours
from .bpe import op13_byte_bpe
from .conversations import op12_conversation_repair
from .html import op9_html_extraction
from .jaccard import op1_ngram_jaccard_join
from .licenses import op3_license_scan
from .mixing import op8_source_mix
from .packing import op2_best_fit_packing
from .quality import op10_quality_rules
from .search import op11_lexical_search
from .secrets import op7_secret_scan
from .sql import ORACLES
from .tokens import op5_token_counts
from .urls import op4_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_best_fit_packing,
        op3_license_scan,
        op4_url_filter,
        op5_token_counts,
        op6_nearest_neighbours,
        op7_secret_scan,
        op8_source_mix,
        op9_html_extraction,
        op10_quality_rules,
        op11_lexical_search,
        op12_conversation_repair,
        op13_byte_bpe,
    )
}

__all__ = ["ORACLES", "QUERIES"]
