"""Each operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from rootscope.llm.audit import AUDIT_SQL, audit_filters
from rootscope.llm.centroids import CENTROID_SQL, cluster_vectors
from rootscope.llm.common import table
from rootscope.llm.decontaminate import DECONTAMINATE_SQL, contamination
from rootscope.llm.exact import EXACT_SQL, exact_duplicates
from rootscope.llm.html import extract_main_text
from rootscope.llm.linededup import LINES_SQL, remove_repeated_lines
from rootscope.llm.neardup import near_duplicates
from rootscope.llm.packing import pack
from rootscope.llm.pii import find_personal_data
from rootscope.llm.quality import score_quality
from rootscope.llm.tokens import count_tokens
from rootscope.llm.toxicity import score_toxicity
from rootscope.llm.urlfilter import URL_SQL, filter_pages


def _over(operator, *names: str):
    """A query that applies an operator to whole tables."""

    def query(spark, sf_dir):
        return operator(*[table(spark, sf_dir, name) for name in names])

    return query


QUERIES = {
    "op1_token_counts": _over(count_tokens, "documents"),
    "op2_line_dedup": _over(remove_repeated_lines, "documents"),
    "op3_quality": _over(score_quality, "documents", "labels"),
    "op4_packing": _over(pack, "documents"),
    "op5_exact_duplicates": _over(exact_duplicates, "documents"),
    "op6_decontamination": _over(contamination, "documents", "benchmark"),
    "op7_toxicity": _over(score_toxicity, "documents", "labels"),
    "op8_near_duplicates": _over(near_duplicates, "documents"),
    "op9_main_text": _over(extract_main_text, "pages"),
    "op10_personal_data": _over(find_personal_data, "documents"),
    "op11_centroids": _over(cluster_vectors, "embeddings"),
    "op12_url_filters": _over(filter_pages, "pages"),
    "op13_filter_audit": _over(audit_filters, "documents", "labels"),
}

ORACLE = {
    "op2_line_dedup": LINES_SQL,
    "op5_exact_duplicates": EXACT_SQL,
    "op6_decontamination": DECONTAMINATE_SQL,
    "op11_centroids": CENTROID_SQL,
    "op12_url_filters": URL_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
