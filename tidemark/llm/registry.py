"""The queries of this subpackage, by name, and the SQL of those that SQL expresses."""

from . import chat, quantise
from .bpe import op5_bpe
from .chat import op11_chat
from .decontaminate import op9_decontaminate
from .ngram_join import op2_ngram_join
from .passages import op6_passages
from .pii import op1_pii
from .quality_classifier import op10_quality_classifier
from .quality_rules import op3_quality_rules
from .quantise import op13_vector_codes
from .secrets import op7_secrets
from .suffix_dedup import op8_suffix_dedup
from .warc import op4_warc
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_pii, op2_ngram_join, op3_quality_rules, op4_warc, op5_bpe, op6_passages, op7_secrets, op8_suffix_dedup, op9_decontaminate, op10_quality_classifier, op11_chat, op12_whitening, op13_vector_codes)}

SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS first FROM p
        )
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f
    """,
    "op11_chat": chat.SQL,
    "op13_vector_codes": quantise.SQL,
}
