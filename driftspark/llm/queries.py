"""Registered queries of this subpackage, and SQL for those that it can express."""

from driftspark.llm.bpe import op2_byte_bpe
from driftspark.llm.chat import OP12_SQL, op12_chat_formatting
from driftspark.llm.html_text import op7_html_extraction
from driftspark.llm.lexical import OP13_SQL, op13_lexical_search
from driftspark.llm.minhash import op3_minhash_neardup
from driftspark.llm.neardup import op1_embedding_neardup
from driftspark.llm.oracle import OP1_SQL, OP3_SQL, OP4_SQL, OP8_SQL
from driftspark.llm.packing import op5_packing
from driftspark.llm.pii import op10_pii_surrogates
from driftspark.llm.quality import op8_quality
from driftspark.llm.resampling import OP11_SQL, op11_target_resampling
from driftspark.llm.secret_scan import op9_secrets
from driftspark.llm.sharding import op6_sharding
from driftspark.llm.suffix import op4_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_neardup, op2_byte_bpe, op3_minhash_neardup, op4_suffix_dedup, op5_packing, op6_sharding, op7_html_extraction,
        op8_quality, op9_secrets, op10_pii_surrogates, op11_target_resampling, op12_chat_formatting, op13_lexical_search,
    )
}
ORACLE: dict[str, str] = {
    "op1_embedding_neardup": OP1_SQL,
    "op3_minhash_neardup": OP3_SQL,
    "op4_suffix_dedup": OP4_SQL,
    "op8_quality": OP8_SQL,
    "op11_target_resampling": OP11_SQL,
    "op12_chat_formatting": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
