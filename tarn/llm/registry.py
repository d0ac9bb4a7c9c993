"""The queries of this subpackage."""

from __future__ import annotations

from . import oracles
from .decontaminate import op5_decontaminate
from .langid import op3_langid
from .lines import op8_line_dedup
from .minhash import op1_minhash
from .pieces import op2_sentencepiece
from .quality import op4_quality
from .secrets import op7_secret_scan
from .tokenstore import op10_token_store
from .toxicity import op6_toxicity
from .vectors import op9_embedding_dedup

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_langid": op3_langid,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_token_store": op10_token_store,
}
ORACLE_SQL = {"op1_minhash": oracles.MINHASH, "op7_secret_scan": oracles.SECRETS, "op9_embedding_dedup": oracles.VECTORS}
