"""The subpackage's queries, and the SQL of those that SQL can express."""

from .chat import OP6_SQL, op6_chat_format
from .decontaminate import OP2_SQL, op2_decontamination
from .importance import OP11_SQL, op11_importance_resampling
from .jaccard import OP5_SQL, op5_ngram_jaccard_join
from .langid import op10_language_id
from .merkle import OP12_SQL, op12_merkle_manifest
from .packing import op3_nnls_packing
from .quality import OP9_SQL, op9_quality_rules
from .secrets import OP4_SQL, op4_secret_scan
from .substring import OP7_SQL, op7_substring_dedup
from .token_file import op13_token_file
from .toxicity import op8_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_nnls_packing": op3_nnls_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_chat_format": op6_chat_format,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_file": op13_token_file,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op2_decontamination": OP2_SQL,
    "op4_secret_scan": OP4_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
