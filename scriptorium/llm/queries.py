"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from .ann import op10_nearest
from .bpe import op9_byte_bpe
from .chat import OP5_SQL, op5_chat_formatting
from .language_id import op2_language_id
from .packing import op3_packing
from .quality import OP8_SQL, op8_quality_rules
from .simhash import op7_simhash
from .token_files import op6_token_files
from .url_filters import OP1_SQL, op1_url_filters
from .warc import OP4_SQL, op4_warc


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_url_filters,
            op2_language_id,
            op3_packing,
            op4_warc,
            op5_chat_formatting,
            op6_token_files,
            op7_simhash,
            op8_quality_rules,
            op9_byte_bpe,
            op10_nearest,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": OP1_SQL,
        "op4_warc": OP4_SQL,
        "op5_chat_formatting": OP5_SQL,
        "op8_quality_rules": OP8_SQL,
    }
