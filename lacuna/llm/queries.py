"""The queries of this package and the SQL that must give the same rows."""

from __future__ import annotations

from .chat_format import op1_chat_format
from .decontaminate import op10_decontaminate
from .exact_dedup import SQL as EXACT_SQL
from .exact_dedup import op11_exact_dedup
from .filter_audit import SQL as AUDIT_SQL
from .filter_audit import op12_filter_audit
from .mixing import op4_mixing
from .near_dedup import op5_near_dedup
from .neighbours import op7_neighbours
from .pii import op3_pii
from .repeats import op2_repeats
from .secret_scan import op9_secret_scan
from .token_counts import op8_token_counts
from .toxicity import op6_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_repeats": op2_repeats,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_near_dedup": op5_near_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_neighbours": op7_neighbours,
    "op8_token_counts": op8_token_counts,
    "op9_secret_scan": op9_secret_scan,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op11_exact_dedup": EXACT_SQL, "op12_filter_audit": AUDIT_SQL}
