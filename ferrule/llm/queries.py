"""The registered queries of the training-data operators."""

from __future__ import annotations

from .collocations import ORACLE_SQL as PHRASES_SQL
from .collocations import op12_collocations
from .decontaminate import ORACLE_SQL as WINDOWS_SQL
from .decontaminate import op8_decontamination
from .language import op4_language
from .linededup import ORACLE_SQL as LINES_SQL
from .linededup import op6_line_dedup
from .media import ORACLE_SQL as MEDIA_SQL
from .media import op5_media_chunks
from .neardup import op9_near_dedup
from .pieces import op3_sentencepiece
from .pii import op1_pii
from .quality import op7_quality
from .ranking import ORACLE_SQL as RANKING_SQL
from .ranking import op11_ranked_search
from .suffixdedup import ORACLE_SQL as STRINGS_SQL
from .suffixdedup import op10_suffix_dedup
from .tokens import op2_token_store
from .vectorgraph import ORACLE_SQL as VECTORS_SQL
from .vectorgraph import op13_vector_dedup

QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_store": op2_token_store,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language": op4_language,
    "op5_media_chunks": op5_media_chunks,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_collocations": op12_collocations,
    "op13_vector_dedup": op13_vector_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op5_media_chunks": MEDIA_SQL,
    "op6_line_dedup": LINES_SQL,
    "op8_decontamination": WINDOWS_SQL,
    "op10_suffix_dedup": STRINGS_SQL,
    "op11_ranked_search": RANKING_SQL,
    "op12_collocations": PHRASES_SQL,
    "op13_vector_dedup": VECTORS_SQL,
}
