"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cohortlens.llm.conversations import OP13_SQL, op13
from cohortlens.llm.language import op10
from cohortlens.llm.lines import op3
from cohortlens.llm.media import op7
from cohortlens.llm.merkle import OP11_SQL, op11
from cohortlens.llm.mixing import op6
from cohortlens.llm.packing import op4
from cohortlens.llm.quality import OP9_SQL, op9
from cohortlens.llm.sharding import op12
from cohortlens.llm.simhash import op1
from cohortlens.llm.token_store import op5
from cohortlens.llm.toxicity import op8
from cohortlens.llm.warc import OP2_SQL, op2

QUERIES = {"op1_simhash": op1, "op2_warc": op2, "op3_line_dedup": op3, "op4_best_fit_packing": op4, "op5_token_files": op5, "op6_mixing": op6, "op7_media_columns": op7, "op8_toxicity": op8, "op9_quality_ledger": op9, "op10_language": op10, "op11_merkle": op11, "op12_hilbert_shards": op12, "op13_conversations": op13}
ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op9_quality_ledger": OP9_SQL, "op11_merkle": OP11_SQL, "op13_conversations": OP13_SQL}
