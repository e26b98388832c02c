"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from loomquery.llm.corpus_pii import op7_corpus_pii
from loomquery.llm.decontamination import op5_decontamination
from loomquery.llm.jaccard_join import op9_jaccard_join
from loomquery.llm.language_id import op2_language_id
from loomquery.llm.lattice_lm import op1_lattice_lm
from loomquery.llm.mixing import OP6_SQL, op6_mixing
from loomquery.llm.quality_classifier import op8_quality_classifier
from loomquery.llm.quality_rules import op4_quality_rules
from loomquery.llm.suffix_dedup import op10_suffix_dedup
from loomquery.llm.token_output import op3_token_output

QUERIES = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_language_id": op2_language_id,
    "op3_token_output": op3_token_output,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_corpus_pii": op7_corpus_pii,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op6_mixing": OP6_SQL,
}
