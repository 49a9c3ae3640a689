"""The driver's queries over the operators of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from octetflow.llm import embeddings, exact, mixing, stages, substring
from octetflow.llm.bpe import op2_bpe
from octetflow.llm.embeddings import op5_embeddings
from octetflow.llm.exact import op4_exact_dedup
from octetflow.llm.html import op6_html
from octetflow.llm.langid import op7_langid
from octetflow.llm.mixing import op8_mixing
from octetflow.llm.pii import op9_pii
from octetflow.llm.quality import op10_quality
from octetflow.llm.simhash import op1_simhash
from octetflow.llm.substring import op3_substring_dedup

QUERIES = {
    "pipeline": stages.run,
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_embeddings": op5_embeddings,
    "op6_html": op6_html,
    "op7_langid": op7_langid,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": substring.ORACLE,
    "op4_exact_dedup": exact.ORACLE,
    "op5_embeddings": embeddings.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
