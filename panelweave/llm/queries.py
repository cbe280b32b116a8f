"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import corpus_pipeline
from panelweave.llm.decontaminate import OP3_SQL, op3_decontaminate
from panelweave.llm.exact_stream import OP11_SQL, op11_exact_stream
from panelweave.llm.lang_id import op4_language_id
from panelweave.llm.lm_score import op1_lm_score
from panelweave.llm.merkle import OP13_SQL, op13_merkle_manifest
from panelweave.llm.mixing import op2_mix_sources
from panelweave.llm.quality_class import op7_importance
from panelweave.llm.quality_rules import OP9_SQL, op9_quality_rules
from panelweave.llm.secrets import op8_secret_scan, oracle as op8_sql
from panelweave.llm.sentences import OP5_SQL, op5_sentence_spans
from panelweave.llm.simhash import op10_simhash
from panelweave.llm.url_templates import op6_url_templates
from panelweave.llm.zfast_trie import OP12_SQL, op12_prefix_trie

QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_score, op2_mix_sources, op3_decontaminate, op4_language_id, op5_sentence_spans, op6_url_templates, op7_importance,
        op8_secret_scan, op9_quality_rules, op10_simhash, op11_exact_stream, op12_prefix_trie, op13_merkle_manifest,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {
    "op3_decontaminate": OP3_SQL,
    "op5_sentence_spans": OP5_SQL,
    "op8_secret_scan": op8_sql(),
    "op9_quality_rules": OP9_SQL,
    "op11_exact_stream": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
