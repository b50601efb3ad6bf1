"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from quire.llm.ann import op3_vector_search
from quire.llm.audio import op4_audio_features
from quire.llm.byte_bpe import op7_byte_bpe
from quire.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from quire.llm.html_extract import op5_html_extract
from quire.llm.line_dedup import OP10_SQL, op10_line_dedup
from quire.llm.lm_scoring import op12_lm_scoring
from quire.llm.packing import op2_best_fit_packing
from quire.llm.periodic_runs import op13_periodic_runs
from quire.llm.quality import op1_quality
from quire.llm.simhash import op9_simhash
from quire.llm.sstable import op8_sorted_tables
from quire.llm.substring_dedup import op6_substring_dedup


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_vector_search": op3_vector_search,
        "op4_audio_features": op4_audio_features,
        "op5_html_extract": op5_html_extract,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_sorted_tables": op8_sorted_tables,
        "op9_simhash": op9_simhash,
        "op10_line_dedup": op10_line_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": _pipeline,
    }


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL}
