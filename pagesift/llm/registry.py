"""Queries of the training-data operators and their DuckDB SQL, where there is one."""

from pagesift.llm.chat_format import OP11_SQL, op11_chat_format
from pagesift.llm.decontaminate import OP2_SQL, op2_decontamination
from pagesift.llm.html_text import op7_main_text
from pagesift.llm.license_scan import op6_license_scan
from pagesift.llm.line_dedup import OP8_SQL, op8_line_dedup
from pagesift.llm.lm_score import op5_lm_score
from pagesift.llm.minhash import op10_near_duplicates
from pagesift.llm.packing import op1_packing
from pagesift.llm.phrases import OP12_SQL, op12_phrases
from pagesift.llm.quality import op9_quality
from pagesift.llm.token_files import op4_token_files
from pagesift.llm.turn_repair import op13_turn_repair
from pagesift.llm.url_filter import OP3_SQL, op3_url_filter

LLM_QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_token_files": op4_token_files,
    "op5_lm_score": op5_lm_score,
    "op6_license_scan": op6_license_scan,
    "op7_main_text": op7_main_text,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_chat_format": op11_chat_format,
    "op12_phrases": op12_phrases,
    "op13_turn_repair": op13_turn_repair,
}

LLM_ORACLE: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_chat_format": OP11_SQL,
    "op12_phrases": OP12_SQL,
}
