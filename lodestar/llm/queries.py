"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.bytebpe import op12_byte_bpe
from lodestar.llm.chat import OP2_SQL, op2_chat
from lodestar.llm.imatch import op3_imatch
from lodestar.llm.langid import op6_language
from lodestar.llm.maintext import op5_main_text
from lodestar.llm.media import op10_media
from lodestar.llm.ngram_join import op9_ngram_join
from lodestar.llm.packing import op1_packing
from lodestar.llm.pieces import op8_pieces
from lodestar.llm.repair import OP11_SQL, op11_repair
from lodestar.llm.runs import op13_runs
from lodestar.llm.token_output import op4_token_files
from lodestar.llm.toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_chat": op2_chat,
        "op3_imatch": op3_imatch,
        "op4_token_files": op4_token_files,
        "op5_main_text": op5_main_text,
        "op6_language": op6_language,
        "op7_toxicity": op7_toxicity,
        "op8_pieces": op8_pieces,
        "op9_ngram_join": op9_ngram_join,
        "op10_media": op10_media,
        "op11_repair": op11_repair,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_runs": op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op11_repair": OP11_SQL}
