"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm.chat import OP1_SQL, op1_chat
from sparkweave.llm.exact import OP8_SQL, op8_exact_dedup
from sparkweave.llm.langid import op4_langid
from sparkweave.llm.licenses import op6_licenses
from sparkweave.llm.lm import op3_lm_scoring
from sparkweave.llm.packing import op2_packing
from sparkweave.llm.simhash import op5_simhash
from sparkweave.llm.substring import op10_substring
from sparkweave.llm.tokens import op9_bpe
from sparkweave.llm.topk import OP7_SQL, op7_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat,
        op2_packing,
        op3_lm_scoring,
        op4_langid,
        op5_simhash,
        op6_licenses,
        op7_topk,
        op8_exact_dedup,
        op9_bpe,
        op10_substring,
    )
}

ORACLES: dict[str, str] = {"op1_chat": OP1_SQL, "op7_topk": OP7_SQL, "op8_exact_dedup": OP8_SQL}
