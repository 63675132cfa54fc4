"""The text operators as queries over the tables of one directory, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelflot.llm.byte_bpe import op9_byte_bpe
from shelflot.llm.dac_tokens import op6_token_files
from shelflot.llm.host_rules import OP8_SQL, op8_host_rules
from shelflot.llm.html_text import op1_html_text
from shelflot.llm.jaccard_join import op7_jaccard_join
from shelflot.llm.language import op10_language
from shelflot.llm.mixing import op3_source_mix
from shelflot.llm.near_vectors import op2_near_vectors
from shelflot.llm.periodic_runs import op11_periodic_runs
from shelflot.llm.secret_scan import OP4_SQL, op4_secret_scan
from shelflot.llm.toxicity import op5_toxicity
from shelflot.llm.turn_repair import op12_turn_repair
from shelflot.llm.winnowing import OP13_SQL, op13_decontaminate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_near_vectors,
        op3_source_mix,
        op4_secret_scan,
        op5_toxicity,
        op6_token_files,
        op7_jaccard_join,
        op8_host_rules,
        op9_byte_bpe,
        op10_language,
        op11_periodic_runs,
        op12_turn_repair,
        op13_decontaminate,
    )
}

ORACLES: dict[str, str] = {"op4_secret_scan": OP4_SQL, "op8_host_rules": OP8_SQL, "op13_decontaminate": OP13_SQL}
