"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import decontam, licenses, lm, nndescent, packing, phrases, pii, secrets, simhash, tokenfile, toxicity, trie, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm.op1,
    "op2_token_files": tokenfile.op2,
    "op3_personal_data": pii.op3,
    "op4_nn_descent": nndescent.op4,
    "op5_licenses": licenses.op5,
    "op6_decontamination": decontam.op6,
    "op7_toxicity": toxicity.op7,
    "op8_packing": packing.op8,
    "op9_simhash": simhash.op9,
    "op10_secrets": secrets.op10,
    "op11_url_filter": urlfilter.op11,
    "op12_prefix_trie": trie.op12,
    "op13_collocations": phrases.op13,
}
ORACLES: dict[str, str] = {"op4_nn_descent": nndescent.OP4_SQL, "op12_prefix_trie": trie.OP12_SQL, "op13_collocations": phrases.OP13_SQL}
