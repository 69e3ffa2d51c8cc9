"""Query of byte-level BPE."""

import public_tokenizers

from flowprism.llm import bpe
from flowprism.llm.registry import query, table

RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
