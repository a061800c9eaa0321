"""op4: encode and decode every document."""

import public_tokenizers

from thingroups.llm import bpe
from thingroups.llm.common import table
from thingroups.llm.queries import register


@register("op4_byte_bpe")
def op4(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
