"""op9: token counts of every document."""

import public_tokenizers

from thingroups.llm import token_counts
from thingroups.llm.common import table
from thingroups.llm.queries import register


@register("op9_token_counts")
def op9(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.over_limit(table(spark, sf_dir, "documents"), path, 512)
