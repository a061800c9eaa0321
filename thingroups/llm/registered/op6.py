"""op6: near copies among all documents."""

from thingroups.llm import jaccard
from thingroups.llm.common import table
from thingroups.llm.queries import register


@register("op6_jaccard_join")
def op6(spark, sf_dir):
    return jaccard.near_copies(table(spark, sf_dir, "documents"))
