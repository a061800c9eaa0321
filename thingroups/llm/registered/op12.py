"""op12: every vector whitened along the first eight components."""

from thingroups.llm import whitening
from thingroups.llm.common import table
from thingroups.llm.queries import register


@register("op12_whitening")
def op12(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))
