"""op1: toxicity of every document."""

from thingroups.llm import toxicity
from thingroups.llm.common import table
from thingroups.llm.queries import register


@register("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
