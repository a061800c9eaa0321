"""op5: words of every document that lie in benchmark phrases."""

from thingroups.llm import decontaminate
from thingroups.llm.common import table
from thingroups.llm.queries import register


@register("op5_decontaminate")
def op5(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
