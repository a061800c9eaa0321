"""op7: language of every document."""

from thingroups.llm import langid
from thingroups.llm.common import table
from thingroups.llm.queries import register


@register("op7_language_id")
def op7(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))
