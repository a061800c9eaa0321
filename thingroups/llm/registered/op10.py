"""op10: main text of every page."""

from thingroups.llm import html_extract
from thingroups.llm.common import table
from thingroups.llm.queries import register


@register("op10_html_text")
def op10(spark, sf_dir):
    return html_extract.report(table(spark, sf_dir, "pages"))
