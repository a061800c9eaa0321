"""op8: secrets in every document."""

from thingroups.llm import secrets
from thingroups.llm.common import table
from thingroups.llm.queries import register


@register("op8_secrets")
def op8(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))
