"""All queries of this package, registered."""

from rillmark.llm import queries_general, queries_near, queries_text  # noqa: F401
from rillmark.llm.queries import REGISTRY  # noqa: F401
