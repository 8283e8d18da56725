"""All registered queries of this subpackage."""

from cloakwork.llm import registry
from cloakwork.llm import chat_queries, document_queries, model_queries, near_queries, token_queries  # noqa: F401  each registers its queries

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
