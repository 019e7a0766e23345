"""Training-data operators.  Nothing outside this subpackage imports it; its queries are in ``pairlens.llm.queries``."""
