"""Training-data operators: tokenisation, de-duplication, filtering, formatting and archives.

Nothing outside this subpackage imports it; ``tickloom.llm.queries`` holds the
registered queries and ``corpus_pipeline.py`` chains five of the operators.
"""
