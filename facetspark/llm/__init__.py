"""Training-data operators: one module per operator, registered by ``llm.queries``.

Nothing else in the library imports this subpackage; ``corpus_pipeline.py`` at the
repository top chains five of the operators.
"""
