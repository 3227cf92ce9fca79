"""postmill: mail-shaped analytics as PySpark DataFrame builders.

Core packages: ``functions`` (column expressions), ``operators`` (DataFrame to DataFrame), ``plans``
(query language and rule compilers), ``sources`` (readers), ``streaming`` (change feeds, stateful parts).
``llm`` holds the training-text operators; nothing outside it imports it.
"""
