"""Corpus preparation for language-model training, as Spark jobs.

Ten operators over tables shaped like ``documents(doc_id, text, lang, source, n_chars)``. Nothing outside this
subpackage imports it; ``queries.py`` holds the registered queries and ``oracle.py`` their SQL.
"""
