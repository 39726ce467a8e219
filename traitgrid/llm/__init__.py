"""Operators of a training-data pipeline over ``documents``, ``embeddings`` and
``conversations``. One module per operator; ``queries`` registers them,
``oracle`` holds the SQL twins where SQL can express the result. Nothing
outside this folder (and ``corpus_pipeline.py``) imports it.

Rules shared by all operators: input columns are selected by name, so extra
columns never clash; a null text has no words; a null ``doc_id`` is carried
through like any other value; empty tables give empty results of the same schema.
"""
