"""Training-data operators: ten Spark jobs over documents, pages and conversations.

Nothing else in the library imports this subpackage.
"""
