"""Training-data operators: table jobs over documents, pages and conversations.

Nothing else in the library imports this subpackage.
"""
