"""Preparing news articles as training text: near copies, filters, scores, secrets, mixing, pieces.

All operators take the article records of the news feeds (``id``, ``content``, ``feed``) and return
DataFrames. Nothing else in the library imports this package.
"""
