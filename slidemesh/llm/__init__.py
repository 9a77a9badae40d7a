"""Operators of training-data pipelines over the tables documents, embeddings, pages, labels and conversations."""
