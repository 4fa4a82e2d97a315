"""Training-data operators: ten self-contained modules over documents and embeddings.

Nothing outside this folder imports it.
"""
