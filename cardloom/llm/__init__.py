"""Training-data operators: each module holds one operator of the pipeline.

Nothing outside this package imports it, so the rest of the library works when
the package is absent.
"""
