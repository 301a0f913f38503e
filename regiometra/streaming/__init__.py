"""No operator of this package keeps streaming state.

The row-wise ones (coercion, derived columns, membership filters, scoring with a stored
pipeline) are plain projections and filters and take a streaming DataFrame as they are.
"""
