"""Streaming.

The source application has no streams, watermarks or state, so nothing here adds
operators.  The row-wise operators of the library are plain projections and work on
a streaming DataFrame unchanged: label derivation (P3), NULL-share filter (P6),
applying fitted scaler parameters (N1–N7 ``apply``), and prediction with pipeline
model families (M9 ``predict`` / ``proba_vector``).  ``tests/test_streaming.py``
drives ``predict`` over a file stream to completion with ``availableNow``.
"""
