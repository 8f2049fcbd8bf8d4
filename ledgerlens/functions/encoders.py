"""Text encoders for the similarity check: pandas batches of text → vectors.

An encoder is a function ``list[str] -> 2-d array`` with unit-length rows. It runs
inside Spark tasks on Arrow batches of *distinct* values only. None is shipped: the
built-in n-gram vectors are column expressions (``operators.text.ngram_vectors``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Encoder = Callable[[list[str]], np.ndarray]
