"""Assembling token ids of texts from the ids of their distinct words."""

from __future__ import annotations

import numpy as np

from .common import ragged_take

#: Words that are put together at once; bounds the positions held in memory.
STEP = 1 << 19


def assemble(doc_offsets: np.ndarray, index: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray, end_id: int):
    """Yield (first document, last document + 1, token offsets, ids) for runs of documents.

    ``index``: the distinct word of each word; ``starts``, ``lengths``: its ids
    in ``flat``. Every document's ids end with ``end_id``.
    """
    at, n = 0, len(doc_offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(doc_offsets, doc_offsets[at] + STEP, side="right")) - 1)
        own = index[doc_offsets[at] : doc_offsets[to]]
        sizes = lengths[own]
        ids = flat[ragged_take(starts[own], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[doc_offsets[at + 1 : to + 1] - doc_offsets[at]]
        ids = np.insert(ids, ends, end_id)
        yield at, to, np.concatenate([[0], ends + np.arange(1, to - at + 1)]), ids
        at = to
