"""Removal of repeated byte strings (100 bytes) within and across documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .passages import Spec, View, repeated

WINDOW, GRAM = 100, 50


def spec_for(window: int) -> Spec:
    return Spec(window=window, gram=max(window // 2, window - 63, 8), words=False, by_document=False)


def _cut(v: View, gone: np.ndarray, i: int) -> bytes:
    a, b = v.at[i], v.at[i + 1]
    g = gone[a:b]
    return v.raw[a:b] if not g.any() else np.frombuffer(v.raw, np.uint8)[a:b][~g].tobytes()


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each byte that a string of `window` bytes covers
    goes, if the string also starts earlier: in a smaller document, or earlier in the same.

    A null text is empty. Rows of one id are documents of their own, in some order. A
    null id counts as the smallest and comes out as null. `window` is at least 16.
    """

    def finish(v: View, gone: np.ndarray) -> pa.Table:
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1
        inner = v.at[1:-1][v.at[1:-1] < len(gone)] if len(v.at) > 2 else np.zeros(0, np.int64)
        edge[inner] = gone[inner]
        total, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
        n = len(v.ids)
        return pa.table(
            [
                pa.array(v.ids, mask=v.ids == -(2**63)),
                pa.array(np.diff(v.at)),
                pa.array(total[v.at[1:]] - total[v.at[:-1]]),
                pa.array((runs[v.at[1:]] - runs[v.at[:-1]]).astype(np.int64)),
                pa.array([hashlib.sha256(_cut(v, gone, i)).hexdigest() for i in range(n)], pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return repeated(docs.select("doc_id", "text"), spec_for(window), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
