"""The part of boosting that runs inside tasks: walking trees and summing gradients of one batch.

Everything here is sent to the Python workers by value, so executors need numpy and pyarrow but not
this package. A tree is (class, column per node, left bins of all nodes, value per node); the bins that
go left are bits of 64-bit words, so that a category may have any number of levels.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

BINS = "__bins"
HESSIAN_FLOOR = 1e-6
DENSE_CELLS = 1 << 15  # columns with more (node, bin) cells are summed sparsely
LOOSE_CELLS = 1 << 19  # sparse sums held by one task
GIVEN_CELLS = 1 << 15  # sums given out at once


def bin_set(bins):
    """Bins as the bits of words."""
    bins = np.asarray(bins, np.int64)
    words = np.zeros(int(bins.max()) // 64 + 1 if len(bins) else 0, np.int64)
    np.bitwise_or.at(words, bins >> 6, np.left_shift(np.int64(1), bins & 63))
    return words


def joined_sets(sets):
    """All nodes' words one after the other, with each node's first word and number of words."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    # One word more, so that a node without words has something to look at.
    return np.cumsum(sizes) - sizes, sizes, np.concatenate([*sets, np.zeros(1, np.int64)])


def walk(feature, left, bins, levels):
    """Node of every row after at most ``levels`` steps from the root."""
    first, sizes, words = left
    node = np.zeros(len(bins), np.int64)
    row = np.arange(len(bins))
    for _ in range(levels):
        column = feature[node]
        inner = column >= 0
        if not inner.any():
            break
        own = bins[row, np.where(inner, column, 0)].astype(np.int64)
        within = (own >> 6) < sizes[node]
        goes_left = (words[first[node] + np.where(within, own >> 6, 0)] >> (own & 63)) & within
        node = np.where(inner, 2 * node + 2 - goes_left, node)
    return node


def list_matrix(column, width):
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def margins(bins, start, trees, depth):
    """Start values (one row for all, or one per row) plus the trees' values."""
    out = np.broadcast_to(start, (len(bins), start.shape[-1])).copy()
    for klass, feature, left, value in trees:
        out[:, klass] += value[walk(feature, left, bins, depth)]
    return out


def as_lists(matrix):
    offsets = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))


def margins_from_prior(shared, depth, width):
    def compute(bins: pa.Array) -> pa.Array:
        prior, trees = shared.value
        return as_lists(margins(list_matrix(bins, width), prior, trees, depth))

    return compute


def margins_from_stored(shared, depth, width):
    def compute(bins: pa.Array, stored: pa.Array) -> pa.Array:
        prior, trees = shared.value
        return as_lists(margins(list_matrix(bins, width), list_matrix(stored, len(prior)), trees, depth))

    return compute


def summed(parts):
    """Sums of (cell, g, h, n) arrays by cell."""
    cells = np.concatenate([p[0] for p in parts])
    found, at = np.unique(cells, return_inverse=True)
    return found, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(found)) for i in (1, 2, 3))


def cell_rows(klass, column, size, cells, sums, sibling):
    """Sums as rows, some at a time; with ``sibling``, also what they take off the sums of the node beside."""
    for at in range(0, len(cells), GIVEN_CELLS):
        cell, (g, h, n) = cells[at : at + GIVEN_CELLS], (x[at : at + GIVEN_CELLS] for x in sums)
        node, bins = (cell // size).astype(np.int32), (cell % size).astype(np.int32)
        if sibling:
            node, bins = np.concatenate([node, node ^ 1]), np.concatenate([bins, bins])
            g, h, n = (np.concatenate([x, -x]) for x in (g, h, n))
        columns = [np.full(len(node), klass, np.int32), node, np.full(len(node), column, np.int32), bins, g, h, n]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["class", "node", "feature", "bin", "g", "h", "n"])


def gradient_sums(prior, growing, level, columns, sizes, width, taken=None):
    """For ``mapInArrow``: sums of gradient, hessian and weight of the task's rows by
    (class, node of the level, column, bin).

    Rows carry their margins (``__f``; before the first tree all have the prior's), so the cost doesn't
    depend on the trees grown before. ``taken`` has the nodes to sum for each class, of two siblings the
    one with fewer rows: the other's sums are their parent's less these, which are given out negated too.
    ``sizes`` has the number of bins of each column. Columns with few cells have an array of them all;
    those with many levels keep the cells that occur, and give them out whenever there are too many.
    """
    first, nodes, k = 2**level - 1, 2**level, len(prior)
    sibling = taken is not None

    def sums(batches):
        dense = {(c, j): np.zeros((3, nodes * sizes[j])) for c in range(k) for j in columns[c] if nodes * sizes[j] <= DENSE_CELLS}
        loose, held = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            binned = list_matrix(batch.column(BINS), width)
            y = batch.column("__y").to_numpy(zero_copy_only=False)
            w = batch.column("__w").to_numpy(zero_copy_only=False)
            m = list_matrix(batch.column("__f"), k) if "__f" in batch.schema.names else np.broadcast_to(prior, (len(binned), k))
            p = np.exp(m - m.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for c, feature, left, _ in growing:
                node = walk(feature, left, binned, level) - first
                here = np.flatnonzero(node >= 0)
                if sibling:
                    here = here[taken[c][node[here]]]
                if not len(here):
                    continue
                wc, pc = w[here], p[here, c]
                measures = (wc * (pc - (y[here] == c)), wc * np.maximum(pc * (1 - pc), HESSIAN_FLOOR), wc)
                for j in columns[c]:
                    cell = node[here] * sizes[j] + binned[here, j]
                    if (c, j) in dense:
                        for i, measure in enumerate(measures):
                            dense[c, j][i] += np.bincount(cell, measure, nodes * sizes[j])
                    else:
                        part = summed([(cell, *measures)])
                        loose.setdefault((c, j), []).append(part)
                        held += len(part[0])
            if held > LOOSE_CELLS:
                held = 0
                for key, parts in loose.items():  # one at a time, so that its parts are freed before the next
                    loose[key] = [summed(parts)]
                    held += len(loose[key][0][0])
                if held > LOOSE_CELLS * 3 // 4:
                    while loose:
                        (c, j), [(cell, *total)] = loose.popitem()
                        yield from cell_rows(c, j, sizes[j], cell, total, sibling)
                    held = 0
        for (c, j), total in dense.items():
            cell = np.flatnonzero(total[2])
            yield from cell_rows(c, j, sizes[j], cell, total[:, cell], sibling)
        while loose:
            (c, j), parts = loose.popitem()
            cell, *total = summed(parts)
            yield from cell_rows(c, j, sizes[j], cell, total, sibling)

    return sums


cloudpickle.register_pickle_by_value(sys.modules[__name__])
