"""Substring dedup (op 2): fuzzy shared passages by collinear chaining.

Seeds are k-mers of words (ASCII lower case), thinned to window minimizers, so
any two texts that share K + WINDOW - 1 words in a row share a seed.  A seed's
occurrences are joined to its first one by (doc_id, position), never to each
other, so a passage that a third of all documents hold gives one match per
occurrence.  The matches of a document with one source are chained in order of
both positions, with a cost for gaps; the best predecessor is a prefix maximum
in a Fenwick tree over source positions.  Each chain is then aligned word by
word: exact blocks are joined across small gaps by edit distance and extended
at both ends while the alignment pays.  It is broken where the other words of a
gap cost more than the equal words on either side gain, and where fewer than
SHARE of its words are equal.  Aligned pieces of one document that touch are
merged, whatever their sources, under the same two rules, and a merged piece of
MIN_WORDS words or more is a shared passage.

Plan: the text lies packed in blocks (a bucketed table).  Seeds travel as one
row per (block, bucket) with one entry per distinct seed of the block, so a hot
seed is one entry per block; the first occurrences come back the same way.
Chains carry their own words and CONTEXT words on either side, as far as an
alignment may extend; the words of a source are read once per source document
and joined to its chains, an ordinary equi-join that adaptive execution splits for
a hot source, and cut to each chain's window there.  Nothing is collected on the driver.

Edge cases: null, empty or short texts (fewer than K + WINDOW - 1 words) have no
seeds; of rows that repeat a doc_id the one packed first is the source; a null
doc_id sorts before all others; an empty table gives an empty result; other
columns are carried by remove_passages and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.blocks import (BLOCK_BYTES, ENTRY_SCHEMA, NULL_ID, Block, KeyRuns, blocks_of, by_bucket, deltas, entry_rows,
                                drop_blocks, new_block_table, pack, unpack, write_blocks)
from keelson.llm.textops import word_windows
from keelson.session import scratch_path

__all__ = ["chain_matches", "align_chain", "shared_passages", "remove_passages"]

K = 6                  # words per seed
WINDOW = 10            # one seed in every window of so many k-mers
MIN_WORDS = 40         # shorter passages are left alone
MIN_PIECE = 10         # aligned words of one chain, at least
MERGE_GAP = 4          # pieces this close are one passage
GAP_COST = 0.05        # per word skipped in either text
MAX_GAP = 60           # chains break at wider gaps
MATCH, MISMATCH, DROP = 1, -2, 6
SHARE = 0.8            # equal words of a piece and of a passage, at least
BUCKET_BYTES = 8 << 20
CONTEXT = 40           # words around a chain that the alignment may extend into

REPLY_SCHEMA = "block_id long, bucket int, reply binary"
CHAIN_SCHEMA = ("src_block long, src_nth int, src_doc long, doc_id long, block_id long, nth int, md5 string, "
                "anchors binary, first int, words binary, src_from int, src_to int")
PIECE_SCHEMA = ("doc_id long, block_id long, nth int, md5 string, start int, end int, src_doc long, src_start int, "
                "same binary")
PASSAGE_SCHEMA = ("doc_id long, block_id long, nth int, md5 string, start_word int, n_words int, src_doc_id long, "
                  "src_start_word int, n_matched int")


# ---------------------------------------------------------------------- seeds

class _Seeds:
    """Minimizers of a block: key, document, word position."""

    def __init__(self, block: Block):
        self.words = block.text().words(lower=True)
        w = self.words
        h, at = word_windows(w.hash, w.doc, K)
        doc = w.doc[at]
        n = len(h) - WINDOW + 1
        take = np.zeros(len(h), dtype=bool)
        if n > 0:
            least = h[:n].copy()
            for j in range(1, WINDOW):
                np.minimum(least, h[j:j + n], out=least)
            todo = doc[:n] == doc[WINDOW - 1:]
            for j in range(WINDOW):
                hit = todo & (h[j:j + n] == least)
                take[j:j + n] |= hit
                todo &= ~hit
        self.key, self.doc = h[take], doc[take]
        self.pos = at[take] - w.first[self.doc]

    def first_of_each(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, first occurrence of each, key of each seed."""
        order = np.argsort(self.key, kind="stable")
        s = self.key[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        which = np.empty(len(s), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        return s[new], order[new], which


def _seed_batches(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, doc_ids, lengths, body in blocks_of(batch, 4):
                block = Block(doc_ids, lengths, body)
                seeds = _Seeds(block)
                keys, first, _ = seeds.first_of_each()
                rows = []
                for k, a, b, lower in KeyRuns(keys, 64, buckets):
                    used, local = np.unique(seeds.doc[first[a:b]], return_inverse=True)
                    main = pack(deltas(keys[a:b], lower), local.astype(np.uint64), seeds.pos[first[a:b]].astype(np.uint64))
                    side = pack((block.ids[used].astype(np.int64) - NULL_ID).view(np.uint64), used.astype(np.uint64))
                    rows.append((k, len(main).to_bytes(4, "little") + main + side))
                if rows:
                    yield entry_rows(block_id, rows)
    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: for every block the keys whose first occurrence is in another
    block, and where."""
    for bucket, blocks, entries in by_bucket(batches):
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]   # key, doc_id, block, nth, pos
        sizes = []
        for block_id, blob in zip(blocks, entries):
            n = int.from_bytes(blob[:4], "little")
            delta, local, pos = unpack(blob[4:4 + n])
            ids, nth = unpack(blob[4 + n:])
            local = local.astype(np.int64)
            for c, x in zip(cols, (np.cumsum(delta), ids[local], np.full(len(delta), block_id, np.uint64), nth[local], pos)):
                c.append(x)
            sizes.append(len(delta))
        key, doc, owner, nth, pos = (np.concatenate(c) for c in cols)
        order = np.lexsort((owner, doc, key))
        s = key[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        first = np.empty(len(s), dtype=np.int64)
        first[order] = order[new][np.cumsum(new) - 1]
        away = first != np.arange(len(first))
        replies, at = [], 0
        for size in sizes:
            flag = away[at:at + size]
            src = first[at:at + size][flag]
            replies.append(pack(np.flatnonzero(flag).astype(np.uint64), doc[src], owner[src], nth[src], pos[src]))
            at += size
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int32()), pa.array(replies, pa.binary())],
            names=["block_id", "bucket", "reply"])


# ------------------------------------------------------------------- chaining

class _PrefixMax:
    """Fenwick tree of (score, index) maxima over source ranks."""

    def __init__(self, n: int):
        self.best = [(-math.inf, -1)] * (n + 1)

    def update(self, rank: int, value: tuple[float, int]) -> None:
        while rank < len(self.best):
            if value > self.best[rank]:
                self.best[rank] = value
            rank += rank & -rank

    def query(self, rank: int) -> tuple[float, int]:
        out = (-math.inf, -1)
        while rank > 0:
            if self.best[rank] > out:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def chain_matches(pos: np.ndarray, src: np.ndarray, weight: int = K, gap_cost: float = GAP_COST,
                  max_gap: int = MAX_GAP) -> list[list[tuple[int, int]]]:
    """Ordered chains of matches (pos, src), both strictly rising; every match
    is in one chain, the best one first.  A chain scores ``weight`` per match
    less ``gap_cost`` per word from match to match in either text.  Chains are
    cut where they skip more than ``max_gap`` words."""
    order = np.lexsort((src, pos))
    p, s = pos[order].tolist(), src[order].tolist()
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(s)))}
    tree = _PrefixMax(len(ranks))
    score, back = [0.0] * len(p), [-1] * len(p)
    waiting: list[int] = []          # matches of the current position: not yet predecessors
    for i in range(len(p)):
        if waiting and p[waiting[0]] != p[i]:
            for j in waiting:
                tree.update(ranks[s[j]], (score[j] + gap_cost * (p[j] + s[j]), j))
            waiting = []
        value, j = tree.query(ranks[s[i]] - 1)
        score[i] = float(weight)
        linked = value - gap_cost * (p[i] + s[i])
        if j >= 0 and linked > 0:
            score[i], back[i] = weight + linked, j
        waiting.append(i)
    used, chains = [False] * len(p), []
    for i in sorted(range(len(p)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append((p[i], s[i]))
            i = back[i]
        if chain:
            chain, piece = chain[::-1], []
            for match in chain:
                if piece and max(match[0] - piece[-1][0], match[1] - piece[-1][1]) > max_gap:
                    chains.append(piece)
                    piece = []
                piece.append(match)
            chains.append(piece)
    return chains


def _chain_batches(buckets: int) -> Callable:
    fields = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(),
              pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    names = ["src_block", "src_nth", "src_doc", "doc_id", "block_id", "nth", "md5", "anchors", "first", "words",
             "src_from", "src_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, doc_ids, lengths, body, replies in blocks_of(batch, 5):
                rows = list(_block_chains(Block(doc_ids, lengths, body), block_id, replies, buckets))
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[c] for r in rows[k:k + 5000]], kind) for c, kind in enumerate(fields)], names=names)
    return run


def _block_chains(block: Block, block_id: int, replies: list[dict] | None, buckets: int) -> Iterator[tuple]:
    seeds = _Seeds(block)
    keys, first, which = seeds.first_of_each()
    # where each distinct key occurs first: here, unless a bucket says otherwise
    src_block = np.full(len(keys), block_id, dtype=np.int64)
    src_nth, src_pos = seeds.doc[first].astype(np.int64), seeds.pos[first].astype(np.int64)
    src_doc = block.ids[src_nth].copy()
    runs = KeyRuns(keys, 64, buckets)
    for row in replies or []:
        at, doc, owner, nth, pos = unpack(row["reply"])
        at = at.astype(np.int64) + runs.find(row["bucket"])[0]
        src_block[at], src_nth[at], src_pos[at] = owner.astype(np.int64), nth.astype(np.int64), pos.astype(np.int64)
        src_doc[at] = doc.view(np.int64) + NULL_ID
    b, n, p, d = src_block[which], src_nth[which], src_pos[which], src_doc[which]
    away = np.flatnonzero((b != block_id) | (n != seeds.doc))    # a repeat inside its own document is no match
    if not len(away):
        return
    doc, pos, b, n, p, d = seeds.doc[away], seeds.pos[away], b[away], n[away], p[away], d[away]
    order = np.lexsort((pos, n, b, doc))
    doc, pos, b, n, p, d = (x[order] for x in (doc, pos, b, n, p, d))
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (b[1:] != b[:-1]) | (n[1:] != n[:-1])) + 1
    digests: dict[int, str] = {}
    short = (seeds.words.hash >> np.uint64(32)).astype("<u4")
    for lo, hi in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(doc)]]).tolist()):
        nth = int(doc[lo])
        base, count = int(seeds.words.first[nth]), int(seeds.words.count[nth])
        if nth not in digests:
            digests[nth] = hashlib.md5(block.data[block.starts[nth]:block.ends[nth]].tobytes()).hexdigest()
        for chain in chain_matches(pos[lo:hi], p[lo:hi]):
            a = max(0, chain[0][0] - CONTEXT)
            z = min(count, chain[-1][0] + K + CONTEXT)
            yield (int(b[lo]), int(n[lo]), int(d[lo]), int(block.ids[nth]), block_id, nth, digests[nth],
                   np.array(chain, "<i4").tobytes(), a, short[base + a:base + z].tobytes(),
                   max(0, chain[0][1] - CONTEXT), chain[-1][1] + K + CONTEXT)


# ------------------------------------------------------------------ alignment

def _edit_matches(a: list[int], b: list[int]) -> list[int]:
    """For every word of a the word of b that a best global alignment matches it
    to, or -1 (longest common subsequence, one bit per word of a)."""
    out = [-1] * len(a)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for y in b:
        hit = rows[-1] & where.get(y, 0)
        rows.append((rows[-1] + hit | rows[-1] - hit) & full)
    i, j = len(a), len(b)
    while i and j:
        bit = 1 << (i - 1)
        if rows[j] & bit:
            i -= 1
        elif not rows[j - 1] & bit:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out[i] = j
    return out


def _extend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words match in the best ungapped extension along both lists."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, MATCH, MISMATCH))
    peak = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.flatnonzero(peak - score >= DROP)
    end = int(stop[0]) if len(stop) else n
    if not end or score[:end].max() <= 0:
        return same[:0]
    return same[:int(score[:end].argmax()) + 1]


def paying_parts(same: np.ndarray, skips: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) of the parts of an alignment that pay: ``same`` has one flag
    per word, ``skips`` the source words left out before it.  A part starts and
    ends with equal words; inside, no run of other words costs more than the
    part gains on either side of it (a gain counts up to MIN_WORDS: more stands
    alone), and at least SHARE of the words are equal."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    if skips is not None and skips.any():                # left-out words part two equal ones, too
        more = np.flatnonzero(skips[1:].astype(bool) & same[1:] & same[:-1]) + 1
        lo, hi = np.sort(np.concatenate([lo, more])), np.sort(np.concatenate([hi, more]))
    between = lo[1:] - hi[:-1]
    if skips is not None and len(between):
        total = np.concatenate([[0], np.cumsum(skips)])
        between = between + total[lo[1:] + 1] - total[hi[:-1]]
    cost, gain = (-MISMATCH * between).tolist(), (MATCH * (hi - lo)).tolist()
    todo, parts = [(0, len(gain))] if gain else [], []
    while todo:
        a, b = todo.pop()
        cuts = set()
        for step in (range(a, b - 1), range(b - 2, a - 1, -1)):      # gaps, from either end
            right = step.step > 0
            value = min(MIN_WORDS, gain[a if right else b - 1])
            for g in step:
                value -= cost[g]
                if value < 0:
                    cuts.add(g)
                value = min(MIN_WORDS, max(value, 0) + gain[g + 1 if right else g])
        if not cuts and sum(gain[a:b]) < SHARE * MATCH * int(hi[b - 1] - lo[a]):
            cuts = {max(range(a, b - 1), key=cost.__getitem__)}
        if cuts:
            ends = [a, *(g + 1 for g in sorted(cuts)), b]
            todo += zip(ends[:-1], ends[1:])
        else:
            parts.append((int(lo[a]), int(hi[b - 1])))
    return sorted(parts)


def align_chain(anchors: np.ndarray, words: np.ndarray, first: int,
                src: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(start, end, source start, equal words as flags) of the parts of a
    chain's alignment that pay; words are those of the document from ``first``
    on, src the source's; anchors count src from its first word."""
    p, s = anchors[:, 0] - first, anchors[:, 1]
    start, src_start = int(p[0]), int(s[0])
    at, src_at = start, src_start
    same, skips = np.zeros(len(words), bool), np.zeros(len(words) + 1, np.int64)
    near = np.zeros(len(words), np.int64)                # source word that stands by a word
    for x, y in zip(p.tolist(), s.tolist()):
        if x < at or y < src_at:                         # overlapping seeds
            n = min(x + K - at, y + K - src_at)
            x, y = x + K - n, y + K - n
        else:
            n = K
        gap, src_gap = words[at:x], src[src_at:y]        # words between two blocks
        if len(gap) and len(src_gap):
            if len(gap) == len(src_gap) and (gap == src_gap).mean() >= SHARE:
                to = np.where(gap == src_gap, np.arange(len(gap)), -1)
            else:
                to = np.array(_edit_matches(gap.tolist(), src_gap.tolist()))
            same[at:x], near[at:x] = to >= 0, src_at + to
        skips[x] += max(0, len(src_gap) - len(gap))
        same[x:x + n], near[x:x + n] = True, np.arange(y, y + n)
        at, src_at = x + n, y + n
    right = _extend(words[at:], src[src_at:])
    same[at:at + len(right)], near[at:at + len(right)] = right, np.arange(src_at, src_at + len(right))
    left = _extend(words[:start][::-1], src[:src_start][::-1])[::-1]
    same[start - len(left):start], near[start - len(left):start] = left, np.arange(src_start - len(left), src_start)
    return [(first + a, first + b, int(near[a]), same[a:b]) for a, b in paying_parts(same, skips[:-1])]


def _source_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block_id, doc_ids, lengths, body, wanted in blocks_of(batch, 5):
            w = Block(doc_ids, lengths, body).text().words(lower=True)
            short = (w.hash >> np.uint64(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_id] * len(wanted), pa.int64()), pa.array(wanted, pa.int32()),
                 pa.array([short[w.first[i]:w.first[i + 1]].tobytes() for i in wanted], pa.binary())],
                names=["src_block", "src_nth", "src_words"])


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column of packed words, and where each row's begin."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4")[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, "<u4", count=int(at[-1]) // 4) if data is not None else np.zeros(0, "<u4"), at // 4


def _extensions(same: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Length of the best ungapped extension of every row (see _extend), on
    flags of equal words and of words that both sides have."""
    score = np.cumsum(np.where(same, MATCH, MISMATCH), axis=1)
    peak = np.maximum.accumulate(np.maximum(score, 0), axis=1)
    open_ = there & (np.cumsum(peak - score >= DROP, axis=1) == 0)
    score = np.where(open_, score, np.iinfo(score.dtype).min)
    best = score.argmax(axis=1)
    return np.where(score[np.arange(len(score)), best] > 0, best + 1, 0)


def _one_seed_pieces(p: np.ndarray, s: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, src: np.ndarray,
                     src_lo: np.ndarray, src_hi: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(row, start, end, source start, equal words) of the pieces of chains of one
    match: word p of the row's words [lo, hi) is word s of its source's [src_lo,
    src_hi).  Most chains are such; they are extended all at once."""
    step = np.arange(CONTEXT)

    def beside(at: np.ndarray, src_at: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = at[:, None] + sign * step, src_at[:, None] + sign * step
        there = (i >= lo[:, None]) & (i < hi[:, None]) & (j >= src_lo[:, None]) & (j < src_hi[:, None])
        return there & (words[np.where(there, i, 0)] == src[np.where(there, j, 0)]), there

    right, left = beside(p + K, s + K, 1), beside(p - 1, s - 1, -1)
    n_right, n_left = _extensions(*right), _extensions(*left)
    size = n_left + K + n_right
    wrong = ((~right[0] & (step < n_right[:, None])).sum(axis=1) + (~left[0] & (step < n_left[:, None])).sum(axis=1))
    for row in np.flatnonzero(size >= MIN_PIECE).tolist():
        a, n = int(n_left[row]), int(size[row])
        start, src_start = int(p[row]) - a, int(s[row]) - a
        if not wrong[row]:
            yield row, start, start + n, src_start, np.ones(n, dtype=bool)
            continue
        same = np.concatenate([left[0][row, :a][::-1], np.ones(K, dtype=bool), right[0][row, :int(n_right[row])]])
        for x, y in paying_parts(same):
            yield row, start + x, start + y, src_start + x, same[x:y]


def _align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    names = ["doc_id", "block_id", "nth", "md5", "start", "end", "src_doc", "src_start", "same"]
    for batch in batches:
        if not batch.num_rows:
            continue
        (anchors, a_at), (words, w_at), (src, s_at) = (_words_of(batch.column(k)) for k in (5, 7, 8))
        anchors = anchors.view("<i4").reshape(-1, 2).astype(np.int64)
        a_at = a_at // 2
        first, src_from = np.asarray(batch.column(6)).astype(np.int64), np.asarray(batch.column(9)).astype(np.int64)
        one = np.flatnonzero(np.diff(a_at) == 1)
        found = []                                       # row, start, end, source start, equal words
        for at in range(0, len(one), 4096):
            rows = one[at:at + 4096]
            to_word, to_src = w_at[rows] - first[rows], s_at[rows] - src_from[rows]
            seed = anchors[a_at[rows]]
            for i, start, end, src_start, same in _one_seed_pieces(seed[:, 0] + to_word, seed[:, 1] + to_src, words, w_at[rows],
                                                                   w_at[rows + 1], src, s_at[rows], s_at[rows + 1]):
                found.append((int(rows[i]), start - int(to_word[i]), end - int(to_word[i]), src_start - int(to_src[i]), same))
        for row in np.flatnonzero(np.diff(a_at) > 1).tolist():
            moved = anchors[a_at[row]:a_at[row + 1]] - np.array([0, src_from[row]])
            found += [(row, start, end, src_start + int(src_from[row]), same) for start, end, src_start, same in align_chain(
                moved, words[w_at[row]:w_at[row + 1]], int(first[row]), src[s_at[row]:s_at[row + 1]])]
        found = [f for f in found if f[2] - f[1] >= MIN_PIECE]
        if found:
            taken = batch.take(pa.array([f[0] for f in found], pa.int64()))
            cols = [taken.column(k) for k in range(4)]
            cols += [pa.array([f[1] for f in found], kinds[4]), pa.array([f[2] for f in found], kinds[5]), taken.column(4),
                     pa.array([f[3] for f in found], kinds[7]), pa.array([np.packbits(f[4]).tobytes() for f in found], kinds[8])]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def _merge_batches(min_words: int) -> Callable:
    """Pieces sorted by (block, nth, start): touching ones are one passage, or
    the parts of it that pay, each credited to the source of its longest piece."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    names = ["doc_id", "block_id", "nth", "md5", "start_word", "n_words", "src_doc_id", "src_start_word", "n_matched"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        for i in (0, 6):
            cols[i] = pa.array(np.asarray(cols[i]), mask=np.asarray(cols[i]) == NULL_ID)
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end_now, pieces, out = None, 0, [], []      # pieces: (start, end, src_doc, src_start, same)

        def close() -> None:                             # the pieces at hand
            if not pieces or end_now - pieces[0][0] < min_words:
                return
            base = pieces[0][0]
            same = np.zeros(end_now - base, bool)
            for start, end, _, _, bits in pieces:
                same[start - base:end - base] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=end - start).astype(bool)
            for lo, hi in paying_parts(same):
                if hi - lo >= min_words:
                    a, z = base + lo, base + hi
                    start, _, src_doc, src_start, _ = max(pieces, key=lambda x: min(x[1], z) - max(x[0], a))
                    out.append((*now, a, hi - lo, src_doc, src_start + max(0, a - start), int(same[lo:hi].sum())))

        for batch in batches:
            for doc_id, block_id, nth, md5, start, end, *piece in zip(*(batch.column(i).to_pylist() for i in range(9))):
                key = (doc_id, block_id, nth, md5)
                if now != key or start > end_now + MERGE_GAP:
                    close()
                    now, end_now = key, end
                    pieces.clear()
                pieces.append((start, end, *piece))
                end_now = max(end_now, end)
            if len(out) >= 5000:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)
    return run


def shared_passages(docs: DataFrame, **options) -> DataFrame:
    """Passages that stand earlier in another document, one row each: doc_id,
    md5 (of its text), start_word, n_words, src_doc_id, src_start_word,
    n_matched (words equal to the source)."""
    return _packed_passages(docs, **options).drop("block_id", "nth")


def _packed_passages(docs: DataFrame, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES,
                     bucket_bytes: int = BUCKET_BYTES, table: str | None = None) -> DataFrame:
    """Shared passages with the packed row (block_id, nth) that each stands in."""
    spark = docs.sparkSession
    path = scratch_path(spark, "passages")
    blocks = write_blocks(docs, block_bytes, table)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    body = ["block_id", "doc_ids", "lengths", "body"]
    entries = blocks.select(*body).mapInArrow(_seed_batches(buckets), ENTRY_SCHEMA)
    replies = written(entries.repartition("bucket").sortWithinPartitions("bucket", "block_id")
                      .mapInArrow(_first_occurrences, REPLY_SCHEMA), "replies")
    per_block = replies.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))
    chains = written(blocks.join(per_block.hint("shuffle_hash"), "block_id", "left").select(*body, "replies")
                     .mapInArrow(_chain_batches(buckets), CHAIN_SCHEMA), "chains")
    wanted = (chains.select("src_block", "src_nth").distinct().groupBy(F.col("src_block").alias("block_id"))
              .agg(F.collect_list("src_nth").alias("wanted")))     # at most the documents of a block
    sources = (blocks.join(wanted.hint("shuffle_hash"), "block_id").select(*body, "wanted")
               .mapInArrow(_source_batches, "src_block long, src_nth int, src_words binary"))
    pieces = (chains.join(sources, ["src_block", "src_nth"])
              .select("doc_id", "block_id", "nth", "md5", "src_doc", "anchors", "first", "words",
                      F.substring("src_words", 4 * F.col("src_from") + 1, 4 * (F.col("src_to") - F.col("src_from"))).alias("src_words"),
                      "src_from")
              .mapInArrow(_align_batches, PIECE_SCHEMA))
    return (pieces.repartition("block_id", "nth").sortWithinPartitions("block_id", "nth", "start", "end", "src_doc", "src_start")
            .mapInArrow(_merge_batches(min_words), PASSAGE_SCHEMA))


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans (the white space before a span
    goes with it); null where no word is left.  Rows without spans pass."""
    from keelson.llm.textops import text_slices
    for batch in batches:
        for rows, text in text_slices(batch):
            w = text.words()
            out: list[str | None] = []
            spans = rows.column(1).to_pylist()
            for i, cut in enumerate(spans):
                if not cut:
                    out.append(rows.column(0)[i].as_py())
                    continue
                a, b = int(text.offsets[i]), int(text.offsets[i + 1])
                parts, at, left = [], a, int(w.count[i])
                first = int(w.first[i])
                for span in sorted(cut, key=lambda x: x["start_word"]):
                    lo, hi = first + span["start_word"], first + span["start_word"] + span["n_words"] - 1
                    begin = int(w.end[lo - 1]) if lo > first else a
                    parts.append(text.data[at:begin].tobytes())
                    at = int(w.end[hi])
                    left -= span["n_words"]
                parts.append(text.data[at:b].tobytes())
                out.append(b"".join(parts).decode() if left else None)
            arrays = list(rows.columns)
            arrays[0] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=rows.schema.names)


def remove_passages(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, without their shared passages (``n_chars``,
    where present, is counted anew); a document of nothing else goes.  Of rows
    that repeat a doc_id and its text, one has the passages of the row packed
    first, the others those that stand in it, too."""
    spark = docs.sparkSession
    path = scratch_path(spark, "remove_passages")
    text, key = F.col("text").cast("string"), ["id", "md5"]
    # the text travels once: the other columns go along without it
    keyed = docs.select(text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
                        F.md5(F.coalesce(text, F.lit(""))).alias("md5"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    table = new_block_table()
    rows = (_packed_passages(docs, table=table, **options)
            .groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "md5", "block_id", "nth")
            .agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans")))
    # all rows of one id and text but the first have the same passages: all that the first has and all seen in it
    at = F.struct("block_id", "nth")
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("cut"), F.min_by("spans", at).alias("first_spans"),
                                    F.max_by("spans", at).alias("spans"))
    copies = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    groups.join(copies, key).withColumn("first_spans", F.when(F.col("cut") == F.col("copies"), F.col("first_spans"))
                                        ).write.parquet(f"{path}/groups")
    drop_blocks(spark, table)
    groups = spark.read.parquet(f"{path}/groups")
    repeated = groups.where("copies > 1").select(*key, "spans", "first_spans")
    repeated.write.parquet(f"{path}/repeated")
    repeated = spark.read.parquet(f"{path}/repeated")
    # rows that repeat are told apart by a number of their own, kept with them
    (keyed.join(repeated.select(*key), key).withColumn("nth_row", F.monotonically_increasing_id())
     .write.parquet(f"{path}/rows"))
    several = spark.read.parquet(f"{path}/rows")
    first = several.groupBy(*key).agg(F.min("nth_row").alias("first_row")).join(repeated, key)
    several = several.join(first, key).select(
        "text", F.when(F.col("nth_row") == F.col("first_row"), F.col("first_spans")).otherwise(F.col("spans")).alias("spans"),
        "row")
    # one pass over one join: the text is shuffled once
    both = (keyed.join(groups.select(*key, "spans", "copies"), key, "left").where("copies is null or copies = 1")
            .select("text", "spans", "row").unionByName(several))
    out = both.mapInArrow(_cut_batches, both.schema).where("text is not null or spans is null")
    return out.select(*[
        F.col("text") if c == "text" else
        (F.coalesce(F.length("text").cast(t), F.col(f"row.`{c}`")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c))
        for c, t in docs.dtypes])
