"""Language-model scores by subword lattice likelihood.

The vocabulary is that of an existing tokenizer.  Its model holds merge ranks, no unigram scores, so these are
estimated from all training texts: counts of the tokenizer's own segmentation, then re-estimated by ``PASSES``
forward-backward passes over the distinct words, each piece by its expected count over all segmentations.
A text's probability is the sum over all its segmentations into pieces, found by a forward
recursion in log space: ``alpha[j] = logsumexp(alpha[i] + log p(piece i..j))``.  Byte pieces spell any
character, so every text has a segmentation, and pieces and the end mark share one distribution.

Pieces never cross white space (a word starts with its mark), so the lattice of a text is the product of
its words' lattices.  The recursion thus runs once per distinct word of the corpus, not per token, and the
words of about one length are recursed side by side as arrays (very long ones by themselves, sharing the
recursion of common prefixes).

Counts and scores meet the texts by hash range: each text's distinct words go, as arrays, to the bucket of
their 64-bit hash (no two words of the corpus share one: clashes are found and hashed anew), where the bucket's part of the vocabulary comes first in sort order and is held as
arrays (``BUCKET_WORDS`` words in the mean).  A frequent word costs each text one array entry, so no bucket is
hot, and nothing of the vocabulary is broadcast or collected but the bounded table of pieces.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, col, utf8, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BUCKET_WORDS = 250_000
LEAST_BUCKETS = 40
BLOCK = 1 << 20
PASSES = 2            # forward-backward passes over the training words
SHORT = 64            # characters up to which words are recursed side by side
CELLS = 1 << 17       # characters of words that are recursed side by side
_MIX = np.uint64(0x9E3779B97F4A7C15)
LN10 = log(10.0)

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32


class Hasher(dict):
    """Word -> 64-bit number (XXH3).  A number of ``clash``, which several words of the corpus share, is passed over for
    the word's number under the next seed; words are thus told apart once no clash is left.  Bounded cache."""

    def __init__(self, clash=frozenset(), bits: int = 64):
        super().__init__()
        self.clash, self.bits = clash, bits

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest
        if len(self) > 1 << 20:
            self.clear()
        seed = 0
        while (h := xxh3_64_intdigest(word, seed) >> (64 - self.bits)) in self.clash:
            seed += 1
        self[word] = h
        return h


def placed_words(raw: bytes):
    """-> (distinct lower-cased words of a block, for each token its start and the place of its word among them)."""
    low = _TABLE[np.frombuffer(raw, np.uint8)]
    ink = (low != 32) & ((low < 9) | (low > 13))
    start = np.flatnonzero(np.diff(ink.view(np.int8), prepend=np.int8(0)) == 1)
    words = low.tobytes().split()  # at exactly the same bytes
    at: dict[bytes, int] = defaultdict(count().__next__)  # by the word itself, not by its hash; a new word takes the next place
    place = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
    return list(at), start, place


def _hashes(words: list[bytes], hasher: Hasher):
    return np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))


def _blocks(texts):
    """Texts in blocks of about ``BLOCK`` bytes: (joined bytes, offsets of the parts, index of each part's text)."""
    parts, own, size = [], [], 0
    for i, raw in enumerate(texts):
        at = 0
        while raw and at < len(raw):
            end = len(raw)
            if at + BLOCK < end:
                m = _SPACE.search(raw, at + BLOCK)
                end = m.start() if m else end
            parts.append(raw[at:end])
            own.append(i)
            size += end - at + 1
            at = end
            if size >= BLOCK:
                yield b" ".join(parts), np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]]), np.array(own)
                parts, own, size = [], [], 0
    if parts:
        yield b" ".join(parts), np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]]), np.array(own)


def _signed(h):
    return pa.array(h.view(np.int64))


def _count_words(clash, bits: int):
    """mapInArrow (text, learn) -> (h, word, c): words of a block with their count in the learning texts (0: only in others)."""
    def run(batches):
        hasher = Hasher(clash, bits)
        for b in batches:
            texts, learn = utf8(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for raw, offsets, own in _blocks(texts):
                words, start, place = placed_words(raw)
                if not words:
                    continue
                counted = learn[own[np.searchsorted(offsets, start, side="right") - 1]]
                n = np.bincount(place, weights=counted, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([_signed(_hashes(words, hasher)), pa.array(words, pa.binary()), pa.array(n)], names=["h", "word", "c"])
    return run


def _distinct_words(d: DataFrame, bits: int) -> tuple[DataFrame, frozenset]:
    """All distinct words with their hash and count, and the numbers passed over so that no two words share a hash."""
    clash: frozenset = frozenset()
    while True:
        words = d.select("text", (~F.col("held_out")).alias("learn")).mapInArrow(_count_words(clash, bits), "h long, word binary, c long")
        words = written(words.groupBy("h", "word").agg(F.sum("c").alias("c")), "words")
        # of n words n**2 / 2**65 pairs share 64 bits: none below billions of words, a handful beyond
        more = words.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h").collect()
        if not more:
            return words, clash
        clash |= {r.h & 0xFFFFFFFFFFFFFFFF for r in more}


class Pieces:
    """The vocabulary of an existing tokenizer with a log probability for each piece, for byte pieces and for the end."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.encoder.get_piece_size())
        self.use = [i for i in ids if not self.encoder.is_control(i) and not self.encoder.is_unknown(i) and not self.encoder.is_unused(i)]
        self.names = {i: self.encoder.id_to_piece(i) for i in self.use}

    def counts(self, words: list[str], weights) -> np.ndarray:
        """Weighted piece counts of the words in the tokenizer's own segmentation."""
        out = np.zeros(self.encoder.get_piece_size(), np.float64)
        got = self.encoder.encode(words, out_type=int, num_threads=1)
        ids = np.concatenate([np.array(g, np.int64) for g in got]) if got else np.zeros(0, np.int64)
        np.add.at(out, ids, np.repeat(np.asarray(weights, np.float64), [len(g) for g in got]))
        return out

    def weigh(self, counts: dict[int, float], end: float, smoothing: float = 1.0):
        """Set the unigram scores: relative counts, smoothed, of pieces and the end together."""
        total = sum(counts.get(i, 0.0) for i in self.use) + end + smoothing * (len(self.use) + 1)
        score = {self.names[i]: log((counts.get(i, 0.0) + smoothing) / total) for i in self.use}
        self.bytes = [score.get(f"<0x{b:02X}>") for b in range(256)]
        if None in self.bytes:
            raise ValueError("the vocabulary has no byte pieces")
        self.plain = {p: s for p, s in score.items() if not (p.startswith("<0x") and p.endswith(">"))}
        self.lengths: dict[str, list[int]] = {}
        for p in self.plain:
            own = self.lengths.setdefault(p[-1], [])
            if len(p) not in own:
                own.append(len(p))
        for own in self.lengths.values():
            own.sort()
        self.end = log((end + smoothing) / total)
        self.tables = {n: self._table([i for i in self.use if self.names[i] in self.plain and len(self.names[i]) == n])
                       for n in sorted({len(p) for p in self.plain})}

    def _table(self, ids: list[int]):
        """Pieces of one length for look-ups of many places at once: (hashes ascending, characters, scores, ids, hash prefixes in use)."""
        chars = np.array([list(map(ord, self.names[i])) for i in ids], np.uint32)
        h = np.zeros(len(ids), np.uint64)
        for k in range(chars.shape[1]):
            h = h * _MIX + chars[:, k]
        order = np.argsort(h, kind="stable")
        h = h[order]
        if (h[1:] == h[:-1]).any():
            raise ValueError("two pieces share a hash")
        used = np.zeros(1 << 18, bool)
        used[h * _MIX >> np.uint64(46)] = True
        return h, chars[order], np.array([self.plain[self.names[i]] for i in ids])[order], np.array(ids)[order], used

    def _pieces_at(self, c):
        """Characters of words (words x places) -> {length: (scores of the pieces that start there, -inf for none; rows of the table)}."""
        found, h = {}, np.zeros(c.shape, np.uint64)
        for n in range(1, min(max(self.tables), c.shape[1]) + 1):
            h = h[:, :c.shape[1] - n + 1] * _MIX + c[:, n - 1:]
            if n not in self.tables:
                continue
            hashes, chars, scores, _, used = self.tables[n]
            row, place = np.nonzero(used[h * _MIX >> np.uint64(46)])
            near = h[row, place]
            own = np.minimum(np.searchsorted(hashes, near), len(hashes) - 1)
            hit = hashes[own] == near
            row, place, own = row[hit], place[hit], own[hit]
            same = (np.lib.stride_tricks.sliding_window_view(c, n, axis=1)[row, place] == chars[own]).all(axis=1)  # the piece, not its hash alone
            row, place, own = row[same], place[same], own[same]
            if len(row):
                x = np.full(h.shape, -np.inf)
                x[row, place] = scores[own]
                found[n] = x, row, place, own
        return found

    def _side_by_side(self, words: list[str], most: int = SHORT):
        """Blocks of the words of up to ``most`` characters, of about one length: (their places, lengths, characters padded with 0)."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= most]
        at = 0
        while at < len(order):
            least = int(size[order[at]])
            end = int(np.searchsorted(size[order], least + max(1, least // 4), side="right"))
            end = min(end, at + max(1, CELLS // (least + least // 4 + 1)))
            own = order[at:end]
            wide = int(size[own[-1]])
            text = "".join([("▁" + words[k]).ljust(wide, "\0") for k in own])
            yield own, size[own], np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(own), wide)
            at = end

    def _forward(self, c):
        """-> (alpha by word and place, scores of the characters spelled, the pieces found)."""
        kinds, which = np.unique(c, return_inverse=True)
        spelled = np.array([self.spelled(chr(x)) for x in kinds])[which].reshape(c.shape)
        found = self._pieces_at(c)
        alpha = np.zeros((len(c), c.shape[1] + 1))
        for j in range(1, c.shape[1] + 1):
            terms = np.stack([alpha[:, j - 1] + spelled[:, j - 1], *[alpha[:, j - n] + x[0][:, j - n] for n, x in found.items() if n <= j]])
            top = terms.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha, spelled, found

    def spelled(self, c: str) -> float:
        return sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))

    def _sorted_prefixes(self, words: list[str]):
        """The words too long for ``_side_by_side`` in sorted order: (place, marked text, characters shared with the one before)."""
        before = ""
        for k in sorted([k for k, w in enumerate(words) if len(w) >= SHORT], key=words.__getitem__):
            s = "▁" + words[k]
            same, most = 0, min(len(s), len(before))
            while same < most and s[same] == before[same]:
                same += 1
            yield k, s, same
            before = s

    def _extend(self, alpha: list[float], s: str, same: int, spelled: dict[str, float]) -> None:
        """The forward recursion: ``alpha`` of the first ``same`` characters of ``s`` is kept, the rest is found."""
        plain, lengths = self.plain, self.lengths
        del alpha[same + 1:]
        for j in range(same, len(s)):
            c = s[j]
            if c not in spelled:
                spelled[c] = self.spelled(c)
            terms = [alpha[j] + spelled[c]]
            for n in lengths.get(c, ()):
                if n > j + 1:
                    break
                p = plain.get(s[j + 1 - n:j + 1])
                if p is not None:
                    terms.append(alpha[j + 1 - n] + p)
            m = max(terms)
            alpha.append(m + log(sum([exp(t - m) for t in terms])) if len(terms) > 1 else m)

    def marginals(self, words: list[str]) -> list[float]:
        """Natural log of the summed probability of all segmentations of each word."""
        out, alpha, spelled = [0.0] * len(words), [0.0], {}
        for own, size, c in self._side_by_side(words):
            for k, x in zip(own.tolist(), self._forward(c)[0][np.arange(len(own)), size].tolist()):
                out[k] = x
        for k, s, same in self._sorted_prefixes(words):
            self._extend(alpha, s, same, spelled)
            out[k] = alpha[-1]
        return out

    def expected(self, words: list[str], weights) -> dict[str, float]:
        """Expected count of each piece over all segmentations of the words, a word counted ``weights`` times.

        Forward as in ``marginals``; backward, the share of segmentations that pass a place is handed to the places
        before it along the pieces that end there.
        """
        plain, lengths, spelled = self.plain, self.lengths, {}
        got: dict[str, float] = {}
        chars: dict[str, float] = {}
        alpha, share, before = [0.0], [0.0], ""

        def leave(down: int) -> None:
            for j in range(len(before), down, -1):
                whole, end, c = share.pop(), alpha[j], before[j - 1]
                part = whole * exp(alpha[j - 1] + spelled[c] - end)
                chars[c] = chars.get(c, 0.0) + part
                share[j - 1] += part
                for n in lengths.get(c, ()):
                    if n > j:
                        break
                    piece = before[j - n:j]
                    p = plain.get(piece)
                    if p is not None:
                        part = whole * exp(alpha[j - n] + p - end)
                        got[piece] = got.get(piece, 0.0) + part
                        share[j - n] += part

        weights = np.asarray(weights, np.float64)
        n_of = np.zeros(self.encoder.get_piece_size())
        for own, size, c in self._side_by_side(words):
            fore, spell, found = self._forward(c)
            passing = np.zeros(fore.shape)
            passing[np.arange(len(own)), size] = weights[own]
            alone, parts = np.zeros(c.shape), {n: np.zeros(x[0].shape) for n, x in found.items()}
            for j in range(c.shape[1], 0, -1):
                whole, end = passing[:, j], fore[:, j]
                alone[:, j - 1] = whole * np.exp(fore[:, j - 1] + spell[:, j - 1] - end)
                passing[:, j - 1] += alone[:, j - 1]
                for n, x in found.items():
                    if n <= j:
                        parts[n][:, j - n] = whole * np.exp(fore[:, j - n] + x[0][:, j - n] - end)
                        passing[:, j - n] += parts[n][:, j - n]
            for n, (_, row, place, at) in found.items():
                n_of += np.bincount(self.tables[n][3][at], weights=parts[n][row, place], minlength=len(n_of))
            kinds, which = np.unique(c, return_inverse=True)
            for x, n in zip(kinds.tolist(), np.bincount(which.ravel(), weights=alone.ravel()).tolist()):
                if n:
                    chars[chr(x)] = chars.get(chr(x), 0.0) + n
        for i in np.flatnonzero(n_of).tolist():
            got[self.names[i]] = float(n_of[i])
        for k, s, same in self._sorted_prefixes(words):
            leave(same)
            self._extend(alpha, s, same, spelled)
            share.extend([0.0] * (len(s) - same))
            share[-1] += float(weights[k])
            before = s
        leave(0)
        for c, n in chars.items():
            for b in c.encode("utf-8", "surrogatepass"):
                got[f"<0x{b:02X}>"] = got.get(f"<0x{b:02X}>", 0.0) + n
        return got


def _piece_counts(model: bytes):
    def run(batches):
        pieces, n = Pieces(model), 0.0
        for b in batches:
            n = n + pieces.counts([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], b.column(1).to_numpy())
        if not np.isscalar(n):
            ids = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], names=["id", "n"])
    return run


def _expected_counts(model: bytes, counts: dict, end: float):
    """mapInArrow (word, c) -> (id, n): expected piece counts under the scores of ``counts``."""
    def run(batches):
        pieces, n = Pieces(model), {}
        pieces.weigh(counts, end)
        for b in batches:
            for piece, x in pieces.expected([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], b.column(1).to_numpy()).items():
                n[piece] = n.get(piece, 0.0) + x
        ids = {name: i for i, name in pieces.names.items()}
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([ids[p] for p in n], pa.int64()), pa.array(list(n.values()), pa.float64())], names=["id", "n"])
    return run


def _piece_scores(words: DataFrame, model: bytes, end: float, passes: int) -> dict[int, float]:
    """Counts of the pieces in the training words: the tokenizer's own, then re-estimated ``passes`` times."""
    learnt = words.where("c > 0").select("word", "c")

    def summed(run):
        rows = learnt.mapInArrow(run, "id long, n double").groupBy("id").agg(F.sum("n").alias("n"))
        return {r.id: r.n for r in rows.collect()}  # the pieces of the vocabulary at most

    counts = summed(_piece_counts(model))
    for _ in range(passes):
        counts = summed(_expected_counts(model, counts, end))
    return counts


# arrays travel as their bytes, which Spark copies whole: hashes and scores of 8 bytes, counts of 4
_ROWS = "bucket int, kind int, rid long, doc_id long, held_out boolean, tokens long, hs binary, n binary, base binary, lp binary"
_NAMES = ["bucket", "kind", "rid", "doc_id", "held_out", "tokens", "hs", "n", "base", "lp"]


def _bucket(h, buckets: int):
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _packed(offsets, values):
    """The values cut at ``offsets``, as a binary column."""
    cuts = np.asarray(offsets, np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column, kind):
    """-> (all values of a binary column in a row, number of values in each of its rows)."""
    got = column.to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(x for x in got if x), kind), np.array([len(x) // width if x else 0 for x in got], np.int64)


def _vocabulary_rows(model: bytes, counts: dict, end: float, tokens: int, distinct: int, buckets: int):
    """mapInArrow (h, word, c) -> rows of kind 0: hashes, base scores (log10; sign +1 marks a known word in n) and lattice scores."""
    def run(batches):
        pieces = Pieces(model)
        pieces.weigh(counts, end)
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy().view(np.uint64)
            lp = np.array(pieces.marginals([w.decode("utf-8", "replace") for w in b.column(1).to_pylist()])) / LN10
            c = b.column(2).to_numpy()
            base = np.log10((c + 1) / (tokens + distinct + 1))
            order = np.argsort(h, kind="stable")
            own = _bucket(h[order], buckets)
            at = np.flatnonzero(np.diff(own, prepend=-1))
            offsets, m = np.append(at, len(h)), len(at)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[at]), pa.array(np.zeros(m, np.int32)), none, none, pa.nulls(m, pa.bool_()), none,
                 _packed(offsets, h[order].view(np.int64)), _packed(offsets, (c[order] > 0).astype(np.int32)),
                 _packed(offsets, base[order]), _packed(offsets, lp[order])], names=_NAMES)
    return run


def _text_rows(buckets: int, clash, bits: int):
    """mapInArrow (text, rid, doc_id, held_out) -> rows of kind 1: a text's distinct words and their counts, by bucket.

    Each text also has a row without words that carries its id.
    """
    def run(batches):
        hasher = Hasher(clash, bits)
        for b in batches:
            texts, rids = utf8(b.column(0)), b.column(1).to_numpy()
            sizes = np.zeros(len(texts), np.int64)
            for raw, offsets, own in _blocks(texts):
                words, start, place = placed_words(raw)
                if not words:
                    continue
                doc = own[np.searchsorted(offsets, start, side="right") - 1]
                sizes += np.bincount(doc, minlength=len(texts))
                # the words numbered in the order of their hashes: one sort of (text, word) brings a text's buckets together
                h = _hashes(words, hasher)
                order = np.argsort(h, kind="stable")
                rank = np.empty(len(h), np.int64)
                rank[order] = np.arange(len(h))
                pair, n = np.unique(doc * len(h) + rank[place], return_counts=True)
                h, doc, n = h[order][pair % len(h)], pair // len(h), n.astype(np.int32)
                own_bucket = _bucket(h, buckets)
                at = np.flatnonzero(np.append(True, (own_bucket[1:] != own_bucket[:-1]) | (doc[1:] != doc[:-1])))
                cuts, m = np.append(at, len(h)), len(at)
                none, empty = pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own_bucket[at]), pa.array(np.ones(m, np.int32)), pa.array(rids[doc[at]]), none, pa.nulls(m, pa.bool_()), none,
                     _packed(cuts, h.view(np.int64)), _packed(cuts, n), empty, empty], names=_NAMES)
            m = len(texts)
            if m:
                yield pa.RecordBatch.from_arrays(
                    [pa.array((rids % buckets).astype(np.int32)), pa.array(np.ones(m, np.int32)), pa.array(rids), b.column(2), b.column(3), pa.array(sizes),
                     *[pa.nulls(m, pa.binary())] * 4], names=_NAMES)
    return run


_PARTS = "rid long, doc_id long, held_out boolean, tokens long, known long, base double, lp double"


def _look_up(batches):
    """mapInArrow over rows sorted by (bucket, kind): the vocabulary of a bucket comes before its texts.

    Holds one bucket's vocabulary as arrays and one batch of texts.
    """
    held, now, fresh = [], None, True
    words = known = base = lp = None
    for b in batches:
        bucket, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        key = bucket.astype(np.int64) * 2 + kind
        cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        for i, j in zip(cuts[:-1], cuts[1:]):
            if bucket[i] != now:
                held, now, fresh = [], bucket[i], True
            part = b.slice(i, j - i)
            if not kind[i]:
                held.append([_unpacked(part.column(k), t)[0] for k, t in ((6, np.int64), (7, np.int32), (8, np.float64), (9, np.float64))])
                continue
            if fresh:
                words, known, base, lp = ([np.concatenate(x) for x in zip(*held)] if held else
                                          [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0)])
                order = np.argsort(words, kind="stable")
                words, known, base, lp = words[order], known[order], base[order], lp[order]
                held, fresh = [], False
            (h, size), (n, _) = _unpacked(part.column(6), np.int64), _unpacked(part.column(7), np.int32)
            own = np.repeat(np.arange(j - i), size)
            at = np.searchsorted(words, h)
            sums = [np.bincount(own, weights=x[at] * n, minlength=j - i).astype(np.float64) for x in (known, base, lp)]
            yield pa.RecordBatch.from_arrays(
                [part.column(2), part.column(3), part.column(4), part.column(5), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names=["rid", "doc_id", "held_out", "tokens", "known", "base", "lp"])


def lattice_scores(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY,
                   hash_bits: int = 64, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` marks documents that are scored but not learnt from (null counts as true).  Tokens are ASCII
    lower-cased words and one end.  ``score`` is the log10 probability of the words under the lattice, the
    end included; ``base_score`` that of smoothed word counts.  Null and empty texts are the end alone;
    repeated rows come back each; with nothing to learn from, all counts are 0 and pieces are
    alike; an empty table gives an empty result.  ``vocabulary`` is read on the driver and sent along.  Ids are whole
    numbers (cast to long).  ``passes``: forward-backward passes that re-estimate the pieces' scores.  ``hash_bits`` settles cost only: words that share a hash are found and hashed anew.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        model = f.read()
    d = docs.select(col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"),
                    col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    words, clash = _distinct_words(d, hash_bits)
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count(F.lit(1))).first()
    ends = d.where("not held_out").count()
    tokens, distinct = seen[0] + ends, seen[1] + (ends > 0)
    counts = _piece_scores(words, model, ends, passes)
    buckets = max(LEAST_BUCKETS, -(-seen[2] // BUCKET_WORDS))
    vocab = words.mapInArrow(_vocabulary_rows(model, counts, ends, tokens, distinct, buckets), _ROWS)
    texts = d.select("text", "rid", "doc_id", "held_out").mapInArrow(_text_rows(buckets, clash, hash_bits), _ROWS)
    met = vocab.union(texts).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    parts = met.mapInArrow(_look_up, _PARTS)
    scores = Pieces(model)
    scores.weigh(counts, ends)
    last = float(np.log10((ends + 1) / (tokens + distinct + 1)))
    return parts.groupBy("rid").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out")], F.sum("tokens").alias("tokens"), F.sum("known").alias("known"),
                                    F.sum("base").alias("base"), F.sum("lp").alias("lp")).select(
        "doc_id", "held_out", (F.col("tokens") + 1).alias("n_tokens"), (F.col("known") + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + last).alias("base_score"), (F.col("lp") + scores.end / LN10).alias("score"))
