"""Find documents that hold passages of held-out items.

Method
------
1. Every item is cut into windows of ``FRACTION`` of its length (one of a few window sizes, so that all items
   share them), at every start.  A window's SimHash has 64 bits; features are its words (single characters for
   scripts without spaces), weighted by their rarity among the items, as whole numbers, so that sums are exact.
   Four bits (two, where weights are large) are counted in one word of 64 bits.
2. Documents are cut into windows of the same sizes at every sixth of a window, so a stretch of half an item always holds a whole one.  Multi-index Hamming blocks:
   the 64 bits fall into 4 blocks of 16; two fingerprints within ``RADIUS`` = 7 bits agree in one block up to
   one bit, so looking up each block and its 16 neighbours finds *all* pairs within the radius (pigeonhole).
3. Each candidate (document, item, alignment) is verified exactly: weighted word triples of the item that stand
   in the document on the same alignment, give or take a few words, must hold ``ANYWHERE`` of the item's weight,
   or ``LEAST`` of it and ``DENSE`` of the words of one stretch of half the item (one changed word in ten breaks some of its
   triples, and the half may have the lighter words).

The items are a fixed evaluation set, some ``BLOCK_CHARS`` characters in one block; larger sets are worked
off in several blocks, each sent to the executors as one broadcast variable of bounded size.  Words are weighted by all items, so
blocks change no result.  Documents are
never shuffled and never leave their partition: the work per document is linear in its length.

Defined results: null or empty texts match nothing; items under ``SHORTEST`` tokens are not looked for and are
left out (they have no window); repeated documents each count; a document that holds an item twice gives
one row; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.textkit import tokens

FRACTION, RADIUS, LEAST, ANYWHERE, DENSE, GAP = 0.42, 7, 0.36, 0.47, 0.75, 7
SIZES = (3, 4, 5, 6, 8, 10, 13, 16, 20, 25, 31, 39, 49, 61, 76, 95, 118, 148, 185, 231, 289, 361, 451, 564)
#: half of a shorter item is under three words
SHORTEST = 6
BLOCKS, BLOCK_BITS = 4, 16
WEIGHT_SCALE = 16
BLOCK_CHARS = 2_000_000
#: documents are worked on in groups of so many tokens, which bounds the memory of a task
GROUP_TOKENS = 30_000
#: small documents are fingerprinted in groups of so many tokens, which keeps their sums (136 bytes a token) small
SEARCH_TOKENS = 16_000
SCHEMA = "doc_id bigint, item_id bigint, item_share double, hamming int, doc_token int"

_FLIPS = np.array([0] + [1 << i for i in range(BLOCK_BITS)], dtype=np.int64)


class ItemIndex:
    """Fingerprints of all item windows with their block tables."""

    def __init__(self, items: list[tuple[int, str]], rarity: tuple[int, Counter] | None = None):
        """``rarity``: number of all items and of those that hold each word, if ``items`` are one block of several."""
        self.words = {i: w for i, text in items if len(w := tokens(text or "")) >= SHORTEST}
        n, seen = rarity or word_rarity(items)
        self.weight = {t: np.log((n + 1) / c) for t, c in seen.items()}
        self.other = np.log(n + 1) * 0.3
        hashed = sorted((xxhash.xxh64_intdigest(t), round(v * WEIGHT_SCALE)) for t, v in self.weight.items())
        self.keys = np.array([k for k, _ in hashed], dtype=np.uint64)
        self.weights = np.array([v for _, v in hashed], dtype=np.int32)
        self.triples: dict[int, dict[tuple, list[int]]] = {}
        sizes = {i: max((s for s in SIZES if s <= FRACTION * len(w)), default=min(SIZES)) for i, w in self.words.items()}
        # a lane of a 64-bit word holds the sum of any window, with one bit to spare
        heaviest = max([round(self.other * WEIGHT_SCALE), *self.weights.tolist()])
        self.lane = 16 if max(sizes.values(), default=0) * heaviest < 1 << 15 else 32
        self.shifts = np.arange(0, 64, 64 // self.lane, dtype=np.uint64)
        self.item_weights = {i: [self.weight[t] for t in w] for i, w in self.words.items()}
        windows = defaultdict(lambda: ([], [], []))
        for i, w in self.words.items():
            size = sizes[i]
            starts = np.arange(len(w) - size + 1)
            prints = self.fingerprints(self.sums(hash_tokens(w, TokenHashes())), size, starts)
            for place, values in zip(windows[size], (prints, np.full(len(starts), i, np.int64), starts)):
                place.append(values)
            triples = defaultdict(list)
            for k in range(len(w) - 2):
                triples[tuple(w[k : k + 3])].append(k)
            self.triples[i] = dict(triples)
        self.by_size, self.needles = {}, {}
        for size, parts in windows.items():
            prints, owner, start = (np.concatenate(p) for p in parts)
            tables = []
            for block in range(BLOCKS):
                part = ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
                near = (part[:, None] ^ _FLIPS[None, :]).ravel()
                order = np.argsort(near, kind="stable")
                first = np.searchsorted(near[order], np.arange(65537)).astype(np.int32)
                rows = (order // len(_FLIPS)).astype(np.int32)
                tables.append((first, rows, prints[rows]))
            self.by_size[size] = (prints, owner, start, tables)
            # a verified match covers a word triple, and so one of these tokens; documents without any are left out
            triples = (t for i in set(owner.tolist()) for t in self.triples[i])
            self.needles[size] = frozenset(x for t in triples for x in ([w for w in t if not w.isdigit()] or t))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Running sums of the weights of the set bits, in lanes of 64-bit words, and of all weights in the last row.

        They may wrap around; their differences over a window do not.
        """
        place = np.searchsorted(self.keys, hashes)
        place[place == len(self.keys)] = 0
        known = self.keys[place] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        weight = np.where(known, self.weights[place] if len(self.keys) else 0, round(self.other * WEIGHT_SCALE)).astype(np.uint64)
        lanes = 64 // self.lane
        spread = np.array([sum(1 << (self.lane * k) for k in range(lanes) if x >> k & 1) for x in range(1 << lanes)], dtype=np.uint64)
        out = np.zeros((64 // lanes + 1, len(hashes) + 1), dtype=np.uint64)
        low = np.uint64((1 << lanes) - 1)
        for row, shift in zip(out, self.shifts):
            np.multiply(np.take(spread, ((hashes >> shift) & low).view(np.int64)), weight, out=row[1:])
        out[-1, 1:] = weight
        return np.cumsum(out, axis=1, out=out)

    def fingerprints(self, sums: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
        """A bit is set if more than half of the window's weight has it."""
        lanes, top = 64 // self.lane, np.uint64(self.lane - 1)
        ones = np.uint64(sum(1 << (self.lane * k) for k in range(lanes)))
        window = np.take(sums, starts + size, axis=1)
        window -= np.take(sums, starts, axis=1)
        over = window[:-1]
        # the highest bit of a lane is set by what is more than half
        over += (np.uint64((1 << (self.lane - 1)) - 1) - (window[-1] >> np.uint64(1))) * ones
        over >>= top
        over &= ones
        packed = over.copy()
        for k in range(1, lanes):
            packed |= over >> np.uint64(k * (self.lane - 1))
        packed &= np.uint64((1 << lanes) - 1)
        packed <<= self.shifts[:, None]
        return np.bitwise_or.reduce(packed, axis=0)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item window, distance) of all pairs within the radius."""
        _, _, _, tables = self.by_size[size]
        left, right, distances = [], [], []
        for block, (first, rows, near) in enumerate(tables):
            part = ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            begin = np.take(first, part)
            count = np.take(first, part + 1) - begin
            ends = np.cumsum(count)
            if not len(ends) or not ends[-1]:
                continue
            entry = np.arange(ends[-1]) + np.repeat(begin - (ends - count), count)
            distance = np.bitwise_count(np.repeat(prints, count) ^ np.take(near, entry))
            at = np.flatnonzero(distance <= RADIUS)
            left.append(np.searchsorted(ends, at, side="right"))
            right.append(rows[entry[at]])
            distances.append(distance[at])
        if not left:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(left), np.concatenate(right).astype(np.int64), np.concatenate(distances).astype(np.int64)

    def verify(self, doc: list[str], item: int, shift: int) -> float:
        """Share of the item's weight in word triples that stand in the document on this alignment; 0 for little that is scattered."""
        words = self.words[item]
        n = len(words)
        slack = max(8, n // 6)
        covered, triples = set(), self.triples[item]
        begin = max(0, shift - slack)
        part = doc[begin : shift + n + slack + 2]
        for k, places in enumerate(map(triples.get, zip(part, part[1:], part[2:])), begin - shift):
            for p in places or ():
                if -slack <= k - p <= slack:
                    covered.update((p, p + 1, p + 2))
        weights = self.item_weights[item]
        if not any(weights):
            weights = [1.0] * n
        share = sum(weights[p] for p in covered) / sum(weights)
        return share if share >= ANYWHERE or share >= LEAST and _in_one_stretch(covered, n) else 0.0


def _in_one_stretch(covered: set[int], n: int) -> bool:
    """Whether ``covered`` fills ``DENSE`` of a stretch of half the ``n`` words, with no gap wider than ``GAP``."""
    places, begin = sorted(covered), 0
    for k, p in enumerate(places):
        if k and p - places[k - 1] > GAP + 1:
            begin = k
        # a changed word takes up to two words with it at either end
        if 2 * (p + 1 - places[begin]) >= n - 4 and k + 1 - begin >= DENSE * (p + 1 - places[begin]):
            return True
    return False


def word_rarity(items: Iterable[tuple[int, str]]) -> tuple[int, Counter]:
    """Number of the items that are looked for, and of those that hold each word."""
    n, counts = 0, Counter()
    for _, text in items:
        words = tokens(text or "")
        if len(words) >= SHORTEST:
            n += 1
            counts.update(set(words))
    return n, counts


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        self[token] = value = xxhash.xxh64_intdigest(token)
        return value


def hash_tokens(words: list[str], cache: TokenHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def search(index: ItemIndex, docs: list[tuple[int, list[str]]], cache: TokenHashes) -> list[tuple]:
    """Verified (doc_id, item_id, share, distance, token) of a group of documents."""
    lengths = np.array([len(w) for _, w in docs])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    sums = index.sums(hash_tokens([t for _, w in docs for t in w], cache))
    distinct = [set(w) for _, w in docs]
    out = []
    for size, (_, owner, start, _) in index.by_size.items():
        step = max(1, size // 6)
        needles = index.needles[size]
        fits = np.array([i for i in np.flatnonzero(lengths >= size).tolist() if not needles.isdisjoint(distinct[i])], dtype=np.int64)
        if not len(fits):
            continue
        counts = (lengths[fits] - size) // step + 1
        which = np.repeat(fits, counts)
        starts = begins[which] + step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        window, item_window, distance = index.candidates(index.fingerprints(sums, size, starts), size)
        if not len(window):
            continue
        doc, item = which[window], owner[item_window]
        shift = starts[window] - begins[doc] - start[item_window]
        order = np.lexsort((shift, item, doc))
        doc, item, shift = doc[order], item[order], shift[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        least = np.minimum.reduceat(distance[order], first)
        for at, (i, j, nearest) in zip(np.split(shift, first[1:]), zip(doc[first].tolist(), item[first].tolist(), least.tolist())):
            done, best = None, (0.0, 0)
            for k in at.tolist():
                if done is not None and k - done <= 2:
                    continue
                done = k
                best = max(best, (index.verify(docs[i][1], j, k), -k))
            out.append((docs[i][0], j, best[0], nearest, max(0, -best[1])))
    return out


def leaks(df: DataFrame, key: Column, text: Column, items: DataFrame, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents with the items that leaked into them, the share of the item found and where."""
    spark = df.sparkSession
    blocks, block, size = [], [], 0
    for row in items.select(F.col(item_key).cast("bigint"), item_text).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_CHARS:
            blocks, block, size = [*blocks, block], [], 0
    blocks.append(block)
    rarity = word_rarity(x for b in blocks for x in b)
    docs = df.select(key.cast("bigint").alias("doc_id"), text.alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    parts = [docs.mapInPandas(_searcher(spark.sparkContext.broadcast(ItemIndex(b, rarity))), SCHEMA) for b in blocks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("item_share") >= LEAST)


def _pieces(words: list[str], overlap: int) -> list[list[str]]:
    """Parts of a very long document; every stretch of ``overlap`` tokens lies whole in one of them."""
    if len(words) <= GROUP_TOKENS + overlap:
        return [words]
    return [words[i : i + GROUP_TOKENS + overlap] for i in range(0, len(words) - overlap, GROUP_TOKENS)]


def _searcher(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, cache = shared.value, TokenHashes()
        overlap = 2 * max((len(w) for w in index.words.values()), default=0)
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            # of the parts of a document the best match with an item counts
            best: dict[tuple[int, int], tuple] = {}
            group, origin, size = [], [], 0

            def finish() -> None:
                for part, item, share, distance, token in search(index, group, cache):
                    row, doc_id, offset = origin[part]
                    if (row, item) not in best or best[row, item][2] < share:
                        best[row, item] = (doc_id, item, share, distance, token + offset)

            for row, (doc_id, content) in enumerate(zip(batch["doc_id"], batch["text"])):
                words = tokens(content)
                if len(words) < SHORTEST:
                    continue
                for n, piece in enumerate(_pieces(words, overlap)):
                    group.append((len(group), piece))
                    origin.append((row, doc_id, n * GROUP_TOKENS))
                    size += len(piece)
                    if size >= SEARCH_TOKENS:
                        finish()
                        group, origin, size = [], [], 0
                        if len(cache) > 200_000:
                            cache.clear()
            if group:
                finish()
            yield pd.DataFrame(list(best.values()), columns=columns)

    return run
