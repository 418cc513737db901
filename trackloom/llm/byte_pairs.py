"""Byte-level byte-pair encoding as a transducer over bytes.

It rests on a property of merge lists: a series of tokens is an encoding if and only if each
neighbouring pair is, so the last token of every prefix is determined. A state holds the last token
and the count at the places where a token may yet begin; a transition finds the one token that ends
at the byte read and agrees with the last token before it. Two tokens agree if no merge joins what
stands at their border while both are made, which is read off the merges that make them. Many
pre-tokens step side by side, each byte of all at once; those of more than ``SHORT`` bytes, whose
states would take much memory, go through the library, all of a batch's in one call. Tokens are found by
rolling hashes and held against the bytes.
What pairs say is kept in a table of fixed size and read again when it has been replaced.
"""

from __future__ import annotations

import numpy as np

from trackloom.llm.common import Known, mix

#: Bytes of the longest pre-tokens that step side by side, and how many of them at once.
SHORT, SIDE_BY_SIDE = 64, 20_000
#: What bytes, and bytes that end a word, count for in hashes.
SYMBOLS = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base from the 0th to the ``n``-th, and of its inverse."""
    wide = np.ones((2, n + 1), np.uint64)
    wide[:, 1:] = np.array([[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
    return tuple(np.cumprod(wide, axis=1, dtype=np.uint64))


def byte_letters() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: a byte's own Latin-1 character where it
    can be printed, else the next one from U+0100 on."""
    plain = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return [chr(b) if plain[b] else chr(256 + sum(not p for p in plain[:b])) for b in range(256)]


class BytePairs:
    """The transducer over the bytes of pre-tokens: their tokens, many pre-tokens side by side."""

    def __init__(self, spec: dict, library):
        """``library``: the tokenizer of the same file, for long pre-tokens."""
        model, self.library = spec["model"], library
        letters, ending = byte_letters(), model.get("end_of_word_suffix") or ""
        made = {c: k for k, c in enumerate([*letters, *(c + ending for c in letters if ending)])}
        self.first_merged, self.ending, parts = len(made), bool(ending), []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if made.setdefault(a + b, self.first_merged + rank) != self.first_merged + rank:
                raise ValueError("two merges make the same token")
            parts.append((made[a], made[b]))
        self.ids = np.array([model["vocab"][t] for t in made], np.uint32)
        self.parts = np.array(parts, np.int64).reshape(-1, 2)
        names = self.parts[:, 0] << 32 | self.parts[:, 1]
        self.merge_order = np.argsort(names)
        self.merge_names = names[self.merge_order]
        hidden = {c: k for k, c in enumerate(letters)}
        tokens = [self._symbols([hidden[c] for c in t.removesuffix(ending)], bool(ending) and t.endswith(ending)) for t in made]
        self.sizes = np.array([len(t) for t in tokens])
        ends = np.cumsum(self.sizes)
        self.begins, self.symbols = ends - self.sizes, np.concatenate(tokens)
        place = np.arange(len(self.symbols)) - np.repeat(self.begins, self.sizes)
        hashes = mix(np.add.reduceat(SYMBOLS[self.symbols] * powers(int(self.sizes.max()))[0][place], self.begins))
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.buckets = np.searchsorted(self.hashes, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44))
        self.buckets[-1] = len(hashes)
        self.longest, self.agreeing = int(self.sizes.max()), Known()

    @staticmethod
    def _symbols(read, ends: bool) -> np.ndarray:
        """Bytes as numbers; the last one of a word is another one where words have an ending."""
        out = np.array(read, np.uint16)
        out[-1:] += 256 * ends
        return out

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of two tokens; a large number if there is none."""
        name = a << 32 | b
        at = np.minimum(np.searchsorted(self.merge_names, name), len(self.merge_names) - 1)
        return np.where(self.merge_names[at] == name, self.merge_order[at], 1 << 40)

    def _agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is the encoding of its bytes: no merge joins a part at the end of
        ``left`` and one at the start of ``right`` before either becomes part of a larger one. A part's
        own merge to the left goes first at equal rank, one to the right does not."""
        good, rows = np.ones(len(left), bool), np.arange(len(left))
        outer, until = left, np.full(len(left), 1 << 39)
        while len(rows):
            inner, then, here = right[rows], np.full(len(rows), 1 << 39), np.arange(len(rows))
            while len(here):
                rank = self._merge(outer[here], inner)
                good[rows[here[(rank < until[here]) & (rank <= then)]]] = False
                goes = inner >= self.first_merged
                here, then = here[goes], inner[goes] - self.first_merged
                inner = self.parts[then, 0]
            goes = (outer >= self.first_merged) & good[rows]
            rows, until = rows[goes], outer[goes] - self.first_merged
            outer = self.parts[until, 1]
        return good

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        names = mix((left << 32 | right).astype(np.uint64) + np.uint64(1))
        return self.agreeing.look_up(names, lambda at: self._agree(left[at], right[at]).astype(np.int32)) > 0

    def token(self, hashes: np.ndarray) -> np.ndarray:
        """The token of each hash, or -1."""
        bucket = (hashes >> np.uint64(44)).astype(np.intp)
        at, end = self.buckets[bucket], self.buckets[bucket + 1]
        found, rows = np.full(len(hashes), -1), np.flatnonzero(at < end)
        while len(rows):
            same = self.hashes[at[rows]] == hashes[rows]
            found[rows[same]] = self.by_hash[at[rows[same]]]
            rows = rows[~same]
            at[rows] += 1
            rows = rows[at[rows] < end[rows]]
        return found

    def count(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        return self.encode(texts, False)[0]

    def encode(self, texts: list[bytes], with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each pre-token, and the ids of all in a row."""
        sizes = np.array([len(t) for t in texts])
        counts, order, found = np.zeros(len(texts), np.int64), np.argsort(-sizes, kind="stable"), []
        long, rest = order[: int((sizes > SHORT).sum())], order[int((sizes > SHORT).sum()) :]
        whole = [np.array(e.ids, np.uint32) for e in self.library.encode_batch([texts[r].decode() for r in long.tolist()], add_special_tokens=False)] if len(long) else []
        counts[long] = [len(ids) for ids in whole]
        for k in range(0, len(rest), SIDE_BY_SIDE):
            rows = rest[k : k + SIDE_BY_SIDE]
            width = sizes[rows]
            symbols = np.frombuffer(b"".join(texts[r] for r in rows.tolist()), np.uint8).astype(np.uint16)
            symbols[np.cumsum(width) - 1] += 256 * self.ending
            last, count = self._side_by_side(symbols, width)
            counts[rows] = count[width, np.arange(len(rows))]
            if with_ids:
                found += self._back(last, count, width, rows)
        if not with_ids:
            return counts, np.zeros(0, np.uint32)
        before, ids = np.cumsum(counts) - counts, np.zeros(counts.sum(), np.uint32)
        for row, own in zip(long.tolist(), whole, strict=True):
            ids[before[row] : before[row] + len(own)] = own
        for rows, places, tokens in found:
            ids[before[rows] + places] = self.ids[tokens]
        return counts, ids

    def _back(self, last: np.ndarray, count: np.ndarray, width: np.ndarray, rows: np.ndarray):
        """From the last token of each pre-token to its first: rows, places and tokens."""
        at, end = np.arange(len(rows)), width
        while len(at):
            token = last[end, at]
            yield rows[at], count[end, at] - 1, token
            end = end - self.sizes[token]
            at, end = at[end > 0], end[end > 0]

    def _side_by_side(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token and the count after each symbol (rows) of each pre-token (columns), the longest first."""
        n, width = len(sizes), int(sizes[0])
        columns, places = np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        up, down = powers(width)
        sums = np.zeros((width + 1, n), np.uint64)
        sums[places + 1, columns] = SYMBOLS[symbols] * up[places]
        grid = np.zeros((width, n), np.uint16)
        grid[places, columns] = symbols
        sums = np.cumsum(sums, axis=0, dtype=np.uint64)
        last, counts = np.full((width + 1, n), -1), np.zeros((width + 1, n), np.int64)
        for end in range(1, width + 1):
            left = np.arange(np.searchsorted(-sizes, -end, "right"))
            for size in range(min(end, self.longest), 0, -1):
                start = end - size
                token = self.token(mix((sums[end, left] - sums[start, left]) * down[start]))
                at = np.flatnonzero(token >= 0)
                spelled = self.symbols[np.minimum(self.begins[token[at]][:, None] + np.arange(size), len(self.symbols) - 1)] if len(at) else None
                at = at[(self.sizes[token[at]] == size) & (grid[start:end, left[at]].T == spelled).all(axis=1)] if len(at) else at
                if start and len(at):
                    at = at[self.agree(last[start, left[at]], token[at])]
                if len(at):
                    last[end, left[at]], counts[end, left[at]] = token[at], counts[start, left[at]] + 1
                    left = np.delete(left, at)
                    if not len(left):
                        break
        return last, counts
