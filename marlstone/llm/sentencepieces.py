"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text becomes symbols: each space is the word mark, a mark goes before the text, every other character is itself.
An agenda holds the adjacent pairs whose joined string is a piece, best score first, leftmost first.  When a pair
comes up it is joined, unless a draw keyed by the seed, doc_id, the word's place in the text and the draws before it
says to skip it: then it is out for good.  What is left over as single characters outside the vocabulary becomes byte
pieces.  With no dropout the result is the library's.

Pieces never reach over a word mark that follows another character or over a line break, so a text's pieces are
those of its words in a row; marks after a word's last letter or digit are a word of their own where no piece of the
vocabulary holds such a pair.  Every occurrence of a word draws for itself how many pairs are joined before the next
one is skipped, again and again: a geometric number, so that each pair is skipped with the dropout's chance, apart from
all others.  The agendas of a batch's short words are worked on in step, in arrays; a worker remembers the splits of
short words without a skip, up to a bound.

Decoding turns pieces back into bytes, byte pieces included, and is lossless for every text: a word mark that the
text itself holds is kept apart from spaces by its byte pieces.

Defined cases: null and empty texts have no pieces and decode to the empty text; very long texts, and words, are encoded
whole; a null doc_id draws as -1 does; repeated rows are encoded alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from operator import add

import numpy as np
from pyspark.sql import DataFrame

from marlstone.llm.common import map_batches, str_texts

DROPOUT, SEED = 0.1, 1234
#: Words a worker remembers without a skip, about 250 bytes each, and characters of the longest of these.
CACHE_WORDS, SHORT = 300_000, 40
#: The longest gap between skips that one draw gives, and a gap beyond any word.
GAPS, FAR = 1023, 1 << 62
NONE = np.iinfo(np.int32).max
MARK = "▁"
_MASK = (1 << 64) - 1
_STEP = np.uint64(0xD1342543DE82EF95)
_WORD = re.compile(r" *[^ \n]+| +|\n")
_LETTER = "[0-9A-Za-zÀ-ɏ]"
_APART = re.compile(rf" *[^ \n]*{_LETTER}|[^ \n]+| +|\n")


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


class Pieces:
    """The vocabulary of a model file: ranks of mergeable pieces, ids of bytes, bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.ids: dict[str, int] = {}
        score: dict[str, float] = {}
        self.bytes: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError("pieces of this model reach over words")
                self.ids[piece] = i
                score[piece] = model.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        order = {v: r for r, v in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {piece: order[v] for piece, v in score.items()}  # 0 for the best score; equal scores share a rank
        held = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        # what no piece holds is never merged over
        self.words = _WORD if any(re.match(f"{_LETTER}(?!{_LETTER})", pair) for pair in held) else _APART

    def split(self, word: str, left: int, gaps: Iterator[int]) -> list[str]:
        """Symbols of a word of any length after agenda processing; left pairs are joined before one is skipped, then a number
        from gaps before the next.  An agenda entry is one integer: the rank of the joined piece, then the place of the pair."""
        n = len(word)
        rank = self.rank.get
        text = list(word)
        shift = max(20, n.bit_length())
        agenda = [r << shift | i for i, r in enumerate(map(rank, map(add, word, word[1:]))) if r is not None]
        if not agenda:
            return text
        place = (1 << shift) - 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            x = pop(agenda)
            i, r = x & place, x >> shift
            first, j = text[i], after[i]
            if not first or j >= n:
                continue
            joined = first + text[j]
            if rank(joined) != r:
                continue  # one of its symbols has gone into another piece
            if not left:
                left = next(gaps)
                continue
            left -= 1
            text[i], text[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(joined + text[k])
                if r is not None:
                    push(agenda, r << shift | i)
            h = before[i]
            if h >= 0:
                r = rank(text[h] + joined)
                if r is not None:
                    push(agenda, r << shift | h)
        return list(filter(None, text))

    def word_ids(self, word: str, left: int, gaps: Iterator[int]) -> bytes:
        """word: spaces in front, then characters; a literal mark in it is split off, for it is no space."""
        ids: list[int] = []
        for nth, part in enumerate(word.split(MARK)):
            if nth:
                ids += [self.byte_id[b] for b in MARK.encode()]
            if part:
                if nth:  # the pairs of each part draw by themselves
                    left = next(gaps)
                for symbol in self.split(part.replace(" ", MARK), left, gaps):
                    i = self.ids.get(symbol)
                    if i is None:
                        ids += [self.byte_id[b] for b in symbol.encode()]
                    else:
                        ids.append(i)
        return array("I", ids).tobytes()


class Agendas:
    """The agendas of many short words at once: in each step every word's best pair comes up.

    Words are rows; a row's symbols are linked from left to right, and each holds the piece that it and its right
    neighbour make, or none.  The table of such pairs is hashed with open addressing."""

    def __init__(self, pieces: Pieces):
        known = pieces.ids
        self.rank = np.full(pieces.size + 1, NONE, np.int32)
        for piece, i in known.items():
            self.rank[i] = pieces.rank[piece]
        pairs = {(known[p[:k]] * pieces.size + known[p[k:]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known}
        keys, values = np.asarray(sorted(pairs), np.int64).reshape(-1, 2).T
        self.size, self.bits = pieces.size, max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, pieces.size, np.int32)
        slot = self._slot(keys)
        while len(keys):
            _, one = np.unique(slot, return_index=True)
            one = one[self.keys[slot[one]] < 0]
            self.keys[slot[one]], self.values[slot[one]] = keys[one], values[one]
            left = np.ones(len(keys), bool)
            left[one] = False
            keys, values, slot = keys[left], values[left], slot[left] + 1 & (1 << self.bits) - 1
        self.letters = np.full(0x110000, -1, np.int32)
        for piece, i in known.items():
            if len(piece) == 1 and piece != MARK:
                self.letters[ord(piece)] = i
        self.letters[ord(" ")] = known.get(MARK, -1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that symbols a and b make together; the number of pieces where they make none."""
        keys = a.astype(np.int64) * self.size + b
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(self.size))
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def run(self, words: list[str], left: np.ndarray, states: np.ndarray, draw) -> list[bytes | None]:
        """Ids of words of at most SHORT characters; None for those with characters that are no pieces.  left: pairs joined before
        each word's next skip; states and draw give the numbers after that."""
        out: list[bytes | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.letters[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        good = np.ones(len(words), bool)
        good[np.repeat(np.arange(len(words)), sizes)[symbols < 0]] = False
        order = np.argsort(sizes, kind="stable")
        order = order[good[order]]
        for rows in np.split(order, np.searchsorted(sizes[order], (5, 7, 9, 11, 14, 20), "right")):
            if len(rows):
                self._lockstep(rows, sizes[rows], starts[rows], symbols, left[rows], states[rows], draw, out)
        return out

    def _lockstep(self, rows, sizes, starts, symbols, left, states, draw, out) -> None:
        n, width = len(rows), int(sizes.max()) + 1  # the last column ends every row
        column = np.arange(width)
        inside = column < sizes[:, None]
        symbol = np.full((n, width), -1, np.int32)
        symbol[inside] = symbols[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        symbol = symbol.ravel()
        after = np.minimum(np.arange(n * width) + 1, n * width - 1)
        before = np.arange(n * width) - 1  # of a row's first symbol: the end of the row before it, which joins nothing
        before[0] = n * width - 1
        makes = self.joined(symbol, symbol[after])
        rank = self.rank[makes]
        ranks, base = rank.reshape(n, width), np.arange(n) * width
        row = np.arange(n)
        left, states = left.copy(), states.copy()
        while len(row):
            at = base[row] + ranks[row].argmin(axis=1)
            going = rank[at] != NONE
            row, at = row[going], at[going]
            skip = left[row] == 0
            left[row] -= 1
            if skip.any():
                r = row[skip]
                rank[at[skip]] = NONE
                states[r] += _STEP
                left[r] = draw(states[r])
                at = at[~skip]
            right = after[at]
            symbol[at] = makes[at]
            symbol[right] = -2
            rank[right] = NONE
            follows = after[right]
            after[at] = follows
            before[follows] = at
            precedes = before[at]
            pairs = np.concatenate([precedes, at])
            made = self.joined(symbol[pairs], symbol[np.concatenate([at, follows])])
            makes[pairs] = made
            rank[pairs] = self.rank[made]
        kept = symbol >= 0
        ids = symbol[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.reshape(n, width).sum(1)) * 4
        at = 0
        for i, end in zip(rows.tolist(), ends.tolist()):
            out[i] = ids[at:end]
            at = end


class Gaps:
    """The numbers of pairs joined before each skip of one occurrence."""

    def __init__(self, state: int, chances: list[int]):
        self.state, self.chances = state, chances

    def __iter__(self):
        return self

    def __next__(self) -> int:
        if not self.chances:
            return FAR
        gap, drawn = 0, GAPS
        while drawn == GAPS:  # the draw says only that the gap is not shorter
            self.state = self.state + int(_STEP) & _MASK
            drawn = GAPS - bisect_right(self.chances, _mix(self.state))
            gap += drawn
        return gap


class Encoder:
    """Ids of texts; words' splits without a skip are remembered."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        if not 0 <= dropout < 1:
            raise ValueError("dropout lies in [0, 1)")
        self.pieces = Pieces(path)
        self.agendas = Agendas(self.pieces)
        self.dropout, self.seed = dropout, seed
        #: By word: pairs joined, ids.
        self.plain: dict[str, tuple[int, bytes]] = {}
        #: A draw of 64 bits lies below as many of these as pairs are joined before the next skip.
        self.chances = [int((1 - dropout) ** m * 2**64) for m in range(GAPS, 0, -1)] if dropout else []
        self._table = np.asarray(self.chances, np.uint64)

    def _draws(self, states: np.ndarray) -> np.ndarray:
        """Pairs joined before a skip, by the states' draws."""
        if not self.dropout:
            return np.full(len(states), FAR)
        x = (states ^ (states >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return GAPS - np.searchsorted(self._table, x ^ (x >> np.uint64(31)), "right")

    def _whole(self, words: list[str]) -> dict[str, tuple[int, bytes]]:
        """Pairs joined and ids of words without a skip; those the cache has no room for too."""
        far = np.full(len(words), FAR)
        found = {}
        for word, ids in zip(words, self.agendas.run(words, far, np.zeros(len(words), np.uint64), self._draws)):
            found[word] = (FAR, b"") if ids is None else (len(word) - len(ids) // 4, ids)
        room = CACHE_WORDS - len(self.plain)
        self.plain.update(itertools.islice(found.items(), max(0, room)))
        return found

    def encode_many(self, texts: list[str], doc_ids: list[int]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        each = [self.pieces.words.findall(" " + t) if t else [] for t in texts]
        words = list(itertools.chain.from_iterable(each))
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        starts = np.fromiter((_mix((self.seed << 32 ^ i) & _MASK) for i in doc_ids), np.uint64, len(each))
        nth = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        states = np.repeat(starts, sizes) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        known = list(map(self.plain.get, words))
        new = {w for w, k in zip(words, known) if k is None and len(w) <= SHORT}
        if new:
            found = self._whole(sorted(new))
            known = [k or found.get(w) for k, w in zip(known, words)]
        out = [k and k[1] for k in known]
        pairs = np.fromiter((k[0] if k else FAR for k in known), np.int64, len(known))
        left = self._draws(states + _STEP)
        short = np.flatnonzero((left < pairs) & (pairs != FAR))
        if len(short):
            for i, ids in zip(short.tolist(), self.agendas.run([words[i] for i in short.tolist()], left[short], states[short] + _STEP, self._draws)):
                out[i] = ids
        for i in np.flatnonzero(pairs == FAR).tolist():  # long words, and characters that are no pieces
            gaps = Gaps(int(states[i]), self.chances)
            out[i] = self.pieces.word_ids(words[i], next(gaps), gaps)
        ends = np.cumsum(sizes).tolist()
        return [b"".join(out[a:b]) for a, b in zip([0, *ends], ends)]

    def encode_bytes(self, text: str, doc_id: int = 0) -> bytes:
        return self.encode_many([text], [doc_id])[0]

    def encode(self, text: str, doc_id: int = 0) -> list[int]:
        return np.frombuffer(self.encode_bytes(text, doc_id), "<u4").tolist()

    def decode(self, ids) -> str:
        """The text of ids, whatever their segmentation; bytes that are no UTF-8 become replacement characters."""
        out = b"".join(map(self.pieces.bytes.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def worker_encoder(path: str, dropout: float, seed: int) -> Encoder:
    """The encoder of a Python worker: the words it remembers serve all its tasks."""
    return Encoder(path, dropout, seed)


def drawn_ids(ids: list[int | None]) -> list[int]:
    return [-1 if i is None else i for i in ids]


def encode_documents(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, ids of each row: the real output."""

    def start():
        encoder = worker_encoder(path, dropout, seed)

        def each(batch):
            ids = batch.column("doc_id").to_pylist()
            yield {"doc_id": ids, "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode_many(str_texts(batch.column("text")), drawn_ids(ids))]}

        return each

    return map_batches(docs.select("doc_id", "text"), "doc_id long, ids array<int>", start)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows of encode_documents; null ids decode to the empty text."""

    def start():
        encoder = worker_encoder(path, 0.0, SEED)

        def each(batch):
            yield {"doc_id": batch.column("doc_id"), "text": [encoder.decode(ids or ()) for ids in batch.column("ids").to_pylist()]}

        return each

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, text string", start)


def round_trips(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_chars, lossless: each text encoded and decoded again."""

    def start():
        encoder = worker_encoder(path, dropout, seed)

        def each(batch):
            ids, texts = batch.column("doc_id").to_pylist(), str_texts(batch.column("text"))
            packed = encoder.encode_many(texts, drawn_ids(ids))
            decoded = [encoder.decode(memoryview(p).cast("I")) for p in packed]
            yield {
                "doc_id": ids,
                "n_pieces": [len(p) // 4 for p in packed],
                "ids_crc32": [zlib.crc32(p) for p in packed],
                "decoded_chars": [len(d) for d in decoded],
                "lossless": [d == t for d, t in zip(decoded, texts)],
            }

        return each

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, lossless boolean", start)
