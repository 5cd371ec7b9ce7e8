"""Byte-level BPE by dynamic programming over prefixes.

The merged form of a piece of text has, for every prefix, exactly one possible last token. It is
the only token that ends the prefix and can stand behind the last token of what is before it. So
an automaton with suffix links names the tokens that end at each byte, a test of token pairs picks
the one that fits, and following the last tokens back from the end emits the ids. No merge queue.

Two tokens can stand side by side if no merge crosses their border before the tokens are whole.
Only parts on the right edge of the left token and on the left edge of the right token touch, so
the test looks at those few pairs of parts and at the ranks that would consume them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptloom.llm.words import slices, text_bytes

#: Entries that a worker keeps of pieces it has encoded; emptied when full, results don't change.
PIECES_KEPT = 400_000
#: The same for pairs of tokens that it has tested.
PAIRS_KEPT = 1_000_000
#: Bytes of text that are encoded at once (one text at least): 8 MB lift a worker by 370 MB, 2 MB by 160.
ENCODED_BYTES = 2 << 20

_NEVER = 1 << 40
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSEEN = range(5)
# The characters that Unicode calls white space.
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Letters that make a piece with the apostrophe before them.
_CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return letters


def read_vocabulary(path: str) -> dict:
    """Tokens, merges and added tokens of a byte-level BPE file, as plain values to broadcast."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = [m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"]]
    return {
        "tokens": {raw(t): i for t, i in stored["model"]["vocab"].items()},
        "merges": [(raw(a), raw(b)) for a, b in merges],
        "added": {t["content"]: t["id"] for t in stored["added_tokens"]},
    }


class Encoder:
    def __init__(self, vocabulary: dict):
        tokens = vocabulary["tokens"]
        self.bytes_of = {i: t for t, i in tokens.items()}
        self.bytes_of |= {i: t.encode() for t, i in vocabulary["added"].items()}
        self.added = vocabulary["added"]
        self.ranks, self.parts, self.born = {}, {}, {}
        for rank, (a, b) in enumerate(vocabulary["merges"]):
            left, right, whole = tokens[a], tokens[b], tokens[a + b]
            self.ranks.setdefault((left, right), rank)
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = (left, right), rank
        self.automaton = ahocorasick.Automaton()
        for text, i in tokens.items():
            if len(text) == 1 or i in self.parts:
                self.automaton.add_word(text.decode("latin-1"), (len(text), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.pieces: dict[bytes, tuple[int, str, bytes]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that consumes it) down one edge of a token, itself first."""
        found, until = [(token, _NEVER)], 0
        while token in self.parts:
            until, token = self.born[token], self.parts[token][side]
            found.append((token, until))
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` can stand behind ``left``: no merge crosses the border between them."""
        for a, a_until in self.edge(left, 1):
            for b, b_until in self.edge(right, 0):
                rank = self.ranks.get((a, b), _NEVER)
                if rank < a_until and rank <= b_until and rank < _NEVER:  # of equal ranks the leftmost is first
                    return False
        return True

    def encode(self, piece: bytes) -> list[int]:
        last, size, done, fits = [0] * (len(piece) + 1), [0] * (len(piece) + 1), 0, self.fits
        for at, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            if at < done:  # the last token of this prefix is known, and it is the only one
                continue
            before = at + 1 - length
            if before:
                pair = last[before] << 20 | token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= PAIRS_KEPT:
                        fits.clear()
                    fit = fits[pair] = self.compatible(last[before], token)
                if not fit:
                    continue
            done = at + 1
            last[done], size[done] = token, length
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end -= size[end]
        return ids[::-1]

    def known(self, piece: bytes) -> tuple[int, str, bytes]:
        """(tokens, decimal ids joined by commas, bytes the ids decode to) of a piece."""
        found = self.pieces.get(piece)
        if found is None:
            ids = self.encode(piece)
            found = (len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids)))
            if len(self.pieces) >= PIECES_KEPT:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = found
        return found


_KINDS = np.full(0x110000, _UNSEEN, np.uint8)
_KINDS[list(_WHITE)] = _SPACE


def _kinds(points: np.ndarray) -> np.ndarray:
    kinds = _KINDS[points]
    if (kinds == _UNSEEN).any():
        for p in np.unique(points[kinds == _UNSEEN]).tolist():
            _KINDS[p] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(p))[0], _OTHER)
        kinds = _KINDS[points]
    return kinds


def piece_offsets(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split texts into the pieces that are encoded on their own.

    ``data``: UTF-8 of all texts, ``ends``: their offsets. Gives the byte offsets of the pieces
    and, for each text, the range of its pieces. A piece is a run of letters, of digits or of other
    signs, with one space before it if there is one; a contraction; or white space.
    """
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(ends), np.int64)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(byte_at, ends)] = True
    first = first[:n]
    kinds = _kinds(points)
    begins = first.copy()
    begins[1:] |= kinds[1:] != kinds[:-1]
    # The last white space before other signs is a piece, or belongs to what follows if it is " ".
    after = np.flatnonzero(begins & ~first & (kinds != _SPACE))
    after = after[kinds[after - 1] == _SPACE]
    begins[after - 1] = True
    joined = after[points[after - 1] == 0x20]
    begins[joined] = False
    for at in np.flatnonzero(begins & (points == 0x27)).tolist():
        if at + 1 >= n or first[at + 1] or kinds[at + 1] != _LETTER:
            continue
        follows = "".join(map(chr, points[at + 1 : at + 3].tolist()))
        if (at + 2 >= n) or first[at + 2]:
            follows = follows[:1]
        size = next((len(c) for c in _CONTRACTED if follows.startswith(c)), 0)
        if size:
            begins[at + 1] = False
            if at + 1 + size < n:
                begins[at + 1 + size] = True
    starts = byte_at[np.flatnonzero(begins)]
    return np.append(starts, byte_at[-1]), np.searchsorted(starts, ends)


def _parts(texts: pa.Array, added: dict[str, int]) -> tuple[pa.Array, np.ndarray, list[tuple[int, int]]]:
    """Texts cut at the added tokens; the text of each part; (part, id) of each added token."""
    hit = np.zeros(len(texts), bool)
    for token in added:
        hit |= pa.compute.match_substring(texts, token).to_numpy(zero_copy_only=False)
    if not hit.any():
        return texts, np.arange(len(texts)), []
    parts, owner, marks = [], [], []
    for row, (text, cut) in enumerate(zip(texts.to_pylist(), hit.tolist())):
        while cut:
            at, token = min((text.find(t), t) for t in added if t in text)
            marks.append((len(parts) + 1, added[token]))
            parts += [text[:at], ""]
            owner += [row, row]
            text = text[at + len(token) :]
            cut = any(t in text for t in added)
        parts.append(text)
        owner.append(row)
    return pa.array(parts, pa.string()), np.array(owner), marks


def encode_batch(encoder: Encoder, texts: pa.Array) -> list[tuple[int, str, bytes]]:
    """(tokens, ids joined by commas, decoded bytes) of each text; null counts as empty."""
    texts = texts.fill_null("").cast(pa.string())
    parts, owner, marks = _parts(texts, encoder.added)
    data, ends = text_bytes(parts)
    offsets, bounds = piece_offsets(data.tobytes(), ends)
    pieces = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())]
    ).dictionary_encode()
    seen = [encoder.known(p) for p in pieces.dictionary.to_pylist()]
    which = pieces.indices.to_numpy()
    sizes = np.fromiter((s[0] for s in seen), np.int64, len(seen))[which]
    totals = np.concatenate([[0], np.cumsum(sizes)])
    numbers, raw = [s[1] for s in seen], [s[2] for s in seen]
    special = dict(marks)
    found: list[tuple[int, str, bytes]] = []
    rows = np.searchsorted(owner, np.arange(len(texts) + 1))
    for row in range(len(texts)):
        count, text_ids, decoded = 0, [], []
        for part in range(rows[row], rows[row + 1]):
            lo, hi = bounds[part], bounds[part + 1]
            mine = which[lo:hi].tolist()
            text_ids += [numbers[i] for i in mine]
            decoded += [raw[i] for i in mine]
            count += int(totals[hi] - totals[lo])
            if part in special:
                text_ids.append(str(special[part]))
                decoded.append(encoder.bytes_of[special[part]])
                count += 1
        found.append((count, ",".join(text_ids), b"".join(decoded)))
    return found


def encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The same rows in batches of at most ``ENCODED_BYTES`` of text, each with its results."""
    for batch in slices(batches, most=ENCODED_BYTES):
        yield batch, encode_batch(encoder, batch["text"])


def decode(pieces: bytes) -> str:
    """Text of the bytes of tokens; what isn't UTF-8 becomes the replacement sign."""
    return pieces.decode("utf-8", errors="replace")


_ENCODERS: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, vocabulary_path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole ``text``, one result per row.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, the ids (array)
    and the decoded text. Null and empty texts give no token. Rows are independent: repeated rows
    give repeated results, an empty table gives an empty one, other columns are not read. The
    vocabulary (a file of fixed size) is broadcast once.
    """
    spark = docs.sparkSession
    stored = read_vocabulary(vocabulary_path)
    name = hashlib.sha256(repr((stored["merges"], stored["added"])).encode()).hexdigest()
    vocabulary = spark.sparkContext.broadcast(stored)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:  # a worker keeps one from task to task
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(vocabulary.value)
        encoder = _ENCODERS[name]
        for batch, done in encoded(encoder, batches):
            texts = [decode(d[2]) for d in done]
            columns = [
                batch["doc_id"],
                pa.array([d[0] for d in done], pa.int64()),
                pa.array([hashlib.sha256(d[1].encode()).hexdigest() for d in done]),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ids = [[int(x) for x in d[1].split(",") if x] for d in done]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
