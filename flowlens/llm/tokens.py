"""Token counts by prefix dynamic programming.

A text is cut before white space into pieces that the tokenizer treats independently of each other. With ``c`` the
count of a piece, the count of the text up to the end of piece j is ``C[j] = C[j-1] + c(piece j)``. Inside a piece the
count at every prefix comes from a second table: the encoding of a prefix ends in exactly one token that is a suffix
of the prefix and may follow the encoding of what precedes it, so ``n[i] = n[i - len(token)] + 1``. Both tables
together hold the exact count at every prefix of the text; how much of a text fits a budget is read off them.

Counts and ids of whole pieces come from the tokenizer library, once for each distinct piece in a task's bounded memo.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import as_batches, blocks, quiet_tokenizers

#: Distinct pieces that a task remembers; at the bound it begins anew.
MEMO = 800_000
_CUT = re.compile(r"(?<=\S)(?= )|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")

#: Fixed value: the pattern by which byte-level tokenizers cut a text before they merge.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def quick_pieces(text: str) -> list[str]:
    """Every space begins a piece and every line end is one: right where no two white characters meet."""
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")


def ragged(piece: str) -> bool:
    """True for a quick piece that shows that white characters met in its text."""
    body = piece[1:] if piece[:1] == " " else piece
    return not body or (piece != "\n" and (body[0].isspace() or body[-1].isspace()))


def pieces(text: str) -> list[str]:
    """Parts of ``text`` whose token sequences, joined, are that of the text.

    Between two non-white characters a single space begins a piece and a single line end is one. No token crosses
    such a place, as white space only ever begins a pre-token, and runs of white space stay whole.
    """
    parts = quick_pieces(text)
    return _CUT.split(text) if "\x01" in text or any(map(ragged, parts)) else parts


class _Ragged(Exception):
    """White characters met in a text: its quick pieces are not right."""


class _Quick(dict):
    """Ids of quick pieces, each found once by ``one``."""

    def __init__(self, one: Callable[[str], bytes]):
        super().__init__()
        self.one = one

    def __missing__(self, piece: str) -> bytes:
        if ragged(piece):
            raise _Ragged
        ids = self[piece] = self.one(piece)
        return ids


class Encoder:
    """Ids of whole texts, piece by piece; see :func:`encoder`."""

    def __init__(self, path: str, memo: int = MEMO):
        quiet_tokenizers()
        self.sentencepiece = path.endswith(".model")
        self.by_pieces = False
        if self.sentencepiece:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.bpe = self.library.model
            added = [t.content for t in self.library.get_added_tokens_decoder().values()]
            self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
            with open(path, encoding="utf-8") as f:
                kind = json.load(f)
            # Only this pre-tokenizer is known to cut where pieces() does; other files are encoded text by text.
            self.by_pieces = (kind.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not kind.get("normalizer")
        self.most = memo
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.quick = _Quick(self._one)

    def whole(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids, as the library gives them for whole texts."""
        if self.sentencepiece:
            for ids in self.library.encode(texts, num_threads=1):
                yield array("I", ids).tobytes()
        else:
            for e in self.library.encode_batch_fast(texts, add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _one(self, piece: str) -> bytes:
        if self.added.search(piece):
            return next(self.whole([piece]))
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():  # the common pieces: a word, or a word and one mark
            return self.words.get(piece) or self._ids_of(piece)
        if body[-1:] in (",", ".") and body[:-1].isalpha():
            return self._word(piece[:-1]) + self._word(piece[-1])
        return b"".join(map(self._word, PRE_TOKEN.findall(piece)))

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word) or self.quick.get(word) or self.memo.get(word)  # a piece that is a word is kept once
        if ids is None:
            ids = self.words[word] = self._ids_of(word)
        return ids

    def _ids_of(self, word: str) -> bytes:
        return array("I", [t.id for t in self.bpe.tokenize(shown(word))]).tobytes()

    def _bounded(self) -> None:
        if len(self.memo) + len(self.quick) > self.most:
            for known in (self.memo, self.quick, self.words):
                known.clear()

    def learn(self, new: Iterable[str]) -> None:
        """Remember these pieces, and only them once the memo is full."""
        self._bounded()
        for piece in new:
            self.memo[piece] = self._one(piece)

    def split(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of them known to ``memo`` afterwards."""
        if not self.by_pieces:
            self.memo = dict(zip(texts, self.whole(texts), strict=True))
            return [[t] for t in texts]
        split = [quick_pieces(t) for t in texts]
        found = set(chain.from_iterable(split))
        # Not a matter of the memo, which may know the same string as a piece of a careful cut.
        ragged_now = {p for p in found if ragged(p)}
        found -= ragged_now
        self.learn(found if len(self.memo) + len(self.quick) > self.most else found.difference(self.memo))
        known = self.memo
        for i, text in enumerate(texts):
            if "\x01" in text or not ragged_now.isdisjoint(split[i]):
                split[i] = _CUT.split(text) if text else []
                for p in split[i]:
                    if p not in known:
                        known[p] = self._one(p)
        return split

    def _careful(self, text: str) -> bytes:
        """The ids of a text in which white characters met."""
        parts = _CUT.split(text) if text else []
        for p in parts:
            if p not in self.memo:
                self.memo[p] = self._one(p)
        return b"".join(map(self.memo.__getitem__, parts))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A piece is looked up once for each time it stands there; no set of them is made."""
        if not self.by_pieces:
            return list(self.whole(texts))
        found, get = [], self.quick.__getitem__
        for text in texts:
            self._bounded()
            try:
                found.append(self._careful(text) if "\x01" in text else b"".join(map(get, quick_pieces(text))))
            except _Ragged:
                found.append(self._careful(text))
        return found


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """The encoder of this Python worker; tasks that follow each other share its memo, of ``memo`` pieces at most."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].most = memo
    return _ENCODERS[path]


_ENCODERS: dict[str, Encoder] = {}


def _stand_ins() -> dict[int, str]:
    """Byte-level vocabularies show each byte as a printable character: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


STAND_IN = _stand_ins()
BYTE_OF = {c: b for b, c in STAND_IN.items()}


def shown(word: str) -> str:
    if word.isascii() and word.isalpha():
        return word
    if word[0] == " " and word.isascii() and word[1:].isalpha():
        return "Ġ" + word[1:]
    return word.encode().decode("latin-1").translate(STAND_IN)


class PrefixTable:
    """The count at every prefix of one byte string under a list of ranked merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.model = Tokenizer.from_file(path)
        self.vocab = {bytes(BYTE_OF[c] for c in t) for t in model["vocab"] if all(c in BYTE_OF for c in t)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {tuple(bytes(BYTE_OF[c] for c in side) for side in m): i for i, m in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.may_follow: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: bytes, token: bytes) -> bool:
        key = (left, token)
        if key not in self.may_follow:
            if len(self.may_follow) > MEMO:
                self.may_follow.clear()
            self.may_follow[key] = self.merged(left + token) == ([left, token] if left else [token])
        return self.may_follow[key]

    def word(self, data: bytes) -> list[int]:
        """Counts at the prefixes 0 to len(data) of one pre-token."""
        counts, last = [0] * (len(data) + 1), [b""] * (len(data) + 1)
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - self.longest), i):
                if data[j:i] in self.vocab and self.follows(last[j], data[j:i]):
                    counts[i], last[i] = counts[j] + 1, data[j:i]
                    break
        return counts

    def piece(self, piece: str) -> list[int]:
        """Counts at the prefixes of a piece by code points; the first is of the empty prefix."""
        counts = [0]
        done = 0
        for token, (start, end) in self.model.pre_tokenizer.pre_tokenize_str(piece):
            table = self.word(bytes(BYTE_OF[c] for c in token))
            size = 0
            for k in range(start, end):
                size += len(piece[k].encode())
                inside = piece[start : k + 1]
                if inside[0] == "'" and 2 < end - start and k + 1 < end:  # an unfinished contraction is cut otherwise
                    counts.append(done + len(self.model.encode(inside, add_special_tokens=False).ids))
                else:
                    counts.append(done + table[size])
            done += table[-1]
        return counts




def longest_prefix(parts: list[str], totals: np.ndarray, budget: int, table: PrefixTable | None) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens, from the counts at the ends of its pieces.

    No later prefix can fit: at each piece's end the count has grown. Without a table the prefix ends with a piece.
    """
    k = int(np.searchsorted(totals, budget, side="right"))
    chars = sum(map(len, parts[:k]))
    if k == len(parts) or table is None:
        return chars
    left = budget - (int(totals[k - 1]) if k else 0)
    inside = table.piece(parts[k])
    return chars + max(i for i, n in enumerate(inside) if n <= left)


def token_counts(docs: DataFrame, path: str, budget: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For each row of ``docs``: the columns ``keep``, n_bytes, n_tokens, over_limit and fit_chars.

    ``path`` is a tokenizer file that every executor can read (.json or .model). ``fit_chars`` is the number of code
    points of the longest prefix of at most ``budget`` tokens, exact inside words for byte-level files. A null text is
    empty: 0 bytes and 0 tokens. Repeated rows are each answered; other columns of ``docs`` play no part.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    out = chosen.select(*[f"k{i}" for i in range(len(keep))], F.lit(0).cast("long").alias("n_bytes"),
                        F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("over_limit"),
                        F.lit(0).cast("long").alias("fit_chars")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = encoder(path), None
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_bytes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            n_tokens, fits = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for start, end in blocks(texts):
                split = known.split(texts[start:end])
                get = known.memo.__getitem__
                for row, parts in enumerate(split, start):
                    totals = np.cumsum(np.fromiter(map(len, map(get, parts)), np.int64, len(parts)) >> 2)
                    n_tokens[row] = totals[-1] if len(totals) else 0
                    if n_tokens[row] > budget and table is None and known.by_pieces:
                        table = PrefixTable(path)
                    fits[row] = longest_prefix(parts, totals, budget, table) if n_tokens[row] > budget else len(texts[row])
            carried = batch.drop_columns(["text"])
            columns = [*carried.columns, pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > budget), pa.array(fits)]
            names = [*carried.schema.names, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return chosen.mapInArrow(count, out).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
