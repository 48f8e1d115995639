"""Exact batch encoding with a public tokenizer of the tokenizers library, each distinct piece of text encoded once.

Texts are cut at single spaces and newlines, where both tokenizers used here part tokens anyway. The distinct pieces of a batch that are Latin letters
with ASCII signs behind (no apostrophe) are cut into word and signs in one go, and the distinct words looked up in a bounded cache; only misses reach the
tokenizer, straight at its BPE model (pre-tokenizing and normalizing change nothing in them but the case). All other pieces go through the whole tokenizer. Texts in which the cut isn't known to be
safe (spaces beside other white space, NULs, strings of special tokens) are encoded whole. Tests hold the result against Tokenizer.encode.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids of up to twice this many distinct words are held, and of an eighth as many other pieces.
CACHE_PIECES = 300_000
BATCH_CHARS = 3_000_000
END_ID = 1
#: Stands for a newline and no space before a piece; texts that hold a NUL are encoded whole.
NEWLINE = "\0n"
#: Letters that the word tokenizer only lower-cases; I with a dot above and its like aren't among them.
_LETTERS, _SIGNS = r"[A-Za-zÀ-ÖØ-öø-ÿ]*", r"[!-&(-/:-@\[-`{-~]*"
_SIMPLE = re.compile(f"({_LETTERS})({_SIGNS})")
#: The same for a column of pieces, perhaps with a newline before.
_PARTS = rf"^(?P<line>(?:\x00n)?)(?P<word>{_LETTERS})(?P<sign>{_SIGNS})$"
#: Stands before a word that follows no space.
BARE = "\0"


def _byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where printable, else the next code point from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, rest = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(rest))
        rest += b not in plain
    return out


class Recent(dict):
    """The ids of up to 2 * limit keys. When limit new ones have come, those not used since the last such time go."""

    def __init__(self, limit: int):
        self.limit, self.older = limit, {}

    def trim(self) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()


def _gather(blob: np.ndarray, lens: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The stretches of blob by index, end to end. Stretch i is lens[i] long and follows the one before it."""
    took = lens[index]
    at = (np.cumsum(lens) - lens)[index] - (np.cumsum(took) - took)
    place = np.repeat(at.astype(np.int32), took)
    place += np.arange(len(place), dtype=np.int32)
    return blob[place]


class Encoder:
    """encode(texts) gives the ids of every text as one array, and how many each text has."""

    def __init__(self, path: str, spaced: bool, plain_specials: bool = False, pieces: int = CACHE_PIECES):
        """spaced: pieces but the first carry the space before them (byte-level); else white space is dropped and letters lower-cased.

        A special token's string in a text becomes that token, as the library has it, or with plain_specials is text as any other."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.spaced = self.tokenizer.model, spaced
        self.model._resize_cache(0)  # the cache here takes its place
        self.bytes = _byte_chars()
        self.space = self.bytes[0x20] if spaced else ""
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.newline = self._whole(["\n"])[0]
        self.cache, self.words = Recent(max(1, pieces // 8)), Recent(pieces)
        self.code = "H" if self.kind is np.uint16 else "I"

    def _bpe(self, key: str) -> bytes:
        """Ids of a word or of signs with the space before it, or without one where BARE stands before."""
        bare = key[:1] == BARE
        word = key[bare:]
        space = "" if bare else self.space
        mapped = word if word.isascii() else "".join([self.bytes[b] for b in word.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(space + mapped)]).tobytes() if word else b""

    def _words(self, keys: list[str]) -> list[bytes]:
        words = self.words
        words.trim()
        older = words.older.get
        out = list(map(words.get, keys))
        for i, ids in enumerate(out):
            if ids is None:
                k = keys[i]
                ids = older(k)
                words[k] = out[i] = self._bpe(k) if ids is None else ids
        return out

    def _simple(self, word: str, sign: str) -> bytes:
        """Ids of a text's first piece."""
        return b"".join(self._words([BARE + (x if self.spaced else x.lower()) for x in (word, sign) if x]))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _hard(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces that aren't letters and signs; None where the cut isn't known to be safe."""
        cache, lead = self.cache, " " if self.spaced else ""
        cache.trim()
        out: list[bytes | None] = list(map(cache.get, pieces))
        new = []
        for i, p in enumerate(pieces):
            if out[i] is None and not (p[:2] == NEWLINE or self.spaced and (not p or p[0].isspace() or p[-1].isspace())):
                if (ids := cache.older.get(p)) is not None:
                    cache[p] = out[i] = ids
                else:
                    new.append(i)
        for i, ids in zip(new, self._whole([lead + pieces[i] for i in new]), strict=True):
            cache[pieces[i]] = out[i] = ids
        return out

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all pieces with the space before them, end to end; how many each has; and for which the cut isn't known to be safe."""
        parts = pc.extract_regex(pieces, _PARTS)
        none, mark = pa.scalar("", pieces.type), pa.scalar(BARE, pieces.type)
        line, word, sign = (pc.fill_null(pc.struct_field(parts, n), none) for n in ("line", "word", "sign"))
        simple = parts.is_valid()
        if self.spaced:  # nothing between two spaces, or behind a newline
            simple = pc.and_(simple, pc.or_(pc.not_equal(word, none), pc.not_equal(sign, none)))
        else:
            word = pc.utf8_lower(word)
        alone = pc.equal(word, none)  # signs without a word take the space
        word, sign = pc.if_else(alone, sign, word), pc.if_else(alone, none, sign)
        bare = pc.if_else(pc.equal(line, none), none, mark)
        words = pc.binary_join_element_wise(bare, word, none).dictionary_encode()
        signs = pc.binary_join_element_wise(mark, sign, none).dictionary_encode()
        hard = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        rest = self._hard(pieces.take(pa.array(hard)).to_pylist())
        first = self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        atoms = [b"", self.newline, *first, *self._words(signs.dictionary.to_numpy(zero_copy_only=False).tolist()), *(x or b"" for x in rest)]
        table = np.zeros((len(pieces), 3), dtype=np.int64)
        table[:, 0] = pc.not_equal(line, none).to_numpy(zero_copy_only=False)
        table[:, 1] = words.indices.to_numpy() + 2
        table[:, 2] = signs.indices.to_numpy() + (2 + len(first))
        table[hard] = 0
        table[hard, 1] = len(atoms) - len(rest) + np.arange(len(rest))
        bad = np.zeros(len(pieces), dtype=bool)
        bad[hard] = [x is None for x in rest]
        blob, lens = self._joined(atoms)
        flat = table.ravel()
        return _gather(blob, lens, flat), lens[table].sum(axis=1), bad

    def _joined(self, atoms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, atoms), dtype=np.int64, count=len(atoms)) // np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(atoms), dtype=self.kind), lens

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text. A text may have none."""
        odd = np.array(["\0" in t or any(x in t for x in self.specials) for t in texts], dtype=bool)
        marked = ["" if o else t.replace("\n", " " + NEWLINE if self.spaced else " ") for t, o in zip(texts, odd, strict=True)]
        split = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        starts = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        blob, lens, bad = self._pieces(coded.dictionary)
        if self.spaced:  # first pieces have no space before them; they follow the others in the table
            firsts = [t.partition(" ")[0] for t in marked]
            index[starts[:-1]] = len(lens) + np.arange(len(texts))
            kinds = [_SIMPLE.fullmatch(p) for p in firsts]
            whole = iter(self._whole([p for p, m in zip(firsts, kinds, strict=True) if m is None]))
            bad_first = [bool(p) and p[-1].isspace() or not p and bool(t) for p, t in zip(firsts, marked, strict=True)]
            more, more_lens = self._joined([self._simple(m[1], m[2]) if m else next(whole) for m in kinds])
            blob, lens, bad = np.concatenate([blob, more]), np.concatenate([lens, more_lens]), np.concatenate([bad, np.array(bad_first, dtype=bool)])
        ends = np.concatenate(([0], np.cumsum(lens[index])))
        counts = ends[starts[1:]] - ends[starts[:-1]]
        ids = _gather(blob, lens, index)
        unsafe = odd
        if bad.any():
            hits = np.flatnonzero(bad[index])
            unsafe[np.searchsorted(starts, hits, side="right") - 1] = True
        if not unsafe.any():
            return ids, counts
        cuts = np.concatenate(([0], np.cumsum(counts)))
        redo = iter(self._whole([t for t, u in zip(texts, unsafe, strict=True) if u]))
        each = [np.frombuffer(next(redo), dtype=self.kind) if u else ids[cuts[i] : cuts[i + 1]] for i, u in enumerate(unsafe)]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)

    def documents(self, texts: list[str | None]):
        """Each text's ids with the end id appended, in order; texts are encoded in batches of about BATCH_CHARS."""
        group: list[str] = []
        held = 0
        for t in texts:
            group.append(t or "")
            held += len(group[-1])
            if held >= BATCH_CHARS:
                yield from self._documents(group)
                group, held = [], 0
        if group:
            yield from self._documents(group)

    def _documents(self, group: list[str]):
        ids, counts = self.encode(group)
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            out = np.empty(b - a + 1, dtype=self.kind)
            out[:-1] = ids[a:b]
            out[-1] = END_ID
            yield out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(name: str, spaced: bool, plain_specials: bool = False, pieces: int = CACHE_PIECES) -> Encoder:
    """One for each Python worker; name is a file of the public tokenizers, or a path."""
    key = (name, spaced, plain_specials, pieces)
    if key not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[key] = Encoder(name if os.path.isabs(name) else public_tokenizers.path(name), spaced, plain_specials, pieces)
    return _ENCODERS[key]
