"""Byte-pair encoding by forced cuts.

A pair of neighbouring symbols that occurs inside no vocabulary token can never end up in
one token, so every place where such a pair stands is a certain cut. The fragments between
cuts merge independently of each other and their ids are concatenated. Spaces give further
certain cuts, before any vocabulary is looked at, because no pre-token reaches across them.

Texts are cut at spaces into chunks first. A chunk's ids depend on nothing outside it, so they
are kept in a bounded table and looked up when the chunk comes again: numpy hashes all
chunks of a block of texts at once, finds the distinct ones and gathers the ids. The table
holds chunks of up to 16 bytes as two numbers and their size, so a hit is the very chunk,
whatever the hash; longer chunks go by their bytes through a dictionary.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from millrace.llm._shingles import eights, mix, spans_of_eight

#: Chunks that the table of one coder holds, pre-tokens, and long chunks; when full each starts anew, so memory is bounded.
MAX_CHUNKS, MAX_PIECES, MAX_LONG = 2_000_000, 300_000, 100_000
#: Bytes of the longest chunk in the table, and of the longest that is remembered at all.
SHORT, REMEMBERED = 16, 256
#: Stand-in of byte 0, which stands between pieces here and in none.
_BORDER = "\u0100"
#: Characters of the texts of a block.
_AT_ONCE = 1 << 21
_U = np.uint64

_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
# What comes before the merges in the two kinds of files, with word ends and without.
_WORD_ENDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES | {"use_regex": False}]},
}
_NO_WORD_ENDS = {"normalizer": None, "pre_tokenizer": _BYTES | {"use_regex": True}}


def _checked(spec: dict) -> dict:
    """The file as it is, if its settings are those that the cuts and pieces here were made for; an error if not."""
    model = spec["model"]
    kind = _WORD_ENDS if model.get("end_of_word_suffix") else _NO_WORD_ENDS
    wrong = [k for k, v in kind.items() if spec.get(k) != v]
    wrong += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["type"] if model.get("type", "BPE") != "BPE" else []
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    wrong += [t["content"] for t in spec["added_tokens"] if any(t[f] for f in flags) or not t["content"].startswith("<|")]
    if wrong:
        raise ValueError(f"a tokenizer with other settings than this encoder's: {wrong}")
    return spec


class ForcedCuts:
    """The cuts of one vocabulary, and the models that merge the fragments between them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as file:
            spec = _checked(json.load(file))
        self.decodes = spec["decoder"] is None
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.suffix = suffix
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        bodies = [t[: -len(suffix)] if suffix and t.endswith(suffix) else t for t in vocab]
        self.inside = {a + b for t in bodies for a, b in zip(t, t[1:])}
        #: Merges the last fragment of a pre-token, which carries the end-of-word mark.
        self.last = self.library.model
        #: Merges any other fragment: the same merges without the mark.
        self.inner = BPE(vocab=vocab, merges=merges) if suffix else self.last
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token

    def fragments(self, piece: str) -> list[str]:
        """``piece``, a pre-token in the vocabulary's alphabet, cut wherever a cut is certain."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in inside:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def encode_piece(self, piece: str, into: list[int]) -> None:
        parts = self.fragments(piece)
        for part in parts[:-1]:
            into.extend([t.id for t in self.inner.tokenize(part)])
        into.extend([t.id for t in self.last.tokenize(parts[-1])])


class Encoder:
    """Whole texts to ids, as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, typecode: str = "<u4"):
        self.cuts = ForcedCuts(path)
        self.dtype = np.dtype(typecode)
        #: How the table holds ids: in two bytes where the vocabulary allows it.
        self.code = "H" if len(self.cuts.strings) <= 1 << 16 else "I"
        self.words = bool(self.cuts.suffix)
        # Fixed by the two vocabularies' own pre-tokenizers, for chunks of ASCII and the letters of
        # Latin-1 only; others go through the library's. The mark between chunks is a piece.
        self.plain_pieces = re.compile(
            r"\x00|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \n\x00a-zß-öø-ÿ0-9]+"
            if self.words
            else r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \n\x00A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[ \n]+(?![^ \n])|[ \n]+"
        )
        self.plain = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*\Z")
        self.alphabet = _byte_alphabet()
        self.may_follow = np.zeros((512, 512), dtype=bool)
        for pair in self.cuts.inside:
            if max(map(ord, pair)) < 512:
                self.may_follow[ord(pair[0]), ord(pair[1])] = True
        self.table = _Table(np.dtype(f"<{self.code}"))
        self.long: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that no pre-token leaves."""
        out: list[int] = []
        library = self.cuts.library
        for section in self.cuts.special_split.split(chunk) if "<|" in chunk else (chunk,):
            if section in self.cuts.special:
                out.append(self.cuts.special[section])
            elif section:
                section = library.normalizer.normalize_str(section) if library.normalizer else section
                for piece, _ in library.pre_tokenizer.pre_tokenize_str(section):
                    self.cuts.encode_piece(piece, out)
        return array(self.code, out).tobytes()

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of some distinct chunks."""
        plain, known = self.plain, self.pieces
        out: list[bytes] = [b""] * len(chunks)
        easy = []
        for i, c in enumerate(chunks):
            # White space at an end is told from that before a word by what follows; the mark would follow here.
            if "<|" in c or not plain.match(c) or c[-1] in " \n":
                out[i] = self.chunk(c)
            else:
                easy.append(i)
        if not easy:
            return out
        text = "\0".join([chunks[i] for i in easy])
        found = self.plain_pieces.findall(text.lower() if self.words else text)
        if len(known) > MAX_PIECES:
            known.clear()
        self._learn_pieces([p for p in set(found).difference(known) if p != "\0"])
        at, parts = 0, []
        for p in found:
            if p == "\0":
                out[easy[at]] = b"".join(parts)
                at, parts = at + 1, []
            else:
                parts.append(known[p])
        out[easy[at]] = b"".join(parts)
        return out

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Merges new pieces, each cut wherever a cut is certain."""
        if not pieces:
            return
        known, code, tokenize = self.pieces, self.code, self.cuts.last.tokenize
        symbols = self.alphabet[np.frombuffer("\0".join(pieces).encode("utf-8"), dtype=np.uint8)]
        border = symbols == ord(_BORDER)
        cut = ~self.may_follow[symbols[:-1], symbols[1:]] & ~border[:-1] & ~border[1:]
        ends = np.concatenate((np.flatnonzero(border), [len(symbols)]))
        several = set(np.searchsorted(ends, np.flatnonzero(cut), side="right").tolist())
        for i, (piece, form) in enumerate(zip(pieces, symbols.tobytes().decode("utf-16-le").split(_BORDER))):
            if i in several:
                out: list[int] = []
                self.cuts.encode_piece(form, out)
            else:
                out = [t.id for t in tokenize(form)]
            known[piece] = array(code, out).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers; a null text counts as empty."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < _AT_ONCE):
                size += len(texts[j] or "")
                j += 1
            out += self._encode_some(texts[i:j])
            i = j
        return out

    def _encode_some(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode("utf-8") for t in texts]
        blob = b"".join(raw)
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(blob, dtype=np.uint8)
        begin = chunk_starts(data, ends, self.words)
        if not len(begin):
            return [b""] * len(texts)
        size = np.diff(np.concatenate((begin, [len(data)])))
        at, n = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        words = eights(data)
        short = np.flatnonzero(size <= SHORT)
        if len(short):
            b, z = begin[short], size[short]
            head, tail = spans_of_eight(words, b, z, 0), spans_of_eight(words, b, z, 8)
            key = mix(mix(head ^ z.astype(_U)) + tail)
            one, each = _distinct(key, head, tail, z)
            rows = (key[one], head[one], tail[one], z[one].astype(np.uint8))
            at_one, n_one, new = self.table.find(*rows)
            if len(new):
                first, last = b[one[new]], b[one[new]] + z[one[new]]
                got = self.learn([blob[x:y].decode("utf-8") for x, y in zip(first.tolist(), last.tolist())])
                at_one[new], n_one[new] = self.table.add(tuple(r[new] for r in rows), got)
            at[short], n[short] = at_one[each], n_one[each]
        long = np.flatnonzero(size > SHORT)
        if len(long):
            spans = [blob[x : x + y] for x, y in zip(begin[long].tolist(), size[long].tolist())]
            at[long], n[long] = self._long(spans)
        ids = self.table.gather(at, n).astype(self.dtype, copy=False)
        flat = ids.tobytes()
        upto = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(begin, np.concatenate(([0], ends)), side="left")] * self.dtype.itemsize
        return [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def _long(self, spans: list[bytes]):
        """(place, count) of the ids of long chunks, which the table holds until the block is gathered."""
        if len(self.long) > MAX_LONG:
            self.long.clear()
        known, fresh = self.long, {}
        distinct = list(dict.fromkeys(spans))
        unknown = [c for c in distinct if c not in known]
        for chunk, got in zip(unknown, self.learn([c.decode("utf-8") for c in unknown])):
            (known if len(chunk) <= REMEMBERED else fresh)[chunk] = got
        at, n = self.table.place([known[c] if c in known else fresh[c] for c in distinct])
        where = {c: i for i, c in enumerate(distinct)}
        each = np.array([where[c] for c in spans])
        return at[each], n[each]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The library's ``decode(ids, skip_special_tokens=False)`` for a vocabulary without a decoder of its own."""
        if not self.cuts.decodes:
            raise ValueError("a tokenizer with a decoder of its own")
        strings = self.cuts.strings
        return " ".join(map(strings.__getitem__, np.frombuffer(ids, dtype=self.dtype).tolist()))


def _byte_alphabet() -> np.ndarray:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as it is, the others from 256 on, in order."""
    out = np.arange(256, dtype=np.uint16)
    others = [b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE)]
    out[others] = np.arange(256, 256 + len(others))
    return out


def chunk_starts(data: np.ndarray, ends: np.ndarray, any_space: bool) -> np.ndarray:
    """Where the chunks of texts begin that stand one after the other: at the texts' beginnings and at spaces.

    Unless ``any_space`` holds, only spaces behind something else than white space count; a
    space behind what might be Unicode white space doesn't, which makes a longer chunk.
    """
    cut = data == 32
    if not any_space:
        white = np.zeros(256, dtype=bool)
        white[[32, *range(9, 14), *range(28, 32)]] = True
        cut[1:] &= ~white[data[:-1]]
        cut[2:] &= (data[1:-1] < 128) | (data[:-2] != 0xC2)
        cut[3:] &= (data[2:-1] < 128) | (data[:-3] < 0xE1) | (data[:-3] > 0xE3)
    starts = np.concatenate(([0], ends[:-1]))
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


def _distinct(key: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like np.unique's index and inverse for the whole rows; ``key`` is a hash of them."""
    _, one, each = np.unique(key, return_index=True, return_inverse=True)
    if all((r[one[each]] == r).all() for r in rows):
        return one, each
    # Different rows of one hash: told apart by all their columns.
    order = np.lexsort((*rows, key))
    new = np.ones(len(key), dtype=bool)
    new[1:] = np.any([r[order][1:] != r[order][:-1] for r in (key, *rows)], axis=0)
    each = np.empty(len(key), np.int64)
    each[order] = np.cumsum(new) - 1
    return order[new], each


class _Table:
    """Ids of short chunks: a large table sorted by hash, and a small one of what is new, merged into it now and then.

    Rows are (hash, bytes 0 to 8, bytes 8 to 16, size, place, count), and a hit must agree in
    the bytes and the size. Of two chunks with one hash the later isn't found and is learned
    again each time.
    """

    RECENT = 100_000

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.ids, self.used = np.empty(1 << 16, dtype=self.dtype), 0
        self.loose = np.empty(0, dtype=self.dtype)
        self.levels = [self._level(), self._level()]

    def _level(self):
        return tuple(np.empty(0, t) for t in (_U, _U, _U, np.uint8, np.int64, np.int32))

    def find(self, key: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray):
        """(place, count) of the ids of each chunk, and which ones aren't there."""
        at, n, missing = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.ones(len(key), dtype=bool)
        for keys, heads, tails, sizes, places, counts in self.levels:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[i] == key) & (heads[i] == head) & (tails[i] == tail) & (sizes[i] == size)
                at[hit], n[hit] = places[i[hit]], counts[i[hit]]
                missing &= ~hit
        return at, n, np.flatnonzero(missing)

    def add(self, rows: tuple, got: list[bytes]):
        """Appends the ids of new chunks, by ascending hash; (place, count) of each."""
        flat = np.frombuffer(b"".join(got), dtype=self.dtype)
        n = np.array([len(g) for g in got], dtype=np.int64) // self.dtype.itemsize
        if sum(len(level[0]) for level in self.levels) > MAX_CHUNKS:
            self.levels = [self._level(), self._level()]  # places stay good for the block at hand
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.empty(max(len(flat), self.used // 2), dtype=self.dtype)))
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        big, small = self.levels
        small = self._merged(small, (*rows, at, n.astype(np.int32)))
        if len(small[0]) > self.RECENT:
            big, small = self._merged(big, small), self._level()
        self.levels = [big, small]
        return at, n

    def place(self, got: list[bytes]):
        """(place, count) of ids that are there for the block at hand alone; places below 0 tell them."""
        self.loose = np.frombuffer(b"".join(got), dtype=self.dtype)
        n = np.array([len(g) for g in got], dtype=np.int64) // self.dtype.itemsize
        return np.cumsum(n) - n - len(self.loose), n

    @staticmethod
    def _merged(a, b):
        order = np.argsort(np.concatenate((a[0], b[0])), kind="stable")
        return tuple(np.concatenate((x, y))[order] for x, y in zip(a, b))

    def gather(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids at the places, one after the other. A table begun anew drops what it no longer points to."""
        where = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        # A run of loose ids stays below 0 to its end, since they end at -1.
        loose = np.repeat(at < 0, n)
        out = self.ids[np.where(loose, 0, where)]
        out[loose] = self.loose[where[loose]]
        self.loose = self.loose[:0]
        if self.used > 8 * MAX_CHUNKS:
            self.clear()
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, typecode: str = "<u4") -> Encoder:
    """One coder for each vocabulary and Python worker."""
    if (path, typecode) not in _ENCODERS:
        _ENCODERS[path, typecode] = Encoder(path, typecode)
    return _ENCODERS[path, typecode]
