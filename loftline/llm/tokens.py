"""Token ids of whole texts by the ``tokenizers`` library, a block at a time.

A text is cut where the tokenizer's own pattern always begins a token, such as
before the space ahead of a word, so pieces can be encoded apart and a piece
that occurs often is encoded once.  Pieces of
letters alone need no further splitting; they skip the pattern and go straight
to the merges.  Every other piece takes the tokenizer's own path.  The strings
of added tokens, such as ``<|endoftext|>``, are kept whole, and what lies between
them is cut as texts of its own, as the library does.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from loftline.llm.kernels import ragged, span_hashes

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_JOIN = 1000
_loaded: dict[tuple, tuple] = {}


def _byte_chars() -> str:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    keep = set(shown)
    return "".join(chr(b) if b in keep else chr(next(spare)) for b in range(256))


_BYTE_CHARS = _byte_chars()
_NEWLINE = _BYTE_CHARS[10]


def load(name: str, special: bool = True) -> tuple:
    """The tokenizer, a copy that splits only at the stand-in of a newline, that one's id, and a pattern of the added tokens.

    Without ``special``, the strings of added tokens are plain text.
    """
    if (name, special) not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        path = name if os.path.sep in name else public_tokenizers.path(name)
        plain, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        bare.pre_tokenizer = pre_tokenizers.Split(_NEWLINE, "isolated")
        mark = bare.token_to_id(_NEWLINE)
        plain.encode_special_tokens = bare.encode_special_tokens = not special
        added = sorted((a.content.encode() for a in plain.get_added_tokens_decoder().values()), key=len, reverse=True) if special else []
        _loaded[name, special] = plain, bare, mark, re.compile(b"|".join(map(re.escape, added))) if added else None
    return _loaded[name, special]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of single bytes, and of continuation bytes after a lead byte C3 to C9."""
    one = np.full(256, _OTHER, np.uint8)
    one[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
    one[0x30:0x3A] = _DIGIT
    one[[b for b in range(0x21, 0x7F) if one[b] == _OTHER and b != 0x27]] = _MARK
    one[0x27], one[0x20], one[0x09:0x0E] = _QUOTE, _BLANK, _BREAK
    return one, np.array([_OTHER if k in (0x97, 0xB7) else _LETTER for k in range(256)], np.uint8)


_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _BLANK, _BREAK = range(7)
_ONE, _AFTER_C3 = _classes()
#: Whether a token surely begins between characters of two classes.
_CUT = np.zeros((7, 7), bool)
for _a in (_LETTER, _DIGIT, _MARK):
    for _b in (_LETTER, _DIGIT, _MARK):
        _CUT[_a, _b] = _a != _b
_CUT[[_LETTER, _DIGIT], _QUOTE] = True
for _a in (_LETTER, _DIGIT, _MARK, _QUOTE):
    _CUT[_a, [_BLANK, _BREAK]] = True


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces begin: each text, and each place where a token surely begins.

    Characters other than ASCII and the letters up to U+024F are never cut at.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = _ONE[buf]
    lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC9))
    lead = lead[lead + 1 < n]
    kind[lead] = kind[lead + 1] = np.where(buf[lead] == 0xC3, _AFTER_C3[buf[lead + 1]], _LETTER)
    cut = np.zeros(n, bool)
    cut[1:] = _CUT.ravel()[kind[:-1] * np.uint8(7) + kind[1:]]
    # A lone line break is one token; a longer run of white space may be split.
    inked = (kind >= _LETTER) & (kind <= _QUOTE)
    cut[2:] |= inked[:-2] & (kind[1:-1] == _BREAK) & inked[2:]
    # A blank joins the inked character after it, and is cut off from white space before it.
    cut[1:-1] |= (kind[1:-1] == _BLANK) & (kind[:-2] >= _BLANK) & inked[2:]
    first = offs[:-1][offs[:-1] < offs[1:]]
    last = first[1:] - 1
    # The rule for blanks must not look into the next text.
    cut[last[(kind[last] == _BLANK) & (kind[np.maximum(last - 1, 0)] >= _BLANK)]] = False
    cut[first] = True
    return np.flatnonzero(cut)


def _encode_pieces(pieces: list[str], name: str, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each piece, end to end; each one's first place and count."""
    plain, bare, mark, _ = load(name, special)
    quick = [k for k, p in enumerate(pieces) if _LETTERS(p)]
    rest = sorted(set(range(len(pieces))).difference(quick))
    parts, owners = [], []
    if quick:
        joined = ["\n".join([pieces[k] for k in quick[i : i + _JOIN]]).encode().decode("latin-1").translate(_BYTE_CHARS) for i in range(0, len(quick), _JOIN)]
        owner = 0
        for i in range(0, len(joined), 64):
            for e in bare.encode_batch_fast(joined[i : i + 64], add_special_tokens=False):
                ids = np.array(e.ids, np.uint32)
                stop = ids == mark
                parts.append(ids[~stop])
                owners.append((owner + np.cumsum(stop))[~stop])
                owner += int(stop.sum()) + 1
    for i in range(0, len(rest), 4096):
        some = [e.ids for e in plain.encode_batch_fast([pieces[k] for k in rest[i : i + 4096]], add_special_tokens=False)]
        parts.append(np.fromiter((x for ids in some for x in ids), np.uint32))
        owners.append(len(quick) + i + np.repeat(np.arange(len(some)), [len(ids) for ids in some]))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    counts = np.bincount(np.concatenate(owners), minlength=len(pieces)) if owners else np.zeros(0, np.int64)
    firsts = np.cumsum(counts) - counts
    order = np.empty(len(pieces), np.int64)
    order[np.array([*quick, *rest], np.int64)] = np.arange(len(pieces))
    return ids, np.stack([firsts[order], counts[order]])


class _Seen:
    """Ids of up to ``limit`` pieces that this worker met before, by hash."""

    LIMIT = 1 << 20
    by_name: dict[tuple, _Seen] = {}

    def __init__(self, limit: int = LIMIT) -> None:
        self.limit = limit
        self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.at = self.count = np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        where = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return where, self.hashes[where] == hashes

    def add(self, hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > self.limit:
            return
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.at = np.concatenate([self.at, at + len(self.ids)])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.hashes, self.ids = every[order], np.concatenate([self.ids, ids])


def added_tokens(raw: memoryview, offs: np.ndarray, pattern: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the strings of added tokens; none reaches over two texts."""
    found, at = [], 0
    while pattern and (m := pattern.search(raw, at)):
        s, e = m.span()
        whole = e <= offs[np.searchsorted(offs, s, "right")]
        if whole:
            found.append((s, e))
        at = e if whole else s + 1
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def pieces_encoded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seen: _Seen, encode: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and where in them and how many the different pieces have; and each piece's number among those.

    ``encode`` takes strings that ``seen`` doesn't hold.
    """
    raw = memoryview(buf.tobytes() if not buf.flags.c_contiguous else buf)
    hashes, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    where, known = seen.find(hashes)
    new = first[~known]
    pieces = [str(raw[s:e], "utf-8") for s, e in zip(starts[new].tolist(), ends[new].tolist())]
    ids, (new_at, new_count) = encode(pieces)
    at, count = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    at[~known], count[~known] = new_at, new_count
    at[known], count[known] = seen.at[where[known]] + len(ids), seen.count[where[known]]
    every = np.concatenate([ids, seen.ids])
    seen.add(hashes[~known], ids, new_at, new_count)
    return every, at, count, which


def encode_block(buf: np.ndarray, offs: np.ndarray, end_id: int, name: str = DEFAULT_TOKENIZER, special: bool = True, remember: int = _Seen.LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each followed by ``end_id``, and each text's offset."""
    raw = memoryview(buf.tobytes() if not buf.flags.c_contiguous else buf)
    added, past = added_tokens(raw, offs, load(name, special)[3])
    if len(added):
        starts = piece_starts(buf, np.unique(np.concatenate([offs, added, past])))
        inside = np.searchsorted(added, starts, "left") - 1
        starts = starts[(inside < 0) | (starts >= past[inside])]
    else:
        starts = piece_starts(buf, offs)
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    seen = _Seen.by_name.setdefault((name, special), _Seen(remember))
    every, at, count, which = pieces_encoded(buf, starts, ends, seen, lambda pieces: _encode_pieces(pieces, name, special))
    every = np.append(every, np.uint32(end_id))
    at, count = np.append(at, len(every) - 1), np.append(count, 1)
    stops = np.searchsorted(starts, offs[1:])
    which = np.insert(which.astype(np.int32), stops, len(at) - 1)
    upto = np.concatenate([[0], np.cumsum(count[which])])
    rows = upto[np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])]
    return ragged(every, at[which], count[which]), rows
