"""Token ids of whole texts by the tokenizers library, with a bounded memo of word chunks.

Byte-pair encoders split a text into pre-tokens first and treat each alone. Where that split is
known to fall before every blank that follows a non-blank, a text is cut there, equal chunks are
encoded once, and the ids are joined: the same ids as for the whole text. New chunks are encoded
many in one text, whose ids are parted again by the bytes that each id spells.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_BYTES = 160 << 20  # of chunks a worker remembers, with what Python needs for each
ENTRY_BYTES = 260       # of a chunk besides its characters and ids
MEMO_CHARS = 48     # longer chunks are encoded each time
JOINED = 512        # new chunks encoded at once
BATCH_CHARS = 1 << 21   # characters whose chunks are looked up together

_LEADING = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Blanks, joiners and controls on which libraries may differ, besides the space and the line feed.
_ODD = re.compile("[\\x00-\\x09\\x0b-\\x1f\\x7f-\\xa0\\xad\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff]")
_RUNS = ("  ", " \n", "\n ", "\n\n")
_WORD_END = "</w>"
_STATE: dict = {}


class Encoder:
    """``blanks``: "leading" if a single blank belongs to the next word's pre-token (byte-level
    splits), "dropped" if blanks belong to none, None to encode whole texts only."""

    def __init__(self, config: str, blanks: str | None, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(config)
        added = sorted({t.content for t in self.library.get_added_tokens_decoder().values() if t.content}, key=len, reverse=True)
        #: the library finds added tokens before it splits: texts that hold one (in any case, as
        #: normalisers may change it) are encoded whole
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        vocab = self.library.get_vocab(with_added_tokens=True)
        #: bytes an id spells: byte-level vocabularies write each byte as one character
        self.spells = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.spells[i] = len(token.removesuffix(_WORD_END))
        self.blanks = blanks
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0

    @classmethod
    def shared(cls, config: str, blanks: str | None, end_id: int | None = None) -> Encoder:
        """One encoder a worker process and configuration."""
        key = (hashlib.md5(config.encode()).hexdigest(), blanks, end_id)
        if key not in _STATE:
            _STATE[key] = cls(config, blanks, end_id)
        return _STATE[key]

    def _keys(self, text: str) -> str | list[str]:
        """Keys of the memo, as one string if they are its parts between single spaces. In
        "leading" mode a key without a blank in front is the word after one space; the first word
        of a text is marked by a zero character."""
        if self.added and self.added.search(text):
            return [text if self.blanks == "dropped" else "\0" + text]
        if self.blanks == "dropped":
            return text.replace("\n", " ")
        if self.blanks != "leading" or _ODD.search(text):
            return ["\0" + text]
        if text == "" or text[0] in " \n" or text[-1] in " \n" or any(run in text for run in _RUNS):
            return ["\0" + c if c[0] not in " \n" else c for c in _LEADING.findall(text)]
        return "\0" + text.replace("\n", " \n")

    def _plain(self, key: str) -> str:
        """The piece of text that a key stands for."""
        if self.blanks == "dropped" or key[0] in " \n":
            return key
        return key[1:] if key[0] == "\0" else " " + key

    def _joins(self, key: str) -> bool:
        """Whether the chunk can stand among others in one text without changing its ids or theirs."""
        if len(key) > MEMO_CHARS or not key or (self.added and self.added.search(key)):
            return False
        if self.blanks == "dropped":
            return not _ODD.search(key)
        return key[0] not in "\0 \n" or (key[0] == "\n" and len(key) > 1 and key[1] not in " \n")

    def _joined(self, keys: list[str]) -> dict[str, bytes] | None:
        """Ids of chunks encoded as one text; None if its ids don't part where the chunks do."""
        pieces = [self._plain(k) for k in keys]
        text = (" " if self.blanks == "dropped" else "").join(pieces)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        if self.blanks == "dropped" and self.library.normalizer is not None:
            pieces = self.library.normalizer.normalize_str(text).split(" ")
        if len(pieces) != len(keys):
            return None
        ends = np.cumsum([len(p.encode()) for p in pieces])
        spelled = np.cumsum(self.spells[ids])
        cut = np.searchsorted(spelled, ends)
        if not len(ids) or spelled[-1] != ends[-1] or (spelled[cut] != ends).any():
            return None
        raw, stops = ids.tobytes(), (4 * (cut + 1)).tolist()
        return {k: raw[a:b] for k, a, b in zip(keys, [0, *stops], stops)}

    def _new(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not in the memo."""
        got: dict[str, bytes] = {}
        together = [k for k in keys if self._joins(k)] if self.blanks else []
        for a in range(0, len(together), JOINED):
            got.update(self._joined(together[a:a + JOINED]) or {})
        alone = [k for k in keys if k not in got]
        made = self.library.encode_batch_fast([self._plain(k) if k else "" for k in alone], add_special_tokens=False)
        got.update((k, np.array(e.ids, "<u4").tobytes()) for k, e in zip(alone, made))
        return got

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last; null counts as empty."""
        batch, chars = [], 0
        for t in texts:
            batch.append(t or "")
            chars += len(batch[-1])
            if chars >= BATCH_CHARS:
                yield from self._batch(batch)
                batch, chars = [], 0
        if batch:
            yield from self._batch(batch)

    def _batch(self, texts: list[str]) -> list[bytes]:
        """Every different chunk is looked up once; its ids are copied to all its places."""
        split = [self._keys(t) for t in texts]
        order = sorted(range(len(split)), key=lambda i: isinstance(split[i], list))
        plain = [split[i] for i in order if isinstance(split[i], str)]
        listed = [split[i] for i in order[len(plain):]]
        parts = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = {k: len(keys) + i for i, k in enumerate(dict.fromkeys(chain.from_iterable(listed)))}
        keys += place
        code = np.concatenate([coded.indices.to_numpy(),
                               np.fromiter((place[k] for k in chain.from_iterable(listed)), np.int64)])
        chunks = np.concatenate([np.diff(parts.offsets.to_numpy()), [len(x) for x in listed]]).astype(np.int64)

        memo = self.memo
        found = list(map(memo.get, keys))
        new = self._new(list({k for k, v in zip(keys, found) if v is None}))
        found = [new[k] if v is None else v for k, v in zip(keys, found)]
        for k, v in new.items():   # the chunks seen first are the frequent ones: they stay
            if self.memo_bytes >= MEMO_BYTES:
                break
            if len(k) <= MEMO_CHARS:
                memo[k] = v
                self.memo_bytes += ENTRY_BYTES + len(k) + len(v)

        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        n = size[code]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(start[code] - end[:-1], n) + np.arange(end[-1])]
        raw = ids.tobytes()
        stop = (4 * end[np.concatenate([[0], np.cumsum(chunks)])]).tolist()
        out = [b""] * len(texts)
        for i, a, b in zip(order, stop, stop[1:]):
            out[i] = raw[a:b] + self.end
        return out
