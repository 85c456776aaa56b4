"""Token ids of whole texts by a public tokenizer file, with a memo of the pieces that it never merges across.

Byte-pair merges stay inside a pre-token, so a text's ids are those of its pre-tokens in turn. Two layouts are known
from the tokenizer's own file. Where white space is dropped, a word found once is encoded once per worker. Where bytes
are merged in the order of their ids, a rank encoder over the same vocabulary gives the same ids for less. Any other
layout is encoded text by text.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: The pre-tokens of the byte-level layout, as the tokenizers library cuts them.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept in a worker's memo, and the longest word that is kept; more words start the memo anew.
MEMO_WORDS, MEMO_CHARS = 600_000, 40
#: Below this character (end of extended Latin) Unicode normal form C changes nothing and letters lower one by one.
_PLAIN = "\u0250"
#: Below it: letters (what is left of word characters without numbers) and ASCII marks without the apostrophe.
_PLAIN_RUN = re.compile(r"[^\W\d_²³¹¼½¾]+|[!-&(-/:-@\[-`{-~]+")
_PLAIN_WORD = re.compile(r"(?:[^\W\d_²³¹¼½¾]|[!-&(-/:-@\[-`{-~])+")

_encoders: dict[int, Encoder] = {}


def vocabulary(path: str) -> str:
    """The tokenizer file's content, read by the driver and sent along with the tasks (under 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder(content: str) -> Encoder:
    """The worker's own encoder of a tokenizer file, kept between tasks."""
    key = hash(content)
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _in_rank_order(model: dict) -> bool:
    """Whether every merge makes the token of the next id, which is what a rank encoder takes for granted."""
    vocab, ids = model["vocab"], []
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        ids.append(vocab.get(a + b, -1))
    return ids == sorted(ids) and len(set(ids)) == len(ids) and not model.get("end_of_word_suffix") and not model.get("ignore_merges")


def _rank_encoder(parsed: dict, chars: dict[int, str]):
    import tiktoken

    special = {t["content"] for t in parsed.get("added_tokens", [])}
    byte_of = {c: b for b, c in chars.items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class _Memo(dict):
    """Ids of words met before; a new word is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        code = self.encode(word)
        if len(word) <= MEMO_CHARS:
            self[word] = code
        return code


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the library does with ``add_special_tokens=False``.

    None is added, but the string of a special token in a text is that token, as the library has it.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.model = self.tokenizer.model
        self.chars = _byte_chars()
        parsed = json.loads(content)
        self.layout = self._layout(parsed)
        self.ranks = _rank_encoder(parsed, self.chars) if self.layout == "ranked" else None
        self.special = [t["content"] for t in parsed.get("added_tokens", [])]
        self.memo, self.stems = _Memo(self._word), {}

    @staticmethod
    def _layout(j: dict) -> str | None:
        """``ranked``: byte-level, merges in order of ids. ``dropped``: white space is dropped, text is lowered."""
        if any(t.get("normalized") for t in j.get("added_tokens", [])):  # might be found where the text does not hold it
            return None
        pre = j.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not j.get("normalizer") and _in_rank_order(j["model"]):
            return "ranked"
        parts = pre.get("pretokenizers") or [{}]
        drops = parts[0].get("behavior") == "Removed" and parts[0].get("invert") and parts[0].get("pattern", {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        steps = [n.get("type") for n in (j.get("normalizer") or {}).get("normalizers", [])]
        return "dropped" if drops and steps == ["NFC", "Replace", "Lowercase"] else None

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _stem(self, piece: str) -> bytes:
        """Ids of one pre-token: merges only, without the costs of a whole encoding."""
        code = self.stems.get(piece)
        if code is None:
            seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.chars)
            code = self.stems[piece] = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        return code

    def _word(self, w: bytes) -> bytes:
        """Ids of one word. Runs of plain letters and of ASCII marks but the apostrophe need no general pattern."""
        if w.isalpha():  # bytes: ASCII letters only
            return self._stem(w.decode().lower())
        if w[-1] in b".," and w[:-1].isalpha():
            return self._stem(w[:-1].decode().lower()) + self._stem(chr(w[-1]))
        s = w.decode().lower()
        if max(s) < _PLAIN and _PLAIN_WORD.fullmatch(s):
            return b"".join(map(self._stem, _PLAIN_RUN.findall(s)))
        return self._direct([w.decode()])[0]

    def _cut(self, text: str) -> list[bytes]:
        """Words of a text at ASCII white space, A-Z lowered unless a mark might combine with one of them."""
        b = text.encode()
        return (b if b"\xcc" in b or b"\xcd" in b else b.lower()).split()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.layout is None:
            return self._direct(texts)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if len(self.stems) > MEMO_WORDS:
            self.stems.clear()
        out, get = [], self.memo.__getitem__
        for t in texts:
            if any(x in t for x in self.special):
                out += self._direct([t])
            elif self.ranks is not None:
                out.append(array("I", self.ranks.encode_ordinary(t)).tobytes())
            else:
                out.append(b"".join(map(get, self._cut(t))))
        return out
