"""Token ids of whole texts by a public tokenizer file, exact and fast on text whose words repeat.

For tokenizers that drop white space and treat the words between it on their own (``word_bpe_49k.json`` does: it splits
by a pattern that never crosses white space), the ids of a text are the ids of its words, one after another. So each
word is encoded once and then looked up; texts that this doesn't hold for go to the library whole.

Most words of a corpus come once, so a word is kept when it comes again soon; until then it is among a bounded number of
recent ones. Words that come once don't take the place of those that repeat, however late these begin.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array

from .common import holds

#: Words whose ids are kept for good, and words seen once lately (some 45 MB in a Python worker together); others are
#: encoded each time.
CACHE_WORDS = 200_000
RECENT_WORDS = 100_000
#: The name of the default vocabulary file in the public tokenizers package; its path is a parameter everywhere.
WORD_BPE = "word_bpe_49k.json"

_LETTERS = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+")
#: Marks behind a letter are a piece of their own; none of these is the end of an added token.
_MARKS = b'!"#$%&)*,.:;?'
_TAIL = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([" + _MARKS + rb"]+)\Z")
_loaded: dict[str, "WordTokenizer"] = {}
#: What operators that count or write tokens keep is kept under this name.
NAME = "tokens"
holds(NAME, _loaded.clear)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def loaded(path: str) -> "WordTokenizer":
    """One tokenizer for each file and Python process, until an operator begins there that has no use for it."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class WordTokenizer(dict):
    """word (UTF-8, A-Z lower-cased) -> its ids as unsigned 32-bit integers in the machine's (little-endian) order."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.recent: dict[bytes, bytes] = {}
        # bytes as the model's alphabet writes them: printable ones stand for themselves, the others follow U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.alphabet = "".join(alphabet[b] for b in range(256))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.recent.get(word)
        if ids is not None:
            if len(self) < CACHE_WORDS:
                self[word] = ids
                del self.recent[word]
            return ids
        ids = self.encoded(word)
        if len(self.recent) >= RECENT_WORDS:
            self.recent.clear()
        self.recent[word] = ids
        return ids

    def encoded(self, word: bytes) -> bytes:
        # a run of letters in composed form is one piece, which the model takes as it is in lower case
        if word.isalpha():
            return array("I", [t.id for t in self.model.tokenize(word.decode("ascii"))]).tobytes()
        tail = _TAIL.search(word) if word[-1] in _MARKS else None
        if tail:
            return self[word[: tail.start(1)]] + self[tail[1]]
        text = word.decode("utf-8")
        if _LETTERS.fullmatch(text):
            letters, _ = codecs.charmap_decode(text.lower().encode("utf-8"), "strict", self.alphabet)
            return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        # anything else goes through all the library's steps
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text, as ``encode(text, add_special_tokens=False)`` gives them."""
        return b"".join(map(self.__getitem__, text.lower().split()))
