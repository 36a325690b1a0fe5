"""Token ids of a public byte-level BPE vocabulary, with a cache of words."""

from __future__ import annotations

import base64
import re
from array import array

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from fleetstream.llm.common import worker_cache

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Words whose ids a worker remembers; beyond that it starts anew.
CACHED = 250_000
#: White space beside white space or at an end of the text: its place in the tokens depends on what is around.
ODD = re.compile(r"\s\s|\A\s|\s\Z")


class Encoder:
    """Ids of a text as bytes of little-endian unsigned 32-bit numbers.

    The pattern of the vocabulary always cuts before a single space between two
    other characters, so texts are cut there and the ids of each word (with its
    space) are remembered. Texts with other white space around a cut are encoded
    whole, and texts with the string of a special token by ``tokenizers``, which
    turns it into that token's id.
    """

    def __init__(self, vocabulary: str, ranks: str):
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        with open(ranks, "rb") as f:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
        self.size = self.whole.get_vocab_size()
        self.cache: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if ODD.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        cache = self.cache
        try:
            return self.plain(first) + b"".join([cache[w] for w in rest])
        except KeyError:
            if len(cache) > CACHED:
                cache.clear()
            for w in rest:
                if w not in cache:
                    cache[w] = self.plain(" " + w)
            return self.plain(first) + b"".join([cache[w] for w in rest])


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """The encoder of this worker. Paths default to the files that the installed package names on each machine."""
    paths = vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    return worker_cache(paths, lambda: Encoder(*paths))


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter than ``most``."""
    first = length % most or most
    return [(0, min(first, length)), *((at, most) for at in range(first, length, most))] if length else []
