"""Token ids exactly as the tokenizers library gives them, at the speed of arrays.

The array segmenter cuts plain texts into pieces and every distinct piece is merged once, by the
merge list of the library's own file.  A text outside the segmenter's alphabet goes to the library
whole.  Strings of special tokens inside a text are ordinary text.  Tests hold both ways against the
library.
"""

from __future__ import annotations

from quire.llm.matrix_bpe import from_merges, from_ranks
from quire.llm.segment import BlockEncoder

_ENCODERS: dict[tuple[str, str], BlockEncoder] = {}


def vocabulary(name: str, directory: str | None = None) -> str:
    """The place of a tokenizer file: in ``directory``, or where the installed tokenizer package keeps it."""
    if directory:
        return f"{directory.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def library_encoder(path: str, mode: str) -> BlockEncoder:
    """One encoder per worker process and file; mode as of Segmenter."""
    if (path, mode) not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        library = []

        def whole(text: str) -> list[int]:
            if not library:
                from tokenizers import Tokenizer

                library.append(Tokenizer.from_file(path))
                library[0].encode_special_tokens = True
            return library[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[path, mode] = BlockEncoder(mode, from_merges(path).encode_pieces, whole)
    return _ENCODERS[path, mode]


def rank_encoder(path: str, pattern: str) -> tuple[BlockEncoder, list[bytes]]:
    """The encoder of a rank file, and the bytes of each id.  A text that isn't plain is split by ``pattern``."""
    if (path, pattern) not in _ENCODERS:
        import numpy as np
        import regex

        bpe, tokens = from_ranks(path)
        split = regex.compile(pattern)

        def whole(text: str) -> np.ndarray:
            pieces = [m.encode("utf-8") for m in split.findall(text)]
            if not pieces:
                return np.empty(0, np.uint32)
            return bpe.encode_pieces(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]))[0]

        _ENCODERS[path, pattern] = BlockEncoder("gpt", bpe.encode_pieces, whole), tokens
    return _ENCODERS[path, pattern]
