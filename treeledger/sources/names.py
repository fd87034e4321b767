"""File names as text. Bytes that are no UTF-8 keep a place of their own and come back unchanged."""

# Python marks such bytes with lone surrogates, which Arrow cannot carry; a private range can.
_SURROGATES, _PRIVATE = 0xDC80, 0xF0080
_TO_TEXT = {_SURROGATES + n: _PRIVATE + n for n in range(128)}
_TO_NAME = {text: name for name, text in _TO_TEXT.items()}


# Characters of a name that lie in that range themselves go the same way, byte by byte.
_TO_TEXT |= {p: "".join(chr(_PRIVATE + b - 128) for b in chr(p).encode()) for p in _TO_NAME}


def to_text(name: str) -> str:
    return name.translate(_TO_TEXT)


def to_name(text: str) -> str:
    # Bytes that are UTF-8 after all become characters again.
    return text.translate(_TO_NAME).encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape")
