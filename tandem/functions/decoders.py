"""Payload decoders: bytes to canonical trees."""

from __future__ import annotations

from collections.abc import Callable
from xml.parsers import expat

from tandem.functions.canon import JAVA_BLANK, DecodeError, Tree, read

Decoder = Callable[[bytes | None, str], Tree]


def decode_json(payload: bytes | None, topic: str) -> Tree:
    if not payload:
        raise DecodeError(f"empty payload on topic {topic}")
    try:
        return read(bytes(payload).decode("utf-8-sig"))
    except (ValueError, RecursionError) as e:
        raise DecodeError(f"invalid JSON on topic {topic}") from e


class _Element:
    def __init__(self, attributes: dict[str, str]):
        self.fields: dict[str, Tree] = {f"@{k}": v for k, v in attributes.items()}
        self.children: dict[str, list[Tree]] = {}
        self.text = ""

    def tree(self) -> Tree:
        if not self.fields and not self.children:
            return self.text
        if self.text:
            self.fields["#text"] = self.text
        return self.fields | {k: v[0] if len(v) == 1 else v for k, v in self.children.items()}


def decode_xml(payload: bytes | None, topic: str) -> Tree:
    """Attributes are @name, mixed text is #text, repeated elements are arrays, leaves are strings. Each piece of text is
    trimmed by itself. Document types are refused; names keep their prefixes."""
    parser = expat.ParserCreate()
    root, open_, piece = _Element({}), [], []

    def flush(*_: object) -> None:
        if open_:
            open_[-1].text += "".join(piece).strip(JAVA_BLANK)
        piece.clear()

    def start(_name: str, attributes: dict[str, str]) -> None:
        flush()
        open_.append(_Element(attributes))

    def end(name: str) -> None:
        flush()
        done = open_.pop()
        (open_[-1] if open_ else root).children.setdefault(name, []).append(done.tree())

    def refuse(*_: object) -> None:
        raise DecodeError("document types are not allowed")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, piece.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = flush
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = flush
    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(bytes(payload or b""), True)
    except (expat.ExpatError, ValueError) as e:
        raise DecodeError(f"invalid XML on topic {topic}") from e
    return root.tree()


class DecoderRegistry:
    """Decoders by format, whatever its case."""

    def __init__(self) -> None:
        self.by_format: dict[str, Decoder] = {}

    @staticmethod
    def standard() -> DecoderRegistry:
        return DecoderRegistry().register("json", decode_json).register("xml", decode_xml)

    def register(self, name: str, decoder: Decoder) -> DecoderRegistry:
        self.by_format[name.lower()] = decoder
        return self

    def get(self, name: str) -> Decoder:
        if name.lower() not in self.by_format:
            raise ValueError(f"no decoder for format '{name}', registered: {sorted(self.by_format)}")
        return self.by_format[name.lower()]
