"""Cutting of ONNX models: a model that ends at one of its inner nodes, so that this node's values are its output.

A model file is a protocol buffer. Only the graph's list of outputs changes; all other fields are copied as they are, so
no library for the format is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

from embedspace.operators.images import EMBEDDING_NODE

#: Numbers of fields in the ONNX format.
MODEL_GRAPH, GRAPH_NODE, GRAPH_OUTPUT, NODE_OUTPUT, VALUE_NAME, VALUE_TYPE, TYPE_TENSOR, TENSOR_ELEMENT, FLOAT = 7, 1, 12, 2, 1, 2, 1, 1, 1
#: Kinds of fields: a number of variable length, eight bytes, bytes with their length, four bytes.
VARINT, EIGHT, BYTES, FOUR = 0, 1, 2, 5


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return n, at


def fields(data: memoryview) -> Iterator[tuple[int, memoryview, memoryview]]:
    """(number, the whole field, its content) of a message."""
    at = 0
    while at < len(data):
        start = at
        tag, at = read_varint(data, at)
        if tag & 7 == BYTES:
            size, at = read_varint(data, at)
        elif tag & 7 == VARINT:
            size = read_varint(data, at)[1] - at
        elif tag & 7 in (EIGHT, FOUR):
            size = 8 if tag & 7 == EIGHT else 4
        else:
            raise ValueError("not an ONNX model")
        at += size
        if at > len(data):
            raise ValueError("the model is cut off")
        yield tag >> 3, data[start:at], data[at - size : at]


def field(number: int, content: bytes | str | int) -> bytes:
    if isinstance(content, int):
        return varint(number << 3 | VARINT) + varint(content)
    content = content.encode() if isinstance(content, str) else content
    return varint(number << 3 | BYTES) + varint(len(content)) + content


def cut_model(model: bytes, node: str = EMBEDDING_NODE) -> bytes:
    """The model with this node's value (of floats) as its only output."""
    out, found = [], False
    for number, whole, content in fields(memoryview(model)):
        if number != MODEL_GRAPH:
            out.append(bytes(whole))
            continue
        graph = []
        for n, part, inner in fields(content):
            if n == GRAPH_NODE:
                found |= any(k == NODE_OUTPUT and bytes(x) == node.encode() for k, _, x in fields(inner))
            if n != GRAPH_OUTPUT:
                graph.append(bytes(part))
        kind = field(TYPE_TENSOR, field(TENSOR_ELEMENT, FLOAT))
        graph.append(field(GRAPH_OUTPUT, field(VALUE_NAME, node) + field(VALUE_TYPE, kind)))
        out.append(field(MODEL_GRAPH, b"".join(graph)))
    if not found:
        raise ValueError(f"the model has no node with the output {node}")
    return b"".join(out)
