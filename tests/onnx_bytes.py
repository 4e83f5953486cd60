"""Writes tiny ONNX models by hand (protobuf wire format), for scorer tests."""


def _varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def _int(field, n):
    return _varint(field << 3) + _varint(n)


def _msg(field, body):
    body = body.encode() if isinstance(body, str) else body
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _value(name, dims):
    shape = b"".join(_msg(1, _msg(2, d) if isinstance(d, str) else _int(1, d)) for d in dims)
    return _msg(1, name) + _msg(2, _msg(1, _int(1, 1) + _msg(2, shape)))


def node(op, inputs, outputs, **ints):
    attrs = b""
    for name, v in ints.items():
        many = isinstance(v, list)
        body = b"".join(_int(8, x & (2**64 - 1)) for x in v) if many else _int(3, v)
        attrs += _msg(5, _msg(1, name) + body + _int(20, 7 if many else 2))
    return b"".join(_msg(1, i) for i in inputs) + b"".join(_msg(2, o) for o in outputs) + _msg(4, op) + attrs


def model(nodes, inputs, outputs):
    graph = b"".join(_msg(1, n) for n in nodes) + _msg(2, "g")
    graph += b"".join(_msg(11, _value(*i)) for i in inputs) + b"".join(_msg(12, _value(*o)) for o in outputs)
    return _int(1, 8) + _msg(8, _msg(1, "") + _int(2, 13)) + _msg(7, graph)
