import base64
import random

import pytest

from waylace.llm import secrets


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def key(numbers, width=64, seed=1):
    r = random.Random(seed)
    return tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, b"\x01" + r.randbytes(width)) for _ in range(numbers - 1)))


def openssh():
    field = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(random.Random(4).randbytes(136))


def wrapped(data, columns, end="\n"):
    code = base64.b64encode(data).decode()
    return end.join(code[i : i + columns] for i in range(0, len(code), columns))


def found(text):
    return [text[a:b] for k, a, b in secrets.confirmed_spans(text) if k == "key"]


def test_dsa_in_armour():
    pem = f"-----BEGIN DSA PRIVATE KEY-----\n{wrapped(key(6), 64)}\n-----END DSA PRIVATE KEY-----"
    assert found(f"see {pem} there") == [pem]
    assert not secrets.is_private_key(key(5)) and not secrets.is_private_key(key(7))


@pytest.mark.parametrize("end", ["\\n", "\\r\\n", "\\\\n"])
def test_armour_with_escaped_line_ends(end):
    pem = f"-----BEGIN RSA PRIVATE KEY-----{end}{wrapped(key(9), 64, end)}{end}-----END RSA PRIVATE KEY-----"
    assert found('{"key": "' + pem + end + '"}') == [pem]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\n    "])
@pytest.mark.parametrize("columns", [64, 76])
@pytest.mark.parametrize("data", [key(9), key(9, 61), key(6, 32), openssh()])
def test_wrapped_without_armour(data, columns, end):
    body = wrapped(data, columns, end)
    assert found(f"prose{end}{body}{end}More words follow") == [body]
    assert found(f"{'x' * 50}{end}{body}") == [body]
    assert not found(f"prose{end}{wrapped(random.Random(2).randbytes(400), columns, end)}{end}words")
