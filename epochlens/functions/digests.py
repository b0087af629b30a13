"""SHA-256 that stops in one task and goes on in another."""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
from functools import cache


class _Context(ctypes.Structure):
    """SHA256_CTX of openssl/sha.h."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint)]


@cache
def _library() -> ctypes.CDLL:
    """The OpenSSL that hashlib itself is linked with."""
    lib = ctypes.CDLL(_hashlib.__file__)
    lib.SHA256_Init.argtypes = [ctypes.POINTER(_Context)]
    lib.SHA256_Update.argtypes = [ctypes.POINTER(_Context), ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.POINTER(_Context)]
    return lib


class Sha256:
    """A digest whose state is bytes. hashlib's can't be handed on."""

    def __init__(self, state: bytes | None = None):
        self.context = _Context() if state is None else _Context.from_buffer_copy(state)
        if state is None:
            _library().SHA256_Init(self.context)

    def update(self, data: bytes) -> Sha256:
        _library().SHA256_Update(self.context, data, len(data))
        return self

    def state(self) -> bytes:
        return bytes(self.context)

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        _library().SHA256_Final(out, _Context.from_buffer_copy(self.context))
        return out.raw.hex()


@cache
def resumable() -> bool:
    """Whether this Python's OpenSSL lets a state be handed on."""
    try:
        first = Sha256().update(b"a" * 100)
        return Sha256(first.state()).update(b"\0b").hexdigest() == hashlib.sha256(b"a" * 100 + b"\0b").hexdigest()
    except (AttributeError, OSError):
        return False
