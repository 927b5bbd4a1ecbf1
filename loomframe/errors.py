"""Exceptions of the library: one class for each way an operation can be refused."""

from __future__ import annotations


class FrameError(Exception):
    """Base of all errors raised here."""


class ColumnNotFound(FrameError, KeyError):
    pass


class LengthMismatch(FrameError, ValueError):
    pass


class TypeMismatch(FrameError, TypeError):
    pass


class InvalidDType(FrameError, TypeError):
    pass


class InvalidIndex(FrameError, KeyError):
    pass


class InvalidJoin(FrameError, ValueError):
    pass


class InvalidOperation(FrameError, ValueError):
    pass


class ShapeMismatch(FrameError, ValueError):
    pass


class BroadcastMismatch(FrameError, ValueError):
    pass


class OutOfBounds(FrameError, IndexError):
    pass


class ParseError(FrameError, ValueError):
    pass


class EmptyData(FrameError, ValueError):
    pass


class NotSupported(FrameError, NotImplementedError):
    pass
