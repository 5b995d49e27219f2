"""Handlers of errors by kind: called with an error before it goes on."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

_HANDLERS: dict[type[BaseException], Callable[[BaseException], None]] = {}


def set_handler(kind: type[BaseException], handler: Callable[[BaseException], None] | None) -> None:
    """One handler for each kind; None takes it away."""
    if handler is None:
        _HANDLERS.pop(kind, None)
    else:
        _HANDLERS[kind] = handler


@contextmanager
def reported():
    """Errors inside go to the handler of their nearest kind, and then on."""
    try:
        yield
    except BaseException as e:
        for kind in type(e).__mro__:
            if kind in _HANDLERS:
                _HANDLERS[kind](e)
                break
        raise
