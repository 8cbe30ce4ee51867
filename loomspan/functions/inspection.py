"""What identifies a function and a call: name, source, bound arguments."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable


def source_of(function: Callable) -> tuple[str, str | None, int]:
    """(source, file, first line); without source a stand-in that changes with the code, and line -1."""
    code = getattr(inspect.unwrap(function), "__code__", None)
    try:
        lines, first = inspect.getsourcelines(inspect.unwrap(function))
        return "".join(lines), inspect.getsourcefile(inspect.unwrap(function)), first
    except (OSError, TypeError):
        return (str(hash((code.co_code, code.co_consts))) if code else repr(function)), getattr(code, "co_filename", None), -1


def name_of(function: Callable) -> tuple[list[str], str]:
    """(module path, name); nested functions carry what encloses them."""
    function = inspect.unwrap(function)
    module = getattr(function, "__module__", None) or "unknown"
    if module == "__main__":
        file = source_of(function)[1]
        module = "__main__." + ("".join(c if c.isalnum() else "-" for c in file) if file else "interactive")
    qualified = getattr(function, "__qualname__", getattr(function, "__name__", type(function).__name__)).replace("<", "").replace(">", "")
    *outer, name = qualified.split(".")
    return [*module.split("."), *outer], name


def bound_arguments(function: Callable, ignore: list[str] | tuple[str, ...] = (), args: tuple = (), kwargs: dict | None = None) -> dict[str, object]:
    """Arguments by name with defaults filled in; extra ones under ``*`` and ``**``; ignored ones removed.

    What isn't a function keeps all its arguments under ``*`` and ``**``.
    """
    kwargs = kwargs or {}
    if not (inspect.isfunction(function) or inspect.ismethod(function)):
        if ignore:
            warnings.warn(f"arguments of {function!r} can't be told apart; ignoring none", stacklevel=2)
        return {"*": list(args), "**": dict(kwargs)}
    signature = inspect.signature(function)
    try:
        bound = signature.bind(*args, **kwargs)
    except TypeError as e:
        raise ValueError(f"wrong arguments for {format_call(function, args, kwargs)}: {e}") from e
    bound.apply_defaults()
    out: dict[str, object] = {}
    for p in signature.parameters.values():
        if p.kind is p.VAR_POSITIONAL:
            out["*"] = list(bound.arguments[p.name])
        elif p.kind is p.VAR_KEYWORD:
            out["**"] = dict(bound.arguments[p.name])
        else:
            out[p.name] = bound.arguments[p.name]
    for name in ignore:
        if name not in out:
            raise ValueError(f"{name!r} isn't an argument of {name_of(function)[1]}")
        out.pop(name)
    return out


def format_call(function: Callable, args: tuple = (), kwargs: dict | None = None, longest: int = 1500, kept: int = 700) -> str:
    """The call as text; long arguments show their begin and end."""

    def shown(x: object) -> str:
        text = repr(x)
        return text if len(text) <= longest else f"{text[:kept]}...{text[-kept:]}"

    parts = [*map(shown, args), *(f"{k}={shown(v)}" for k, v in (kwargs or {}).items())]
    path, name = name_of(function)
    return f"{'.'.join([*path, name])}({', '.join(parts)})"
