"""Lossless paths as columns: a tagged struct, a sortable key, and component tests.

A path of valid UTF-8 is ``(utf8, value, null)``, any other ``(unix_bytes, null, base64)``.  The key of
the second kind starts with NUL, so keys sort before all UTF-8 paths, and by base64 text among themselves.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = "\x00unix_bytes:"


def base64_text(raw: Column) -> Column:
    """RFC 4648 with padding, on one line (the built-in breaks lines)."""
    return F.regexp_replace(F.base64(raw), "[\r\n]", "")


def base64_bytes(text: Column) -> Column:
    """Lenient: characters outside the alphabet are skipped."""
    clean = F.regexp_replace(text, "[^A-Za-z0-9+/]", "")
    # a single left-over character holds no whole byte
    whole = F.when(F.length(clean) % 4 == 1, clean.substr(F.lit(1), F.length(clean) - 1)).otherwise(clean)
    return F.unbase64(F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), "="))


def native_path(raw: Column) -> Column:
    """The path struct of path bytes."""
    valid = F.is_valid_utf8(raw)
    return F.when(raw.isNull(), F.lit(None)).otherwise(
        F.struct(
            F.when(valid, "utf8").otherwise("unix_bytes").alias("encoding"),
            F.when(valid, raw.cast("string")).alias("value"),
            F.when(~valid, base64_text(raw)).alias("base64"),
        )
    )


def path_bytes(path: Column) -> Column:
    return F.coalesce(path["value"].cast("binary"), base64_bytes(path["base64"]))


def path_key(path: Column) -> Column:
    """Sorting by this key is the order of paths; it is also the key of maps and joins."""
    return F.coalesce(path["value"], F.concat(F.lit(_TAG), path["base64"]))


def components(text: Column) -> Column:
    """Sorting by components is the order of discovery; empty and "." components don't count."""
    parts = F.split(text, "/")
    return F.filter(parts, lambda c, i: (i == 0) | ((c != "") & (c != ".")))


def is_hidden(relative: Column) -> Column:
    """Whether any component of a path relative to its root starts with a dot."""
    return F.exists(F.split(relative, "/"), lambda c: c.startswith("."))


def is_within(path: Column, folder: Column) -> Column:
    """Whether ``folder`` is a prefix of ``path`` by whole components."""
    own, top = components(path), components(folder)
    return F.slice(own, F.lit(1), F.greatest(F.size(top), F.lit(1))) == top


def strip_root(path: Column, root: Column) -> Column:
    own, top = components(path), components(root)
    return F.array_join(F.slice(own, F.size(top) + 1, F.greatest(F.size(own) - F.size(top), F.lit(0))), "/")


# --- the same for single values, for the walker and the driver


def from_bytes(raw: bytes) -> dict:
    try:
        return {"encoding": "utf8", "value": raw.decode(), "base64": None}
    except UnicodeDecodeError:
        return {"encoding": "unix_bytes", "value": None, "base64": base64.b64encode(raw).decode()}


def to_bytes(path: dict) -> bytes:
    return path["value"].encode() if path["encoding"] == "utf8" else base64.b64decode(path["base64"])


def key_of(path: dict) -> str:
    return path["value"] if path["encoding"] == "utf8" else _TAG + path["base64"]


def display(path: dict) -> str:
    """For people: control characters escaped; other encodings marked."""
    if path["encoding"] != "utf8":
        return f"<non-utf8:{path['base64']}>"
    return "".join(_ESCAPES.get(c) or (f"\\u{{{ord(c):x}}}" if _is_control(c) else c) for c in path["value"]) if any(map(_is_control, path["value"])) else path["value"]


_ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\", '"': '\\"', "'": "\\'"}


def _is_control(c: str) -> bool:
    return ord(c) < 32 or 127 <= ord(c) < 160


def component_key(raw: bytes) -> list[str]:
    """Components in an order-preserving text form, for sorting in the order of discovery."""
    parts = raw.split(b"/")
    kept = [p for i, p in enumerate(parts) if i == 0 or p not in (b"", b".")]
    return [p.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode() for p in kept]
