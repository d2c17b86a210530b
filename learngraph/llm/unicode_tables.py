"""Per-code-point tables for vectorised text work: letters, lower case, scripts."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

# First code point of each block of letters, in order, and the script it holds.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1D00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Glagolitic"), (0x2C60, "Latin"), (0x2C80, "Coptic"), (0x2DE0, "Cyrillic"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3400, "Han"),
    (0xA000, "Yi"), (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
TOP = 0x110000


@functools.cache
def letters() -> np.ndarray:
    """True for letters and the marks that belong to them."""
    out = np.zeros(TOP, bool)
    out[[c for c in range(TOP) if unicodedata.category(chr(c))[0] in "LM"]] = True
    return out


@functools.cache
def proper_letters() -> np.ndarray:
    """True for letters alone."""
    out = np.zeros(TOP, bool)
    out[[c for c in np.flatnonzero(letters()).tolist() if unicodedata.category(chr(c))[0] == "L"]] = True
    return out


@functools.cache
def lower() -> np.ndarray:
    """The lower-case form where it is one code point, else the code point itself."""
    out = np.arange(TOP, dtype=np.uint32)
    for c in np.flatnonzero(letters()).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


@functools.cache
def scripts() -> np.ndarray:
    """Number in SCRIPTS of each code point's script."""
    starts = np.array([s for s, _ in SCRIPT_STARTS])
    names = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS], np.uint8)
    return names[np.searchsorted(starts, np.arange(TOP), side="right") - 1]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, a line end after each text, and where each text begins (one more than texts)."""
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
