"""Text and name normalisation as built-in Column expressions (TX1-TX9).

Everything here is JVM-side (``translate``, ``regexp_replace``, ``lower``,
``rlike``); no Python UDF is involved, so the expressions stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's normalisation (kept as text).
# ---------------------------------------------------------------------------
# Quotes mapped to the ASCII double quote: U+201C U+201D U+201E U+201F U+00AB
# U+00BB U+2018 U+2019 U+201A U+201B U+2039 U+203A and the ASCII apostrophe.
QUOTE_CHARS = "“”„‟«»‘’‚‛‹›'"
# Dashes mapped to '-': U+2010 U+2011 U+2012 U+2013 U+2014 U+2015 U+2212 U+2043.
DASH_CHARS = "‐‑‒–—―−⁃"
# Non-breaking spaces mapped to a plain space: U+00A0 U+202F.
NBSP_CHARS = "\u00a0\u202f"
# Invisible characters deleted: U+200B-U+200F, U+202A-U+202E, U+2060, U+FEFF.
ZERO_WIDTH_CHARS = "".join(chr(c) for c in [*range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF])
# Whitespace collapsed to one space: exactly the characters Python's ``\s``
# matches for text (tab..CR, U+001C-U+0020, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).  Written with
# ``\x{..}`` escapes so the same class runs in Java regex and in RE2.
WHITESPACE_CLASS = (r"[\t\n\x0B\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}"
                    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WHITESPACE_RUN = WHITESPACE_CLASS + "+"
# The same characters as a list (for ``translate``): tab..CR, U+001C-U+0020,
# U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WHITESPACE_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# Case folding beyond ``lower``: the folds Python's casefold adds for the
# scripts of the data (German sharp s, Greek final sigma).
CASEFOLD_EXTRA = (("ß", "ss"), ("ς", "σ"))


def _translate_args(typography: bool) -> tuple[str, str]:
    src, dst = "", ""
    if typography:
        src += QUOTE_CHARS + DASH_CHARS
        dst += '"' * len(QUOTE_CHARS) + "-" * len(DASH_CHARS)
    src += NBSP_CHARS
    dst += " " * len(NBSP_CHARS)
    # characters of ``src`` without a counterpart in ``dst`` are deleted
    src += ZERO_WIDTH_CHARS
    return src, dst


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c, typography: bool = True) -> Column:
    """TX1 (``typography=True``) / TX2 (``False``): NULL -> '', map quotes and
    dashes, NBSP -> space, delete zero-width characters, collapse whitespace,
    trim.  Case is kept.

    One ``translate`` maps quotes, dashes and every whitespace character to
    their targets and deletes the invisible ones; a plain ``' {2,}'`` collapse
    and ``trim`` finish (no Unicode class regex over the text)."""
    src, dst = _translate_args(typography)
    ws = "".join(ch for ch in WHITESPACE_CHARS if ch not in src)
    # deleted characters must come after all mapped ones in translate's source
    mapped, deleted = src[:len(dst)], src[len(dst):]
    s = F.translate(F.coalesce(_col(c).cast("string"), F.lit("")), mapped + ws + deleted, dst + " " * len(ws))
    s = F.regexp_replace(s, " {2,}", " ")
    return F.trim(s)


def normalize_name(c) -> Column:
    """TX2: normalisation without quote/dash mapping."""
    return normalize_text(c, typography=False)


def casefold(c) -> Column:
    s = F.lower(_col(c))
    for a, b in CASEFOLD_EXTRA:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def match_key(c, typography: bool = True) -> Column:
    """TX3: normalised and case-folded key for matching."""
    return casefold(normalize_text(c, typography))


def id_match_key(c, typography: bool = True) -> Column:
    """TX4: match key with every space removed."""
    return F.replace(match_key(c, typography), F.lit(" "), F.lit(""))


def starts_with_key(c, prefix: str) -> Column:
    """TX5: prefix test after normalisation of both sides."""
    return match_key(c).startswith(F.lit(py_match_key(prefix)))


def regex_any(c, patterns: list[str]) -> Column:
    """TX6: true when any Java regex of ``patterns`` is found (case-insensitive,
    Unicode classes)."""
    if not patterns:
        return F.lit(False)
    hits = [_col(c).rlike("(?iuU)" + p) for p in patterns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def contains_any(c, needles: list[str]) -> Column:
    """TX6 substring cues."""
    if not needles:
        return F.lit(False)
    out = None
    for n in needles:
        h = F.instr(_col(c), n) > 0
        out = h if out is None else (out | h)
    return out


def decimal_comma_to_double(c) -> Column:
    """TX7: ``'1,5'`` -> 1.5; anything that is not a number -> NULL."""
    from wideprep.functions.numeric import to_number
    return to_number(F.replace(_col(c).cast("string"), F.lit(","), F.lit(".")))


def significance_label(p, alpha: float = 0.05, yes: str = "yes", no: str = "no") -> Column:
    """TX9: label by ``p < alpha``; a NULL p is not significant."""
    return F.when(_col(p) < F.lit(alpha), F.lit(yes)).otherwise(F.lit(no))


def sign_label(v, pos: str = "increased", neg: str = "decreased") -> Column:
    """TX9: label by sign (zero counts as decreased, like ``v > 0``)."""
    return F.when(_col(v) > 0, F.lit(pos)).otherwise(F.lit(neg))


# --- driver-side twins for metadata (column names are bounded by #columns) ---

def py_normalize_text(s, typography: bool = True) -> str:
    import re
    txt = "" if s is None else str(s)
    if typography:
        txt = txt.translate({ord(q): '"' for q in QUOTE_CHARS})
        txt = txt.translate({ord(d): "-" for d in DASH_CHARS})
    txt = txt.translate({ord(n): " " for n in NBSP_CHARS})
    txt = txt.translate({ord(z): None for z in ZERO_WIDTH_CHARS})
    txt = re.sub(r"\s+", " ", txt).strip()
    return txt


def py_match_key(s, typography: bool = True) -> str:
    out = py_normalize_text(s, typography).lower()
    for a, b in CASEFOLD_EXTRA:
        out = out.replace(a, b)
    return out


def py_id_match_key(s, typography: bool = True) -> str:
    return py_match_key(s, typography).replace(" ", "")
