"""Text and label-string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normlens.constants import RESTRICTIVE_PATTERN, UNSAFE_NAME_CHARS

# Unicode-aware "not a word character and not whitespace".  Java's plain
# [^\w\s] is ASCII-only and would delete accented letters.
_NON_WORD = r"(?U)[^\p{L}\p{N}_\s]"
_WHITESPACE_RUN = r"(?U)\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def html_unescape_basic(c) -> Column:
    """Decode ``&gt;``, ``&lt;`` then ``&amp;`` (in that order)."""
    c = _c(c)
    for ent, ch in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def clean_text(c) -> Column:
    """HTML-decode, drop punctuation (keep Unicode word chars), lower-case."""
    return F.lower(F.regexp_replace(html_unescape_basic(c), _NON_WORD, ""))


def split_whitespace(c) -> Column:
    """Whitespace split; may hold empty tokens at the ends."""
    return F.split(_c(c), _WHITESPACE_RUN)


def words(c) -> Column:
    """Whitespace split without empty tokens (array<string>)."""
    return F.array_remove(split_whitespace(c), "")


def ends_with_question(c) -> Column:
    """Body ends with ``?`` (no trim); NULL body is not a question."""
    return F.coalesce(_c(c).endswith("?"), F.lit(False))


def is_restrictive(c, pattern: str = RESTRICTIVE_PATTERN,
                   word_boundary: bool = False) -> Column:
    """Case-insensitive substring match of ``pattern``; NULL -> false.

    With the default the match is a substring one ("know" matches "no");
    ``word_boundary=True`` anchors the alternatives on word boundaries.
    """
    pat = f"(?i)\\b(?:{pattern})\\b" if word_boundary else f"(?i)(?:{pattern})"
    return F.coalesce(_c(c).rlike(pat), F.lit(False))


def strip_paren_suffix(c) -> Column:
    """Remove a greedy ``\\s*(...)`` suffix: ``'r/x (t5_1)'`` -> ``'r/x'``."""
    return F.regexp_replace(_c(c), r"\s*\(.*\)", "")


def safe_name(c) -> Column:
    """File-safe name: each of ``UNSAFE_NAME_CHARS`` becomes ``_``."""
    cls = "[" + "".join("\\" + ch if ch in "\\[]^-" else ch for ch in UNSAFE_NAME_CHARS) + "]"
    return F.regexp_replace(_c(c), cls, "_")


def trim_or_empty(c) -> Column:
    return F.trim(F.coalesce(_c(c), F.lit("")))


def community_label(name, community_id, n=None) -> Column:
    """``'<name> (<id>)'`` or ``'<name> (<id>) | n=<n>'``."""
    base = F.concat(_c(name), F.lit(" ("), _c(community_id), F.lit(")"))
    if n is None:
        return base
    return F.concat(base, F.lit(" | n="), _c(n).cast("string"))


def equal_width_params(mn, mx, n_bins: int) -> Column:
    """Struct ``(lo, hi, step, first_left)`` of an equal-width cut of [mn, mx].

    Edges are ``lo + i*step``; the first edge is lowered by 0.1% of the
    range so the minimum falls in bin 1; a zero range is widened by 0.1%
    on each side.  Evaluate once (e.g. in a one-row aggregate used as a
    scalar subquery) and pass to :func:`equal_width_bin`.
    """
    mn = _c(mn).cast("double")
    mx = _c(mx).cast("double")
    same = mn == mx
    lo = F.when(same, mn - F.when(mn != 0, F.abs(mn) * 0.001).otherwise(0.001)).otherwise(mn)
    hi = F.when(same, mx + F.when(mx != 0, F.abs(mx) * 0.001).otherwise(0.001)).otherwise(mx)
    step = (hi - lo) / F.lit(float(n_bins))
    first_left = F.when(same, lo).otherwise(lo - (mx - mn) * 0.001)
    return F.struct(lo.alias("lo"), hi.alias("hi"), step.alias("step"),
                    first_left.alias("first_left"))


def equal_width_bin(x, params, n_bins: int) -> Column:
    """1-based right-closed bin of ``x`` (NULL for NULL) given :func:`equal_width_params`.

    (``width_bucket`` is left-closed, so it is not used.)  An estimate is
    corrected by one against the exact edges, so a point equal to an edge
    lands in the bin whose right edge it is.
    """
    x = _c(x).cast("double")
    p = _c(params)
    lo, step = p["lo"], p["step"]

    def edge(j):
        return lo + j.cast("double") * step

    k0 = F.least(F.greatest(F.ceil((x - lo) / step).cast("int"), F.lit(1)), F.lit(n_bins))
    k = (F.when((k0 >= 2) & (edge(k0 - 1) >= x), k0 - 1)
         .when((k0 <= n_bins - 1) & (edge(k0) < x), k0 + 1)
         .otherwise(k0))
    return F.when(x.isNotNull(), k)


def bin_edges(params, n_bins: int, i) -> tuple[Column, Column]:
    """(left, right) edges of bin ``i`` (1-based), matching equal_width_bin."""
    p = _c(params)
    i = _c(i)
    left = F.when(i == 1, p["first_left"]).otherwise(p["lo"] + (i - 1).cast("double") * p["step"])
    right = F.when(i == n_bins, p["hi"]).otherwise(p["lo"] + i.cast("double") * p["step"])
    return left, right
