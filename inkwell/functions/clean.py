"""Markup to plain text and to HTML: an ordered table of rules around protected mathematics and code.

These are Python functions on Arrow batches: protecting and restoring regions needs state that an
expression doesn't have. The table is a documented subset: what it doesn't name is unwrapped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

#: Rules in order: pattern and replacement, on text outside mathematics and code.
RULES: tuple[tuple[str, str], ...] = (
    (r"\\label\{[^}]*\}|\\index\{[^}]*\}|\\(?:noindent|centering|medskip|bigskip|smallskip|newpage|hfill)\b", ""),
    (r"~", " "),
    (r"---", "—"),
    (r"--", "–"),
    (r"``|''", '"'),
    (r"\\(?:ldots|dots)\b\{?\}?", "..."),
    (r"\\(?:cref|Cref|autoref|ref)\{(?:ch|sec|fig|tab|eq):([^}]*)\}", r"\1"),
    (r"\\(?:text)?cite[tp]?(?:\[[^\]]*\])?\{([^}]*)\}", r"[\1]"),
    (r"\\href\{[^}]*\}\{([^}]*)\}", r"\1"),
    (r"\\url\{([^}]*)\}", r"\1"),
    (r"\\(?:textbf|textsc)\{([^{}]*)\}", r"**\1**"),
    (r"\\(?:textit|emph)\{([^{}]*)\}", r"*\1*"),
    (r"\\begin\{(?:itemize|enumerate|description)\}(?:\[[^\]]*\])?|\\end\{(?:itemize|enumerate|description)\}", ""),
    (r"[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", r"\n- \1"),
    (r"\\([%&#_$])", r"\1"),
    (r"\\\\(?:\[[^\]]*\])?", "\n"),
    (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1"),
    (r"\\[a-zA-Z]+\*?", ""),
    (r"[{}]", ""),
    (r"[ \t]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
)
_COMPILED = tuple((re.compile(p), r) for p, r in RULES)
_CODE = re.compile(r"```.*?```|`[^`\n]+`|\\begin\{(?:minted|verbatim|lstlisting)\}.*?\\end\{(?:minted|verbatim|lstlisting)\}|\\(?:verb|lstinline)\|[^|]*\|", re.S)
_MATH = re.compile(r"\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$", re.S)
_CURRENCY = re.compile(r"\$\d[\d,.]*(?:\s?[kKmMbB]\b)?")


def inline_dollars(text: str) -> list[tuple[int, int]]:
    r"""Spans of $...$ from left to right. An escaped dollar is none; a span has no line break, at most 240 characters and isn't money."""
    places = [m.start() for m in re.finditer(r"(?<!\\)\$", text)]
    spans, k = [], 0
    while k + 1 < len(places):
        a, b = places[k], places[k + 1]
        inner = text[a + 1 : b]
        money = _CURRENCY.match(text, a) is not None and re.search(r"[A-Za-z]{2,}", inner) and not re.search(r"[\\^_=]", inner)
        if not inner.strip() or "\n" in inner or len(inner) > 240 or "  " in inner or money:
            k += 1
        else:
            spans.append((a, b + 1))
            k += 2
    return spans


def protect(text: str) -> tuple[str, list[str]]:
    """text with code and mathematics replaced by marks, and what they were."""
    kept: list[str] = []

    def keep(piece: str) -> str:
        kept.append(piece)
        return f"\x00{len(kept) - 1}\x00"

    text = _CODE.sub(lambda m: keep(m[0]), text)
    text = _MATH.sub(lambda m: keep(m[0]), text)
    out, at = [], 0
    for a, b in inline_dollars(text):
        out += [text[at:a], keep(text[a:b])]
        at = b
    return "".join([*out, text[at:]]), kept


def restore(text: str, kept: list[str], change: Callable[[str], str] = lambda x: x) -> str:
    """Marks back to what they stand for, the last first, as one may hold another."""
    for k in range(len(kept) - 1, -1, -1):
        text = text.replace(f"\x00{k}\x00", change(kept[k]))
    return text


def plain(text: str | None) -> str | None:
    """Markup as plain text with light emphasis; mathematics and code stay as they are."""
    if text is None:
        return None
    body, kept = protect(text)
    for _ in range(3):  # formatting may be nested
        before = body
        for pattern, replacement in _COMPILED[9:12]:
            body = pattern.sub(replacement, body)
        if body == before:
            break
    for pattern, replacement in _COMPILED:
        body = pattern.sub(replacement, body)
    return restore(body.strip(), kept)


def math_delimiters(piece: str) -> str:
    r"""$x$ as \(x\), $$x$$ as \[x\]; other pieces unchanged."""
    if piece.startswith("$$"):
        return rf"\[{piece[2:-2]}\]"
    if piece.startswith("$"):
        return rf"\({piece[1:-1]}\)"
    return piece


def to_html(text: str | None) -> str | None:
    """Plain text with light emphasis as HTML: escaped outside mathematics, bold, italics, code, lists and line breaks."""
    if text is None:
        return None
    body, kept = protect(text)
    body = html.escape(body, quote=False)
    body = re.sub(r"\*\*([^*\n]+)\*\*", r"<b>\1</b>", body)
    body = re.sub(r"(?<!\*)\*([^*\n]+)\*(?!\*)", r"<i>\1</i>", body)
    body = re.sub(r"(?:^- .*(?:\n|$))+", lambda m: "<ul>" + "".join(f"<li>{x[2:]}</li>" for x in m[0].strip().split("\n")) + "</ul>", body, flags=re.M)
    body = body.replace("\n", "<br>")

    def piece(x: str) -> str:
        if x.startswith("```"):
            return f"<pre>{html.escape(re.sub(r'^```[a-zA-Z]*\n?|```$', '', x), quote=False)}</pre>"
        if x.startswith("`"):
            return f"<code>{html.escape(x[1:-1], quote=False)}</code>"
        return math_delimiters(x)

    return restore(body, kept, piece)


def _mapped(f: Callable[[str | None], str | None]) -> Callable[[Column | str], Column]:
    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(f, na_action="ignore")

    def column(c: Column | str) -> Column:
        return F.pandas_udf(batches, "string", PandasUDFType.SCALAR_ITER)(c)

    return column


clean_markup = _mapped(plain)
html_of = _mapped(to_html)


def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-block ratio of two texts."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def ratio(a: Column | str, b: Column | str) -> Column:
    """For candidate pairs only: the ratio isn't an expression and takes quadratic time in the lengths."""
    return F.pandas_udf(sequence_ratio, "double", PandasUDFType.SCALAR_ITER)(a, b)


def ratio_above(a: Column | str, b: Column | str, limit: float) -> Column:
    """Whether that ratio is above limit; for most pairs below it, lengths or counts of characters tell."""

    def batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        for x, y in pairs:
            matchers = (SequenceMatcher(None, p or "", q or "") for p, q in zip(x, y, strict=True))
            yield pd.Series([m.real_quick_ratio() > limit and m.quick_ratio() > limit and m.ratio() > limit for m in matchers], dtype=bool)

    return F.pandas_udf(batches, "boolean", PandasUDFType.SCALAR_ITER)(a, b)
