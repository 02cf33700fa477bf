"""Terms of queries, names in their case styles, and chunks of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexError_

#: Words that the hybrid planner leaves out of its pattern.
PLAN_STOP = frozenset("the a an and or of to in is on for with by at as from that this".split())
#: Words that search and delegate leave out; another list than the planner's.
SEARCH_STOP = frozenset("a an and are as at be by find for from how in inside is it of on or that the this to where with".split())
PLAN_TERMS, SEARCH_TERMS = 12, 16
_SPLIT = re.compile(r"[^\w\-]+")
_META = frozenset(".+*?()|[]{}^$\\/")
_SPLIT_SQL = r"[^\p{IsAlphabetic}\p{N}_-]+"


def tokenize(query: str) -> list[str]:
    """Planner terms: lower case, three bytes at least, no stop words, the first 12 distinct ones."""
    out: list[str] = []
    for part in _SPLIT.split(query):
        term = part.lower()
        if len(term.encode()) >= 3 and term not in PLAN_STOP and term not in out:
            out.append(term)
            if len(out) == PLAN_TERMS:
                break
    return out


def _ascii_lower(value: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value)


def query_terms(query: str) -> list[str]:
    """Search terms: ASCII lower case, two bytes at least, the first 16 distinct ones that are no
    stop words; if all are stop words, these."""
    raw = list(dict.fromkeys(t for t in map(_ascii_lower, _SPLIT.split(query)) if len(t.encode()) >= 2))
    return ([t for t in raw if t not in SEARCH_STOP] or raw)[:SEARCH_TERMS]


def tokenize_column(value: Column) -> Column:
    """``tokenize`` as a column: an array of terms in order."""
    words = F.transform(F.split(value, _SPLIT_SQL), F.lower)
    kept = F.filter(words, lambda x: (F.octet_length(x) >= 3) & ~x.isin(*sorted(PLAN_STOP)))
    return F.slice(F.array_distinct(kept), 1, PLAN_TERMS)


def query_terms_column(value: Column) -> Column:
    """``query_terms`` as a column."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.array_distinct(F.filter(F.split(F.translate(value, upper, lower), _SPLIT_SQL), lambda x: F.octet_length(x) >= 2))
    kept = F.filter(words, lambda x: ~x.isin(*sorted(SEARCH_STOP)))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(words), 1, SEARCH_TERMS)


def regex_escape(value: str) -> str:
    """A pattern that matches ``value`` itself; a hyphen stays as it is."""
    return "".join("\\" + c if c in _META else c for c in value)


def regex_escape_column(value: Column) -> Column:
    """``regex_escape`` as a column."""
    return F.regexp_replace(value, r"[.+*?()|\[\]{}^$\\/]", r"\\$0")


def any_of(terms: list[str]) -> str:
    return "|".join(map(regex_escape, terms))


_POSIX = {
    "alpha": r"\p{Alpha}", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "blank": r"\t ", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f",
    "word": "0-9A-Za-z_", "cntrl": r"\x00-\x1F\x7F", "graph": "!-~", "print": " -~", "ascii": r"\x00-\x7F",
}
_POSIX["alpha"] = "A-Za-z"
_CATEGORY = {
    "letter": "L", "lowercase_letter": "Ll", "uppercase_letter": "Lu", "titlecase_letter": "Lt", "modifier_letter": "Lm", "other_letter": "Lo", "number": "N", "decimal_number": "Nd",
    "punctuation": "P", "symbol": "S", "separator": "Z", "mark": "M", "other": "C", "uppercase": "IsUppercase", "lowercase": "IsLowercase", "alphabetic": "IsAlphabetic", "any": "IsAssigned",
}
_PIECE = re.compile(
    r"""\\(?P<prop>[pP])(?:\{(?P<name>[^}]*)\}|(?P<letter>\w))|\\b\{(?P<edge>start|end|start-half|end-half)\}|\\(?P<code>[xuU])(?:\{(?P<hex>[0-9A-Fa-f]+)\}|(?P<digits>[0-9A-Fa-f]+))
    |\\(?P<escape>.)|\[:(?P<not>\^?)(?P<posix>\w+):\]|\(\?P<(?P<group>[^>]*)>|\(\?(?P<look><?[=!]|>)|\(\?(?P<flags>[a-zA-Z-]+)(?P<close>[:)])|\{,(?P<upto>\d+)\}|(?P<set>--|~~)|(?P<twice>[*+?}]\+)|(?P<other>.)""",
    re.S | re.X,
)
_EDGES = {"start": r"\b(?=\w)", "end": r"\b(?<=\w)", "start-half": r"(?<!\w)", "end-half": r"(?!\w)"}


def _piece(m: re.Match, inside: bool) -> str:
    """A piece of a pattern in Java's spelling."""
    if m["prop"]:
        name = (m["name"] or m["letter"]).strip()
        negated = (m["prop"] == "P") != name.startswith("^")
        name = name.lstrip("^")
        if "=" not in name and not re.fullmatch(r"[A-Z][a-z]?", name):
            name = _CATEGORY.get(name.lower(), "Is" + name)
        return rf"\{'P' if negated else 'p'}{{{name}}}"
    if m["edge"]:
        return _EDGES[m["edge"]]
    if m["code"]:
        digits = m["hex"] or m["digits"][: {"x": 2, "u": 4, "U": 8}[m["code"]]]
        return rf"\x{{{digits}}}" + (m["digits"] or "")[len(digits) :]
    if m["escape"]:
        c = m["escape"]
        if c in "<>" and not inside:
            return _EDGES["start" if c == "<" else "end"]
        if c == "v":
            return r"\x0B"
        if c in "123456789kgGQEZRXhHVNec0" or (c.isalpha() and c not in "afnrtdDsSwWbBAz"):
            raise IndexError_(f"bad regex: \\{c} is not supported")
        return m[0]
    if m["posix"]:
        if not inside or m["posix"] not in _POSIX:
            return "".join("\\" + c if c in "[]^" else c for c in m[0]) if inside else m[0]
        body = _POSIX[m["posix"]]
        return f"[^{body}]" if m["not"] else body
    if m["group"] is not None:
        return f"(?<{re.sub('[^A-Za-z0-9]', 'x', m['group']) or 'x'}>" if not inside else m[0]
    if m["look"] and not inside:
        raise IndexError_("bad regex: look-around and atomic groups are not supported")
    if m["flags"] and not inside:
        if set(m["flags"]) - set("imsxUuR-"):
            raise IndexError_(f"bad regex: unknown flag in {m[0]}")
        on, _, off = m["flags"].partition("-")  # which match is taken, and Unicode, make no difference to whether there is one
        on, off = ("".join(f for f in x if f in "imsx") for x in (on, off))
        if not on and not off:
            return "" if m["close"] == ")" else "(?:"
        return f"(?{on}{'-' + off if off else ''}{m['close']}"
    if m["upto"]:
        return f"{{0,{m['upto']}}}" if not inside else m[0]
    if m["set"] and inside:
        raise IndexError_("bad regex: differences of classes are not supported")
    if m["twice"] and not inside:
        raise IndexError_("bad regex: possessive repeats are not supported")
    return m[0]


def java_pattern(pattern: str, case_insensitive: bool = False, multi_line: bool = False) -> str:
    """The pattern in Java's dialect, with Unicode classes and only ``\\n`` as a line end.

    POSIX classes, ``(?P<name>``, ``\\u{..}``, Unicode properties, word edges and flags within a pattern are translated. What a
    linear-time matcher lacks (look-around, back references, atomic groups, possessive repeats) is refused, and the rest is
    checked by Java itself where a session is there.
    """
    out, at, depth = [], 0, 0
    named: set[str] = set()
    while at < len(pattern):
        m = _PIECE.match(pattern, at)
        if m is None:
            raise IndexError_(f"bad regex: trailing backslash in {pattern}")
        if m["posix"] and not depth or (m["set"] or m["twice"]) and (depth == 0) == bool(m["set"]):
            piece, at = pattern[at], at + 1  # of no meaning here: one character at a time
        else:
            piece, at = _piece(m, depth > 0), m.end()
        if m["group"] is not None and not depth:
            if m["group"] in named:
                raise IndexError_(f"bad regex: two groups are named {m['group']}")
            named.add(m["group"])
            piece = piece if re.fullmatch(r"\(\?<[A-Za-z][A-Za-z0-9]*>", piece) and len(named) == 1 else f"(?<x{len(named)}>"
        if piece == "[":
            depth += 1
            if pattern[at : at + 1] == "^":
                piece, at = "[^", at + 1
            if pattern[at : at + 1] == "]":  # a bracket that comes first is one of the class
                piece, at = piece + "\\]", at + 1
        elif piece == "]" and depth:
            depth -= 1
        out.append(piece)
    made = f"(?dU{'i' if case_insensitive else ''}{'m' if multi_line else ''})" + "".join(out)
    session = SparkSession.getActiveSession()
    if session is not None and hasattr(session, "_jvm"):
        try:
            session._jvm.java.util.regex.Pattern.compile(made)
        except Exception as error:
            raise IndexError_(f"bad regex: {pattern}") from error
    return made


def case_variants(name: str) -> list[str]:
    """A name as it is and in snake, kebab, upper snake, camel and Pascal case, without repeats."""
    if len(name) < 2:
        return [name]
    spaced = re.sub(r"[_\-.:]+", " ", name)
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", spaced)
    spaced = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", " ", spaced)
    words = [w.lower() for w in spaced.split()]
    if not words:
        return [name]
    capital = [w[:1].upper() + w[1:] for w in words]
    styles = ["_".join(words), "-".join(words), "_".join(words).upper(), words[0] + "".join(capital[1:]), "".join(capital)]
    return list(dict.fromkeys([name, *styles]))


def symbol_pattern(names: list[str]) -> str:
    return "|".join(rf"\b{regex_escape(n)}\b" for n in names)


def chunks(corpus: DataFrame, size: int = 1200, overlap: int = 200, align_start: bool = False) -> DataFrame:
    """(uri, start, end, text): byte windows of ``size`` every ``size - overlap`` bytes.

    A window's end moves on to the next character boundary. A window that would begin within a
    character is skipped, so that its bytes may be in no chunk; with ``align_start`` its
    start moves on instead. The first window that reaches the end is the last. Null and empty contents give none.
    """
    step = max(1, size - overlap)
    rows = corpus.select("uri", F.col("content").cast("binary").alias("b")).where(F.octet_length("b") > 0)
    n = F.octet_length(F.col("b"))

    def inside(at: Column) -> Column:
        # a continuation byte begins with the bits 10
        return F.hex(F.substring(F.col("b"), at + 1, F.lit(1))).rlike("^[89AB]")

    def aligned(at: Column) -> Column:
        moved = F.when(~inside(at + 2), at + 2).otherwise(at + 3)
        return F.when(at >= n, n).when(~inside(at), at).when(~inside(at + 1), at + 1).otherwise(moved)

    starts = F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), F.lit(step).cast("long"))
    if not align_start:
        starts = F.filter(starts, lambda x: ~inside(x.cast("int")))
    windows = F.transform(
        starts,
        lambda x: F.struct(
            (aligned(x.cast("int")) if align_start else x).cast("long").alias("start"), aligned(F.least(x + size, n.cast("long")).cast("int")).cast("long").alias("end")
        ),
    )
    # the first window that reaches the end is the last; ends never decrease
    kept = F.slice(F.col("w"), 1, F.size(F.filter(F.col("w"), lambda x: x["end"] < n)) + 1)
    cut = rows.select("uri", "b", windows.alias("w")).select("uri", "b", F.explode(kept).alias("w")).select("uri", "b", "w.*").where("start < end")
    piece = F.substring(F.col("b"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return cut.select("uri", "start", "end", piece.cast("string").alias("text"))
